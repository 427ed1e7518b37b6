"""Byte-level BPE encoding and decoding by merge replay.

The distinct pieces of a slice of the corpus are laid out as one array of tokens. An inverted index
from rank (of an adjacent pair's merged token) to the positions of that pair is replayed in rank
order: each rank is applied to all of its positions at once, and only the two neighbours of each
merged place are looked up and posted again. Pieces that were met before keep their ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_NONE = np.iinfo(np.int32).max


class Merges:
    """The ranks of a vocabulary file as a sorted array of pair keys with the ranks they merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte_rank = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        found: dict[int, int] = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        # a table with open addressing: one or two probes, which a binary search takes 18 of
        self.bits = max(10, (len(found) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        todo, values = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = todo[free]  # of several at one slot the last stays
            here = self.keys[at] == todo
            self.values[at[here]] = values[here]
            todo, values, at = todo[~here], values[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair the rank of its merged token, or _NONE."""
        keys = left.astype(np.int64) << 32 | right
        at, out, open_ = self._slot(keys), np.full(len(keys), _NONE, np.int32), np.arange(len(keys))
        while len(open_):
            held = self.keys[at]
            hit = held == keys
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (held != -1)
            open_, keys, at = open_[more], keys[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and where each piece's begin (one more: the end)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        n = int(starts[-1])
        tok = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        first, last = starts[:-1][lengths > 0], starts[1:][lengths > 0] - 1
        nxt[last], prv[first] = -1, -1
        pair = np.full(n, _NONE, np.int32)  # the rank of the pair that starts here
        inner = np.flatnonzero(nxt >= 0)
        pair[inner] = self.rank(tok[inner], tok[inner + 1])
        posted: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            ranks = pair[at]
            live = ranks != _NONE
            at, ranks = at[live], ranks[live]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in posted:
                    posted[r].append(part)
                else:
                    posted[r] = [part]
                    heapq.heappush(heap, r)

        post(inner)
        while heap:
            r = heapq.heappop(heap)
            parts = posted.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[pair[at] == r]
            # overlapping places, as in aaaa: every other one of a chain, from its left end
            if len(at) > 1 and (chained := nxt[at[:-1]] == at[1:]).any():
                run = np.concatenate(([True], ~chained))
                begin = np.flatnonzero(run)
                at = at[(np.arange(len(at)) - begin[np.cumsum(run) - 1]) % 2 == 0]
            if not len(at):
                continue
            # a merge may open a pair of lower rank, which goes first in that piece: one place a piece then
            at, later = self._lower_first(at, r, tok, nxt, prv, owner)
            right = nxt[at]
            after = nxt[right]
            tok[at], nxt[at], pair[at], pair[right] = r, after, _NONE, _NONE
            tok[right] = -1
            linked = after >= 0
            prv[after[linked]] = at[linked]
            before = prv[at]
            touched = np.unique(np.concatenate((at[linked], before[before >= 0])))
            pair[touched] = self.rank(tok[touched], tok[nxt[touched]])
            post(np.concatenate((touched, later)) if len(later) else touched)
        alive = np.flatnonzero(tok >= 0)
        counts = np.bincount(owner[alive], minlength=len(pieces))
        return tok[alive], np.concatenate(([0], np.cumsum(counts)))

    def _lower_first(self, at, r, tok, nxt, prv, owner):
        """Places to merge now, and places of the same pieces that wait because merging the first
        would open a pair of lower rank beside it."""
        none = at[:0]
        if len(at) < 2 or not (owner[at[1:]] == owner[at[:-1]]).any():
            return at, none
        merged = np.full(len(at), r, np.int32)
        low = np.zeros(len(at), bool)
        before, after = prv[at], nxt[nxt[at]]
        i = np.flatnonzero(before >= 0)
        low[i] |= self.rank(tok[before[i]], merged[i]) < r
        i = np.flatnonzero(after >= 0)
        low[i] |= self.rank(merged[i], tok[after[i]]) < r
        if not low.any():
            return at, none
        slow = np.isin(owner[at], owner[at[low]])
        firsts = np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))
        return at[~slow | firsts], at[slow & ~firsts]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """Read once in a Python worker."""
    if path not in _loaded:
        _loaded[path] = Merges(load_ranks(path))
    return _loaded[path]


def _split(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


#: Of the pieces met before, a worker keeps those of at most so many characters, and so many of them.
KEEP_CHARS, KEEP_PIECES = 48, 1_000_000

_ENCODED = pa.schema([("row", pa.int64()), ("ids", pa.list_(pa.int32()))])


class _Pieces:
    """Piece to (ids as text, number of ids, decoded bytes), filled by merge replay."""

    def __init__(self, model: Merges):
        self.model, self.known = model, {}

    def learn(self, texts: list[list[str]]) -> dict[str, tuple[str, int, bytes]]:
        new = set().union(*texts).difference(self.known) if texts else set()
        if len(self.known) + len(new) > KEEP_PIECES:
            self.known, new = {}, set().union(*texts)
        pieces = list(new)
        ids, cuts = self.model.encode([p.encode() for p in pieces])
        ids, cuts, bytes_of = ids.tolist(), cuts.tolist(), self.model.bytes_of
        text_of = {}
        for p, a, b in zip(pieces, cuts, cuts[1:], strict=False):
            own = ids[a:b]
            text_of[p] = (",".join(map(str, own)), b - a, b"".join([bytes_of[i] for i in own]))
        self.known.update(text_of)
        out = self.known
        if any(len(p) > KEEP_CHARS for p in pieces):
            out = dict(out)
            for p in pieces:
                if len(p) > KEEP_CHARS:
                    del self.known[p]
        return out


#: Texts are encoded in blocks of about so many characters.
BLOCK_CHARS = 8_000_000


def _blocks(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        texts, start, held = b[column].to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= BLOCK_CHARS:
                yield b.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0
        if start < len(texts):
            yield b.slice(start), texts[start:]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The rows of docs with ``ids array<int>``: the text's tokens, without special tokens.

    Null text counts as empty and gives an empty list; other columns stay as they are (an own column
    called ids is replaced). Rows are worked on where they are, without a shuffle."""
    common.arrow_rows(docs.sparkSession, 2000)
    base = docs.drop("ids")
    schema = common.extended(base, "ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        split, pieces = _split(pattern), _Pieces(merges(path))
        for b, texts in _blocks(batches, text):
            split_texts = [split(t or "") for t in texts]
            known = pieces.learn(split_texts)
            ids = [[int(i) for p in t for i in known[p][0].split(",")] for t in split_texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "ids"])

    return base.withColumn(text, common.text_column(text)).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows of docs with the bytes that the ids stand for, as a binary column."""
    schema = common.extended(docs.drop(decoded), decoded, T.BinaryType())

    def run(batches):
        bytes_of = merges(path).bytes_of
        for b in batches:
            out = [b"".join([bytes_of[i] for i in x or ()]) for x in b[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, decoded])

    return docs.drop(decoded).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass.

    Null text counts as empty, null ids are ordinary values, repeated rows are encoded alike, other
    columns are ignored, and an empty table gives no rows."""
    common.arrow_rows(docs.sparkSession, 2000)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        split, pieces = _split(pattern), _Pieces(merges(path))
        for b, texts in _blocks(batches, "text"):
            split_texts = [split(t) for t in texts]
            known = pieces.learn(split_texts)
            n, ids, decoded = [], [], []
            for t in split_texts:
                got = [known[p] for p in t]
                n.append(sum([g[1] for g in got]))
                ids.append(hashlib.sha256(",".join([g[0] for g in got]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
            yield common.batch(schema, doc_id=b["doc_id"], n_tokens=n, ids_sha256=ids, decoded_sha256=decoded)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_column(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
