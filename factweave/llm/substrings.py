"""Repeated-substring removal with run-length (r-)indexes over the repetitive part of a corpus.

Every byte covered by a string of LENGTH bytes that also starts anywhere else is removed.

1. Anchors. The least hash of the GRAM-byte grams of a window of LENGTH bytes (the leftmost on ties)
   depends on the window alone, so equal windows have equal anchors. Neighbouring windows of one
   anchor occurrence form a *context*: the bytes of those windows. Only (anchor, context) hashes are
   shuffled, about one row for 85 bytes of text.
2. An anchor that occurs once repeats nothing. Of the others' contexts one of each kind goes on, with whether it
   stands for several.
3. They are dealt to groups by anchor. A group builds the suffix order and run-compressed Burrows-Wheeler transform of its contexts. A
   suffix's longest match with its neighbours falls by one from text position to position except
   where a run begins or ends; so lengths are computed at the sampled run ends only, and streaming
   over the positions gives the matching statistics of all others; where a context stands for several, its
   positions also match its copies, to its end. Matches of LENGTH bytes or more are marked, in all copies.
   Anchors of more than HOT_CONTEXTS different contexts are left out there; their windows' hashes
   are counted by an aggregation instead, which no single task holds.
4. A document's marks are merged and its bytes cut, with the text joined to the marks by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import iterate

from . import common

LENGTH, GRAM = 200, 32
#: Texts are hashed in pieces of about so many bytes, and indexed in groups of about so many.
PIECE, GROUP_BYTES = 1 << 21, 1 << 19
#: An anchor of more contexts isn't indexed in one task: its windows are counted by hash.
HOT_CONTEXTS = 8192
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_AT_BITS = 23


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte gram, by doubling."""
    h, n = _BYTE[data], 1
    for mix in _MIX:
        h = h[:-n] * mix + h[n:]
        h ^= h >> np.uint64(31)
        n *= 2
    return h


def contexts(data: np.ndarray, ends: np.ndarray | None = None, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes of texts that follow each other (``ends``: where each ends): the anchor hash,
    first byte and byte length of each context."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(data)
    width = length - GRAM + 1
    key = (h * np.uint64(0xE7037ED1A0B428DB)) & ~np.uint64((1 << _AT_BITS) - 1) | np.arange(len(h), dtype=np.uint64)
    least, n = key, 1
    while n * 2 <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if width > n:
        least = np.minimum(least[: len(least) - (width - n)], least[width - n :])
    at = (least & np.uint64((1 << _AT_BITS) - 1)).astype(np.int64)
    new = np.concatenate(([True], at[1:] != at[:-1], [True]))
    if ends is not None:  # a window lies within one text
        inside = np.ones(len(at), bool)
        for e in ends[ends < len(data)].tolist():
            inside[max(0, e - length + 1) : e] = False
        new[:-1] &= inside
        new[1:-1] |= inside[:-1] & ~inside[1:]
        new[:-1] |= np.concatenate(([False], ~inside[:-1])) & inside
        edges = np.flatnonzero(new)
        begin, stop = edges[:-1], edges[1:]
        own = inside[begin]
        begin, stop = begin[own], stop[own]
    else:
        edges = np.flatnonzero(new)
        begin, stop = edges[:-1], edges[1:]
    return h[at[begin]], begin, stop - begin + length - 1


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts laid side by side, about PIECE bytes at a time: bytes, ends, and of each its number and
    the byte of it that comes first. A longer text comes in overlapping parts, no window in two."""
    held: list[bytes] = []
    whose: list[tuple[int, int]] = []
    size = 0

    def laid():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), whose

    for i, raw in enumerate(texts):
        if len(raw) < length:
            continue
        for start in range(0, len(raw) - length + 1, PIECE):
            part = raw[start : start + PIECE + length - 1]
            if held and size + len(part) > 2 * PIECE:
                yield laid()
                held, whose, size = [], [], 0
            held.append(part)
            whose.append((i, start))
            size += len(part)
    if held:
        yield laid()


def _context_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
        for data, ends, whose in pieces([t.encode("utf-8", "surrogatepass") for t in b["text"].to_pylist()]):
            anchor, at, n = contexts(data, ends)
            view = memoryview(data)
            digests = b"".join([hashlib.blake2b(view[a : a + m], digest_size=8).digest() for a, m in zip(at.tolist(), n.tolist(), strict=True)])
            own = np.searchsorted(ends, at, side="right")
            row, first = (np.array([w[j] for w in whose], np.int64) for j in (0, 1))
            place = at - (ends - np.diff(ends, prepend=0))[own] + first[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[row[own]]), pa.array(k2[row[own]]), pa.array(anchor.view(np.int64)), pa.array(np.frombuffer(digests, np.int64)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))], ["k1", "k2", "anchor", "context", "at", "n"]
            )


_PACKED = 7


def packed(text: np.ndarray) -> np.ndarray:
    """Each position's next seven symbols (0 to 256, and 0 beyond the end) in one integer."""
    s = np.concatenate((text, np.zeros(_PACKED - 1, np.int64)))
    key = s[: len(text)].copy()
    for i in range(1, _PACKED):
        key = key << 9 | s[i : i + len(text)]
    return key


def suffix_order(key: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array, by prefix doubling from packed symbols; suffixes that agree in more than
    ``depth`` symbols may stand in any order. A suffix's rank is the place of the first that it can't be told
    from yet; only those that aren't alone are sorted again."""
    n, width = len(key), _PACKED
    order = np.argsort(key).astype(np.int32)
    tied, keys = np.arange(n, dtype=np.int32), key[order]  # places of suffixes to be told apart, and what they are sorted by
    rank = np.full(n + 1, -1, np.int32)  # the last: of what lies beyond the end
    while True:
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(tied)))
        own = order[tied]
        rank[own] = np.repeat(tied[first], sizes)
        left = np.repeat(sizes > 1, sizes)
        tied, own = tied[left], own[left]
        if not len(tied) or width > depth:
            return order
        keys = rank[own].astype(np.int64) << 32 | (rank[np.minimum(own + width, n)] + 1)
        by = np.argsort(keys)
        order[tied], keys = own[by], keys[by]
        width *= 2


def _lengths(key: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Of each pair of suffixes how long they agree, about ``most`` at most (the text's end counts as 0s)."""
    out = np.zeros(len(a), np.int64)
    open_, n = np.arange(len(a)), len(key)
    while len(open_) and out[open_[0]] < most:
        p, q = a[open_] + out[open_], b[open_] + out[open_]
        ok = (p < n) & (q < n)
        p, q = np.minimum(p, n - 1), np.minimum(q, n - 1)
        differ = key[p] ^ key[q]
        same = ok & (differ == 0)
        part = open_[~same & ok]
        for j in range(1, _PACKED):
            out[part] += differ[~same & ok] >> 9 * j == 0
        open_ = open_[same]
        out[open_] += _PACKED
    return out


class RunLengthIndex:
    """heads: the symbol of each run of the Burrows-Wheeler transform; starts: where in suffix order
    it begins; first, last: text positions sampled at its ends; up, down: how far the suffixes there
    agree with the one before the run's first and after its last, about ``most`` at most."""

    def __init__(self, text: np.ndarray, most: int):
        key = packed(text)
        order = suffix_order(key, most)
        bwt = np.where(order > 0, text[order - 1], -1)  # nothing stands before the first position
        self.n = len(text)
        self.starts = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.heads = bwt[self.starts]
        ends = np.append(self.starts[1:], self.n) - 1
        self.first, self.last = order[self.starts], order[ends]
        self.up, self.down = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        self.up[1:] = _lengths(key, self.first[1:], order[self.starts[1:] - 1], most)
        self.down[:-1] = self.up[1:]  # a run's last and the next run's first are each other's neighbours

    def matching_statistics(self) -> np.ndarray:
        """Of each text position the length (up to ``most``) of the longest match that starts there
        and also starts elsewhere. Inside a run a suffix and its neighbour go on together one
        symbol to the left, so going right the length falls by one until the next sample."""
        out, place = np.zeros(self.n, np.int64), np.arange(self.n)
        for at, length in ((self.first, self.up), (self.last, self.down)):
            known = np.zeros(self.n, np.int64)
            known[at] = at
            values = np.zeros(self.n, np.int64)
            values[at] = length
            known = np.maximum.accumulate(known)
            out = np.maximum(out, values[known] - (place - known))
        return out


def index_matches(data: list[bytes], length: int = LENGTH, several: list[bool] | None = None) -> list[np.ndarray]:
    """Of each context, where strings of ``length`` bytes start that start elsewhere too: in the group, or in
    another copy of a context that stands for ``several``.

    Contexts are joined with a separator, symbol 0; what matches beyond a context's own end is cut. A position of
    a context that stands for several matches its copies up to the context's end."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    text = np.frombuffer(b"\0".join(data) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 0
    # samples fall by one a position: they must be known beyond a whole context
    statistics = RunLengthIndex(text, 2 * int(sizes.max()) + 2).matching_statistics()
    if several is not None:
        left = np.repeat(ends, sizes + 1) - np.arange(len(text))
        statistics = np.where(np.repeat(several, sizes + 1), np.maximum(statistics, left), statistics)
    starts = ends - sizes
    return [np.flatnonzero(statistics[s : max(s, s + n - length + 1)] >= length) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


_FOUND = "anchor long, context long, inside int, m int"
_FOUND_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32())


def _index_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows anchor, context, several, bytes sorted by anchor: what of each context matches elsewhere, as anchor, context, inside
    (where it begins in the context), m (its length)."""

    def flush(rows):
        matches = index_matches([r[3] for r in rows], several=[r[2] for r in rows])
        out = [[] for _ in _FOUND_KINDS]
        for (anchor, context, _, _), m in zip(rows, matches, strict=True):
            if not len(m):
                continue
            cut = np.flatnonzero(np.concatenate(([True], np.diff(m) > 1)))
            for a, z in zip(m[cut].tolist(), m[np.append(cut[1:], len(m)) - 1].tolist(), strict=True):
                for column, x in zip(out, (anchor, context, a, z - a + LENGTH), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _FOUND_KINDS, strict=True)], ["anchor", "context", "inside", "m"])

    held, size = [], 0
    for _, rows in common.groups_in_order(batches, ["anchor"]):
        rows = list({r[1]: r for r in rows}.values())  # repeated rows of a table bring a context twice
        own = sum(len(r[3]) for r in rows)
        if held and size + own > GROUP_BYTES:
            yield flush(held)
            held, size = [], 0
        held += rows
        size += own
    if held:
        yield flush(held)


def _window_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows anchor, context, bytes to one row for each window of the bytes, with its digest."""
    for b in batches:
        for anchor, context, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            m = len(raw) - LENGTH + 1
            digests = [hashlib.blake2b(raw[i : i + LENGTH], digest_size=16).digest() for i in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array([anchor] * m, pa.int64()), pa.array([context] * m, pa.int64()), pa.array(range(m), pa.int32()), pa.array(digests, pa.binary())], ["anchor", "context", "inside", "window"])


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text with a key of both: rows that agree in both are alike."""
    t = common.text_column(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(F.col(doc_id).cast("long"), t).alias("k1"), F.xxhash64(t, F.lit(1), F.col(doc_id).cast("long")).alias("k2"))


def marks(docs: DataFrame) -> DataFrame:
    """(k1, k2, at, n): byte stretches to remove, of the keyed documents; they may overlap."""
    rows = docs.where(F.octet_length("text") >= LENGTH).select("k1", "k2", "text").mapInArrow(_context_rows, "k1 long, k2 long, anchor long, context long, at int, n int")
    # one occurrence stands for a context; the three are of one row
    place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    classes = rows.groupBy("anchor", "context").agg(F.count("*").alias("times"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first(place).alias("place"))
    # all columns are asked for here too: then Spark finds one exchange, not two with a pass over the texts each
    met = classes.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("times").alias("all_times"), F.max(F.col("k1").bitwiseXOR(F.col("k2")).bitwiseXOR(F.col("place"))).alias("any"))
    met = met.where("all_times > 1 and any is not null").select("anchor", (F.col("contexts") > HOT_CONTEXTS).alias("hot"))
    kinds = iterate.cut(classes.join(met, "anchor").select("anchor", "context", (F.col("times") > 1).alias("several"), "hot", "k1", "k2", F.shiftright("place", 32).cast("int").alias("at"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n")))

    def cut(batches):
        for b in batches:
            out = [[] for _ in range(4)]
            for text, own in zip(b["text"].to_pylist(), b["wanted"].to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in own:
                    for column, x in zip(out, (w["anchor"], w["context"], w["several"], raw[w["at"] : w["at"] + w["n"]]), strict=True):
                        column.append(x)
            kinds_ = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds_, strict=True)], ["anchor", "context", "several", "bytes"])

    def brought(some: DataFrame) -> DataFrame:
        wanted = some.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "context", "several", "at", "n")).alias("wanted"))
        return docs.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(cut, "anchor long, context long, several boolean, bytes binary")

    grouped = brought(kinds.where("not hot")).repartition("anchor").sortWithinPartitions("anchor", "context")
    found = grouped.mapInArrow(_index_batches, _FOUND)
    if not kinds.where("hot").isEmpty():
        found = found.unionByName(_counted(brought(kinds.where("hot"))))
    # what was found in a context holds wherever it stands
    found = iterate.cut(found)
    return rows.join(found, ["anchor", "context"]).select("k1", "k2", (F.col("at") + F.col("inside")).cast("int").alias("at"), F.col("m").alias("n"))


def _counted(contexts: DataFrame) -> DataFrame:
    """What of the contexts of hot anchors matches elsewhere: repeated contexts whole, of the others windows that occur twice."""
    hot = contexts.dropDuplicates(["anchor", "context"])
    windows = hot.select("anchor", "context", "bytes").mapInArrow(_window_batches, "anchor long, context long, inside int, window binary")
    often = windows.groupBy("window").agg(F.count("*").alias("times")).where("times > 1")
    counted = windows.join(often, "window", "left_semi").select("anchor", "context", "inside", F.lit(LENGTH).alias("m"))
    whole = hot.where("several").select("anchor", "context", F.lit(0).alias("inside"), F.octet_length("bytes").alias("m"))
    return counted.unionByName(whole)


def merge_stretches(found: DataFrame) -> DataFrame:
    """(k1, k2, runs array<struct<at, end>>): each key's stretches as maximal runs, by gaps and islands."""
    by = Window.partitionBy("k1", "k2").orderBy("at", "end")
    s = found.select("k1", "k2", "at", (F.col("at") + F.col("n")).alias("end")).groupBy("k1", "k2", "at").agg(F.max("end").alias("end"))
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.coalesce((F.col("at") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy("k1", "k2", "island").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("runs"))


_CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the
    remaining bytes). Null text counts as empty; texts below LENGTH bytes lose nothing; repeated rows
    are documents of their own, so each is the other's repetition. Other columns are ignored."""
    common.arrow_rows(docs.sparkSession, 500)
    keyed = _keyed(docs, doc_id, text)
    runs = common.checkpointed(merge_stretches(marks(keyed)))
    joined = keyed.join(runs, ["k1", "k2"], "left")

    def cut(batches):
        for b in batches:
            sizes, removed, spans, kept = [], [], [], []
            for t, own in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True):
                raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
                for r in own or ():
                    parts.append(raw[at : r["at"]])
                    at = r["end"]
                rest = b"".join([*parts, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append(len(own or ()))
                kept.append(rest)
            yield common.batch(_CUT, doc_id=b["doc_id"], n_bytes=sizes, n_removed=removed, n_spans=spans, kept=kept)

    return joined.select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
