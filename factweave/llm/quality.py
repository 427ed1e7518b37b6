"""Quality rules: repetition and length counts, and the perplexity of a modified Kneser-Ney model.

The model is of words, one for each language, with interpolated bigrams over continuation unigrams.

1. Vocabulary. Spark counts every word of every document. A language's vocabulary are its words that
   make up at least one in 2**SHARE_BITS of its words (and occur twice), so it has 2**SHARE_BITS
   entries at most whatever the table; as a sorted array of word hashes it is broadcast. All other
   words are one symbol, whose probability is shared equally by as many words as it stands for.
2. Bigrams. Each block of documents becomes sorted arrays of (bigram code, document, count), cut by
   hash into parts: by the first word, and for frequent first words by both words. The parts are
   shuffled once. Each part holds all occurrences of its bigrams: it counts them, and adds to the
   vocabulary-sized tables of how many bigrams follow and precede each word. These tables give
   discounts, interpolation weights and continuation probabilities; they are as bounded as the
   vocabulary. The bigrams themselves, which grow with the corpus, stay in their parts.
3. Scores. In each part the documents' bigrams meet the counts of the same sorted array; what leaves
   it is one sum of log probabilities for each document and part.
4. Bands. A document is rejected if its log-perplexity lies outside its language's band, so many scaled median
   absolute deviations about the median.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A word of a language's vocabulary makes up at least one in 2**SHARE_BITS of its words.
SHARE_BITS = 20
_ID_BITS, _DOC_BITS = SHARE_BITS + 1, 16
#: Bytes of text in a block, and words (of the whole table) for each part.
BLOCK_BYTES, PART_WORDS = 8_000_000, 1 << 20
#: A language's band: its median log-perplexity and so many scaled median absolute deviations. The lower
#: side is wider: a document's copies are in the counts too and make it look predictable, and two or
#: three copies (some 3 to 4 deviations) are for deduplication to judge, not a fault of the text.
LOWER, UPPER = 6.0, 3.0
LEAST_WORDS = 50
#: Sums of log probabilities go from part to document in steps of one such part of a nat.
_NAT = 4096
_BREAKS, _SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(97)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_IS_BREAK, _IS_SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = _IS_SYMBOL[list(_SYMBOLS)] = True
_VALUE[_IS_BREAK] = 0
#: Factors of the bytes of a word by their places in it (used again every 4096 bytes).
_FACTOR = np.cumprod(np.full(4096, _P | np.uint64(1)), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _Q
    return h ^ h >> np.uint64(29)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes begins, and its 64-bit hash."""
    gap = _IS_BREAK[data]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    upto = np.append(starts[1:], len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, upto - starts)
    h = np.add.reduceat(_VALUE[data[starts[0] :]] * _FACTOR[place & 4095], starts - starts[0])
    return starts, _mixed(h)


@dataclass
class Block:
    """Texts side by side: of each word its hash and whose it is; and each text's base counts."""

    hashes: np.ndarray
    owner: np.ndarray
    counts: dict[str, np.ndarray]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes hashed at once (a longer text is hashed whole).
_CHUNK = 1_000_000


def tokenized(texts: list[str], rules: bool) -> Block:
    hashes, owner, found = [], [], {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    held, size, first = [], 0, 0

    def flush(upto: int):
        data = np.frombuffer(b"".join(held), np.uint8)
        ends = np.cumsum([len(x) for x in held])
        starts, h = word_hashes(data)
        own = np.searchsorted(ends, starts, side="right")
        hashes.append(h)
        owner.append((own + first).astype(np.int32))
        n = upto - first
        found["n_words"][first:upto] = np.bincount(own, minlength=n)
        if rules:
            whose = np.repeat(np.arange(n), np.diff(ends, prepend=0))
            # a code point begins at each byte that isn't a continuation
            found["word_chars"][first:upto] = np.bincount(whose[~_IS_BREAK[data] & (data & 0xC0 != 0x80)], minlength=n)
            found["n_symbols"][first:upto] = np.bincount(whose[_IS_SYMBOL[data]], minlength=n)
            found["n_repeat_words"][first:upto] = repeated_words(h, own, n)

    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        if rules:
            found["n_dup_lines"][i] = duplicate_lines(raw)
        held.append(raw + b" ")
        size += len(raw)
        if size >= _CHUNK or i == len(texts) - 1:
            flush(i + 1)
            held, size, first = [], 0, i + 1
    return Block(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(owner) if owner else np.zeros(0, np.int32), found)


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def repeated_words(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts the words in 3-word windows that the text has twice or more (windows are
    compared by a 64-bit hash)."""
    if len(h) < 3:
        return np.zeros(n, np.int64)
    window = _mixed((_mixed((h[:-2] ^ own[:-2].astype(np.uint64) * _Q) * _P + h[1:-1]) ^ h[2:]) * _P)
    inside = own[:-2] == own[2:]
    at = np.flatnonzero(inside)
    order = at[np.argsort(window[at], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    often = np.zeros(len(h), bool)
    for part in (order[1:][same], order[:-1][same]):
        for j in range(3):
            often[part + j] = True
    return np.bincount(own[often], minlength=n)


def base_counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    got = tokenized([text], True).counts
    return tuple(int(got[c][0]) for c in COUNTS)


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def packed(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length as compressed byte planes; the first is sorted and kept by differences."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    raw = b"".join([np.ascontiguousarray(c.reshape(-1, 1).view(np.uint8).T).tobytes() for c in (first, *columns[1:])])
    return np.int64(len(columns[0])).tobytes() + _codec().compress(raw, asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(_codec().decompress(data[8:], n * sum(widths), asbytes=True), np.uint8)
    out, at = [], 0
    for k, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(k).ravel())
        at += n * width
    out[0] = np.cumsum(out[0], dtype=kinds[0])
    return out


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts[order].astype(np.int64), begin) if len(keys) else counts.astype(np.int64)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str], list[str]]]:
    """doc_ids, languages and texts of blocks of about BLOCK_BYTES, within and not across batches."""
    for b in batches:
        ids, langs, texts = (b[c].to_pylist() for c in ("doc_id", "lang", "text"))
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_BYTES or i + 1 - start == (1 << _DOC_BITS) - 1 or i == len(texts) - 1:
                yield ids[start : i + 1], langs[start : i + 1], texts[start : i + 1]
                start, size = i + 1, 0


def _by_lang(langs: list[str]) -> tuple[list[str], np.ndarray]:
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    return names, np.array([place[x] for x in langs], np.int64)


_WORD_PARTS = 256


#: Distinct words of a language that a task gathers before it hands them on.
_HELD_WORDS = 1 << 21


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows(name: str) -> pa.RecordBatch:
        words, n = held.pop(name)
        # the parts are ranges of the sorted hashes
        cuts = np.searchsorted(words >> np.uint64(56), np.arange(_WORD_PARTS + 1, dtype=np.uint64))
        own = [(p, a, z) for p, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array([x[0] for x in own], pa.int32()), pa.array([packed(words[a:z], n[a:z].astype(np.uint32)) for _, a, z in own], pa.binary())], ["lang", "part", "packed"])

    for _, langs, texts in _blocks(batches):
        block = tokenized(texts, False)
        names, of = _by_lang(langs)
        whose = of[block.owner]
        for k, name in enumerate(names):
            words, n = np.unique(block.hashes[whose == k], return_counts=True)
            if name in held:
                words, n = merged(np.concatenate((held[name][0], words)), np.concatenate((held[name][1], n)))
            held[name] = words, n
            if len(words) > _HELD_WORDS:
                yield rows(name)
    for name in list(held):
        yield rows(name)


def _sum_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (lang, _), rows in common.groups_in_order(batches, ["lang", "part"]):
        found = [unpacked(r[2], np.uint64, np.uint32) for r in rows]
        words, n = merged(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words.view(np.int64)), pa.array(n)], ["lang", "word", "n"])


@dataclass
class Vocabulary:
    """hashes: sorted; ids: of each, its rank by frequency; total, rare, kinds: how many words there
    are, how many of them are not in the vocabulary, and how many different ones."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray
    total: int
    rare: int
    kinds: int

    @property
    def other(self) -> int:
        return len(self.hashes)

    @property
    def edge(self) -> int:
        """The symbol before a text, as a first word, and after it, as a second."""
        return len(self.hashes) + 1

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.other, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], self.other)


def _rows(docs: DataFrame, doc_id: str, lang: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), common.text_column(text).alias("text"))


def vocabularies(rows: DataFrame) -> dict[str, Vocabulary]:
    """Each language's vocabulary, from counts of all words of all rows (doc_id, lang, text). What
    reaches the driver has at most 2**SHARE_BITS entries and one more for each language."""
    dealt = rows.mapInArrow(_count_words, "lang string, part int, packed binary").repartition("lang", "part").sortWithinPartitions("lang", "part")
    words = dealt.mapInArrow(_sum_words, "lang string, word long, n long")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known = (F.col("n") >= 2) & (F.col("n") * (1 << SHARE_BITS) >= F.col("total"))
    got = words.join(F.broadcast(totals), "lang").groupBy("lang", F.when(known, F.col("word")).alias("word")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    langs, rare = np.array(got["lang"].to_pylist(), object), got["word"].is_null().to_numpy(zero_copy_only=False)
    word, n, kinds = got["word"].fill_null(0).to_numpy().view(np.uint64), got["n"].to_numpy(), got["kinds"].to_numpy()
    out = {}
    for name in sorted(set(langs.tolist())):
        own = langs == name
        hashes, counts = word[own & ~rare], n[own & ~rare]
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((hashes, -counts))] = np.arange(len(counts))
        by_id = np.zeros(len(counts), np.int64)
        by_id[rank] = counts
        order = np.argsort(hashes)
        by_id = np.zeros(len(counts), np.int64)
        by_id[rank] = counts
        out[name] = Vocabulary(hashes[order], rank[order], by_id, int(n[own].sum()), int(n[own & rare].sum()), int(kinds[own & rare].sum()))
    return out


_POSTED = "block long, lang string, part int, packed binary"
_ROSTER = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(c, pa.int64()) for c in COUNTS]])


def _post(batches: Iterable[pa.RecordBatch], vocabulary: dict[str, Vocabulary], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each block a roster of its documents (no language) and its bigrams by language and part."""
    for ids, langs, texts in _blocks(batches):
        block = tokenized(texts, True)
        roster = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), *[pa.array(block.counts[c]) for c in COUNTS]], schema=_ROSTER)
        whole = hashlib.blake2b(repr((ids, langs)).encode() + block.counts["n_words"].tobytes(), digest_size=8)
        whole.update(block.hashes.tobytes())
        number = int.from_bytes(whole.digest(), "little", signed=True)
        out = [(number, None, number % parts, roster.serialize().to_pybytes())]
        names, of = _by_lang(langs)
        whose = of[block.owner]
        for k, name in enumerate(names):
            v = vocabulary[name] if name in vocabulary else None
            if v is None:  # no word in the whole language
                continue
            own = whose == k
            docs = np.flatnonzero(of == k)
            owner = np.concatenate((block.owner[own], docs))  # each text's end is a symbol
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            second = np.concatenate((v.symbols(block.hashes[own]), np.full(len(docs), v.edge)))[order]
            first = np.concatenate(([v.edge], second[:-1]))  # an end is the edge before the next text
            key = np.sort((first.astype(np.uint64) << np.uint64(_ID_BITS) | second.astype(np.uint64)) << np.uint64(_DOC_BITS) | owner.astype(np.uint64))
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            times, key = np.diff(np.append(begin, len(key))), key[begin]
            code, doc = key >> np.uint64(_DOC_BITS), (key & np.uint64((1 << _DOC_BITS) - 1)).astype(np.uint16)
            part = parts_of(code, v, parts)
            order = np.argsort(part, kind="stable")
            part, code, doc, times = part[order], code[order], doc[order], times[order].astype(np.uint32)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            out += [(number, name, int(part[a]), packed(code[a:z], doc[a:z], times[a:z])) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["block", "lang", "part", "packed"])


def parts_of(code: np.ndarray, v: Vocabulary, parts: int) -> np.ndarray:
    """The part of each bigram: by its first word, or by both if the first is one in 4 * parts words."""
    size = np.append(v.counts, [v.rare, v.total])
    first = code >> np.uint64(_ID_BITS)
    both = size[first.astype(np.int64)] * 4 * parts > v.total
    return (_mixed(np.where(both, code, first) * _P + np.uint64(3)) % np.uint64(parts)).astype(np.int32)


@dataclass
class Tables:
    """Of each first word: n1, n2, n3 (how many different words follow it once, twice, more often)
    and how many words follow in all; of each second word how many different words precede it; and
    how many bigrams occur 1, 2, 3 and 4 times."""

    follow: np.ndarray
    precede: np.ndarray
    occur: np.ndarray

    @staticmethod
    def empty(symbols: int) -> Tables:
        return Tables(np.zeros((4, symbols), np.int64), np.zeros(symbols, np.int64), np.zeros(4, np.int64))

    def add(self, code: np.ndarray, n: np.ndarray) -> None:
        first, second = (code >> np.uint64(_ID_BITS)).astype(np.int64), (code & np.uint64((1 << _ID_BITS) - 1)).astype(np.int64)
        size = len(self.precede)
        for i in range(3):
            self.follow[i] += np.bincount(first[np.minimum(n, 3) == i + 1], minlength=size)
        self.follow[3] += np.bincount(first, n, minlength=size).astype(np.int64)
        self.precede += np.bincount(second, minlength=size)
        self.occur += np.bincount(n[n <= 4], minlength=5)[1:5]


def _counted(rows: list) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray]:
    """Of the rows of a part: their arrays, and its bigrams with their counts."""
    found = [unpacked(bytes(r[-1]), np.uint64, np.uint16, np.uint32) for r in rows]
    return found, *merged(np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found]))


def _groups(rows: Iterator) -> Iterator[tuple[tuple, list]]:
    """Rows block, lang, part, packed in order of lang and part; rosters have no lang."""
    held, key = [], None
    for r in rows:
        if held and (r[1], r[2]) != key:
            yield key, held
            held = []
        key = (r[1], r[2])
        held.append(r)
    if held:
        yield key, held


def _tabled(rows: Iterator, symbols: dict[str, int]) -> Iterator[tuple[tuple[str, int], tuple[int, bytes]]]:
    """((lang, slice), (length, packed numbers)) of one task's tables, a slice for each of their six rows."""
    of: dict[str, Tables] = {}
    for (lang, _), own in _groups(rows):
        if lang is not None:
            _, code, n = _counted(own)
            of.setdefault(lang, Tables.empty(symbols[lang])).add(code, n)
    for lang, t in of.items():
        for i, row in enumerate((*t.follow, t.precede, t.occur)):
            yield (lang, i), packed(row.astype(np.int64))


def _summed(a: bytes, b: bytes) -> bytes:
    return packed(unpacked(a, np.int64)[0] + unpacked(b, np.int64)[0])


@dataclass
class Model:
    """discount: of a bigram seen once, twice, more often; context: how many words follow each first
    word; rest: the weight it leaves to the second word's own probability, single; shared: how many
    words share a symbol."""

    discount: np.ndarray
    context: np.ndarray
    rest: np.ndarray
    single: np.ndarray
    shared: np.ndarray

    def log_p(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of each bigram, seen n times, the natural log of its second word's probability after its first."""
        first, second = (code >> np.uint64(_ID_BITS)).astype(np.int64), (code & np.uint64((1 << _ID_BITS) - 1)).astype(np.int64)
        own = (n - self.discount[np.minimum(n, 3)]) / np.maximum(self.context[first], 1)
        return np.log((own + self.rest[first] * self.single[second]) / self.shared[second])


def discounts(occur: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many n-grams occur 1 to
    4 times; 3/4 (and never more than the count) where these don't tell."""
    n1, n2, n3, n4 = occur.astype(float)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    got = [i - (i + 1) * y * b / a if a else 0.75 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), float(i)) for i, d in enumerate(got, 1))])


def model_of(v: Vocabulary, t: Tables) -> Model:
    """Probabilities of the second words sum to one over the vocabulary, the end of a text, and the
    other words, which share their symbol's probability."""
    d1 = discounts(np.bincount(np.minimum(t.precede, 5), minlength=6)[1:5])
    d2 = discounts(t.occur)
    total, a = max(1, int(t.precede.sum())), t.precede
    left = d1[np.minimum(a, 3)].sum() / total
    single = np.maximum(a - d1[np.minimum(a, 3)], 0) / total + left / len(a) if a.sum() else np.full(len(a), 1 / len(a))
    shared = np.ones(len(a))
    shared[v.other] = max(1, v.kinds)
    context = t.follow[3]
    rest = np.where(context > 0, d2[1:] @ t.follow[:3] / np.maximum(context, 1), 1.0)
    return Model(d2, context, rest, single, shared)


def _scored(rows: Iterator, models: dict[str, Model]) -> Iterator[tuple[int, bool, bytes]]:
    """(block, whether it is a roster, packed): of each block and part the documents' sums of log probabilities."""
    for (lang, _), own in _groups(rows):
        if lang is None:
            yield from ((r[0], True, bytes(r[3])) for r in own)
            continue
        found, code, n = _counted(own)
        p = models[lang].log_p(code, n)
        for r, (c, doc, times) in zip(own, found, strict=True):
            sums = np.bincount(doc, p[np.searchsorted(code, c)] * times)
            have = np.flatnonzero(sums)
            yield r[0], False, packed(have.astype(np.uint16), np.round(-sums[have] * _NAT).astype(np.uint64))


_SCORED = pa.schema([*_ROSTER, ("log_perplexity", pa.float64())])
_SCORED_DDL = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, roster, packed by block: its documents with the mean of their words' and end's negative log probability."""
    for _, rows in common.groups_in_order(batches, ["block"]):
        rosters = [r[2] for r in rows if r[1]]
        first = pa.ipc.read_record_batch(pa.py_buffer(rosters[0]), _ROSTER)
        sums = np.zeros(first.num_rows)
        for r in rows:
            if not r[1]:
                doc, x = unpacked(r[2], np.uint16, np.uint64)
                sums[doc] -= x / _NAT
        # blocks alike in every row have one number: all are there as often, and so are their sums
        sums /= len(rosters)
        mean = -sums / (first["n_words"].to_numpy() + 1)
        for _ in rosters:
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(mean)], schema=_SCORED)


def score(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per document doc_id, lang (null: ``und``), the base counts and log_perplexity, under the model
    of its language that is counted over all of docs."""
    spark = docs.sparkSession
    common.arrow_rows(spark, 4096)
    rows = _rows(docs, doc_id, lang, text)
    vocabulary = vocabularies(rows)
    held = spark.sparkContext.broadcast(vocabulary)
    parts = max(1, -(-sum(v.total for v in vocabulary.values()) // PART_WORDS))
    posted = rows.mapInArrow(lambda batches: _post(batches, held.value, parts), _POSTED).repartition("part").sortWithinPartitions("lang", "part")
    # as an RDD the shuffled parts are read by both jobs, and not made (or stored) twice
    shuffled = posted.rdd
    symbols = {name: v.edge + 1 for name, v in vocabulary.items()}
    sums = dict(shuffled.mapPartitions(lambda it: _tabled(it, symbols)).reduceByKey(_summed).collect())
    models = {}
    for name, v in vocabulary.items():
        own = [unpacked(sums[name, i], np.int64)[0] for i in range(6)]
        models[name] = model_of(v, Tables(np.stack(own[:4]), own[4], own[5]))
    model = spark.sparkContext.broadcast(models)
    scored = shuffled.mapPartitions(lambda it: _scored(it, model.value)).toDF("block long, roster boolean, packed binary")
    return scored.repartition("block").sortWithinPartitions("block").mapInArrow(_finished, _SCORED_DDL)


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """(lang, low, high) of log-perplexity, from the language's documents of LEAST_WORDS words or more:
    the median, and so many scaled median absolute deviations either side."""
    long = scored.where(F.col("n_words") >= LEAST_WORDS)
    middle = long.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("mid"))
    # two columns a language
    spread = long.join(F.broadcast(middle), "lang").groupBy("lang", "mid").agg((1.4826 * F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("mid")), 0.5, 10000)).alias("mad"))
    return spread.select("lang", (F.col("mid") - lower * F.col("mad")).alias("low"), (F.col("mid") + upper * F.col("mad")).alias("high"))


def judge(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed, kept and log_perplexity.

    Null text counts as empty, null lang as the language ``und``; repeated rows are judged alike and
    all counted; null ids are ordinary values; other columns are ignored; an empty table gives no
    rows. A document is kept if it has not failed the base rules and lies within its language's band
    (a language without documents of LEAST_WORDS words has none and rejects none)."""
    scored = common.checkpointed(score(docs, doc_id, lang, text))
    failed: Column = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return (
        scored.join(F.broadcast(bands(scored)), "lang", "left")  # one row a language
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & inside)
        .select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")
    )
