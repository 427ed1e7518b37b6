"""Document fingerprints by order MinHash of character k-mers.

A text's code points form overlapping k-mers; the j-th occurrence of a k-mer is a k-mer of its own.
Each of COORDINATES hash orders selects the LENGTH least of *all* the text's k-mers, puts them back in
the order in which they stand in the text, and hashes them as a tuple. Texts share a tuple only if
they share k-mers in the same order, which makes the signatures sensitive to edit distance.

The selection runs in numpy inside Spark tasks, in blocks of bounded size. (In DataFrame functions
alone, character k-mers took more processor time than is allowed here; see the README.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Code points in a k-mer, tuples of a fingerprint, and selected k-mers in a tuple.
K, COORDINATES, LENGTH = 6, 32, 2
#: K-mers looked at together under all coordinates.
BLOCK = 8192
_EMPTY = "-"
_rng = np.random.default_rng(20240607)
_TURNS = _rng.integers(1, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_FLIPS = _rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _Q
    return h ^ h >> np.uint64(29)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer of the text and its occurrence number, in text order. A text of
    fewer than k code points is one k-mer."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(s):
        return s
    k = min(k, len(s))
    n = len(s) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ s[j : j + n]) * _P
        h ^= h >> np.uint64(31)
    # equal k-mers side by side, in order of position: number them within each run
    bits = np.uint64(n.bit_length())
    both = np.sort(h >> bits << bits | np.arange(n, dtype=np.uint64))
    key, at = both >> bits, (both & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    nth = np.empty(n, np.uint64)
    nth[at] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return _mixed(h + nth * _P)


def selected(hashes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Places of the ``length`` least k-mers under each coordinate (COORDINATES x length, or fewer
    columns if there are fewer k-mers), in text order; of equal values the first place is taken."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    values = places = None
    for i in range(0, len(short), BLOCK):
        v = (short[None, i : i + BLOCK] * _TURNS[:, None]) ^ _FLIPS[:, None]
        rows = np.arange(COORDINATES)
        got_v, got_p = [], []
        for _ in range(min(length, v.shape[1])):
            at = v.argmin(1)
            got_v.append(v[rows, at])
            got_p.append(at + i)
            v[rows, at] = np.uint32(0xFFFFFFFF)
        new_v, new_p = np.stack(got_v, 1), np.stack(got_p, 1)
        if values is not None:
            new_v, new_p = np.concatenate((values, new_v), 1), np.concatenate((places, new_p), 1)
            order = np.argsort(new_v, axis=1, kind="stable")[:, :length]
            new_v, new_p = np.take_along_axis(new_v, order, 1), np.take_along_axis(new_p, order, 1)
        values, places = new_v, new_p
    return np.sort(places, axis=1)


def fingerprint(text: str, k: int = K, length: int = LENGTH) -> str:
    """COORDINATES tuple hashes of 8 hex digits joined by ``.``; ``-`` for each where the text is empty."""
    h = numbered_kmers(text, k)
    if not len(h):
        return ".".join([_EMPTY] * COORDINATES)
    places = selected(h, length)
    out = np.full(COORDINATES, places.shape[1], np.uint64)
    for j in range(places.shape[1]):
        out = _mixed((out ^ h[places[:, j]]) * _P)
    return ".".join([f"{x:08x}" for x in (out >> np.uint64(32)).tolist()])


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, length: int = LENGTH) -> DataFrame:
    """The rows of df with column ``out``, the fingerprint of column ``text``. Null counts as empty;
    equal texts have equal fingerprints on any machine; repeated rows are fingerprinted alike; other
    columns stay (an own column called ``out`` is replaced); an empty table gives no rows."""
    common.arrow_rows(df.sparkSession)
    base = df.drop(out)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t or "", k, length) for t in b[text].to_pylist()], pa.string())], [*b.schema.names, out])

    return base.mapInArrow(run, common.extended(base, out, T.StringType()))


def likeness(a: str, b: str) -> Column:
    """The share of equal tuples among those filled in either fingerprint, 0 to 1; 1 if none is
    filled in either."""
    pairs = F.zip_with(F.split(F.col(a), r"\."), F.split(F.col(b), r"\."), lambda x, y: F.when(x != y, 0).when(x == _EMPTY, -1).otherwise(1))
    filled, equal = F.size(F.filter(pairs, lambda x: x >= 0)), F.size(F.filter(pairs, lambda x: x > 0))
    return F.when(filled == 0, 1.0).otherwise(equal / filled)


def edited(text: str, following: str) -> str:
    """The text whose last third (rounded down) is replaced by as many first code points of the
    following text, or all of them."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("kind", pa.string()), ("part", pa.int32()), ("text", pa.string())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, kind string, part int, text string"


def _done(doc_id, text: str, own: str, following: str, next_print: str) -> tuple:
    e = edited(text, following)
    return doc_id, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(e), next_print, "done", None, None


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over one part of the order and holds one row. Each row but the last meets its next
    one; the first (``head``) and the last (``open``) are handed on with their texts."""
    part, before, out = TaskContext.get().partitionId(), None, []
    for b in batches:
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            own = fingerprint(text)
            if before is None:
                out.append((None, None, None, own, None, None, "head", part, text))
            else:
                out.append(_done(*before, text, own))
            before = doc_id, text, own
        yield common.batch(_ROW, **dict(zip(_ROW.names, zip(*out, strict=True), strict=True))) if out else pa.RecordBatch.from_pylist([], _ROW)
        out = []
    if before is not None:
        yield common.batch(_ROW, **dict(zip(_ROW.names, zip((before[0], None, None, before[2], None, None, "open", part, before[1]), strict=True), strict=True)))


def _close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_done(*r) for r in zip(*(b[c].to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")), strict=True)]
        if rows:
            yield common.batch(_ROW, **dict(zip(_ROW.names, zip(*rows, strict=True), strict=True)))


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. The next document is that of the next lesser id (after the last: the first).

    The order is descending ids, nulls last; rows of one id go by a hash of the text, then the text,
    so any order of the input gives the same rows, and one frequent id (or null) spreads over parts.
    Null text counts as empty, repeated rows are documents of their own, other columns are ignored,
    and an empty table gives no rows. Rows are range-partitioned into ``parts`` (shuffle partitions if
    not given) and streamed; only the last row of a part waits for the first of the next part that
    has one, by a join of one row a part."""
    spark = docs.sparkSession
    common.arrow_rows(spark, 500)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_column(text).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ordered = d.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    # written once: the ranges are drawn from a sample, so the parts must not be made a second time
    rows = common.checkpointed(ordered.mapInArrow(_follow, _DDL))
    have = [r[0] for r in rows.where("kind = 'head'").select("part").orderBy("part").collect()]  # a number a part
    pairs = spark.createDataFrame(list(zip(have, have[1:] + have[:1], strict=True)), "part int, next_part int")
    heads = rows.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    opens = rows.where("kind = 'open'").select("doc_id", "text", "fingerprint", "part").join(pairs, "part").join(heads, "next_part")
    closed = opens.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_close, _DDL)
    both = rows.where("kind = 'done'").unionByName(closed)
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
