"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes
log-count ratios, trained on labelled text.

Each text is the set of its hashed character n-grams. For a feature, r is the log ratio of its
smoothed shares among toxic and clean training texts. The features whose r is the surest (largest in
units of its standard error) are kept, each with value r where present, and a logistic regression is
fitted over them. Counting runs in Spark; the fit is of a bounded sample of sparse rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

NGRAMS, BUCKET_BITS = (3, 4, 5, 6), 20
#: Labelled texts to learn from (of each class in the order of a hash of the id), and features kept
#: of them.
MAX_ROWS, MAX_FEATURES, LEAST_DOCS = 12_000, 6_000, 4
L2, STEPS, DECISION = 3e-3, 300, 0.3
_SHARDS = 64


def ngrams(text: str) -> np.ndarray:
    """Buckets of all n-grams of the lower-cased text, a blank before and after it, repeats included."""
    s = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(s), np.uint32)
    for n in range(1, NGRAMS[-1] + 1):
        h = h[: len(s) - n + 1] * np.uint32(0x01000193) + s[n - 1 :] * np.uint32(0x9E3779B1)
        if n in NGRAMS:
            out.append((h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS))
        if len(h) < 2:
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """place: bucket to feature or -1; weight: of each feature, r times the fitted coefficient."""

    place: np.ndarray
    weight: np.ndarray
    intercept: float

    def features(self, text: str) -> np.ndarray:
        found = self.place[ngrams(text)]
        return np.unique(found[found >= 0])

    def score(self, text: str) -> float:
        own = self.features(text)
        z = self.intercept + float(self.weight[own].sum()) / max(1.0, len(own)) ** 0.5
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, label, weight) of labelled documents, at most max_rows of them: of either class all, or
    half the bound and what the other leaves of it, chosen by a hash of the id. The weight is how many
    of its class's ids in docs a row stands for. Ids with a null label are left out; of several labels
    of an id the largest holds, and of its several texts the one with the least hash, so that no
    repeated id exceeds the bound."""
    ids = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    ids = ids.join(docs.select(doc_id), doc_id, "left_semi")
    chosen, sizes, share = common.sample_by_class(ids, "label", [F.xxhash64(doc_id), F.col(doc_id)], max_rows)
    weight = F.lit(1.0)
    for name, n in sizes.items():
        weight = F.when(F.col("label") == name, F.lit(n / share[name])).otherwise(weight)
    texts = docs.select(F.col(doc_id), common.text_column(text).alias("text")).join(F.broadcast(chosen.select(doc_id)), doc_id).groupBy(doc_id).agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # max_rows ids
    return texts.join(F.broadcast(chosen), doc_id).select("text", "label", weight.alias("weight"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    rows = np.zeros(2, np.int64)
    for b in batches:
        for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
            n[label, np.unique(ngrams(text))] += 1
            rows[label] += 1
    if rows.any():
        cut = n.reshape(2, _SHARDS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, _SHARDS), pa.int32()), pa.array([rows[0].astype(np.int32).tobytes(), *[x.tobytes() for x in cut[0]]]), pa.array([rows[1].astype(np.int32).tobytes(), *[x.tobytes() for x in cut[1]]])],
            ["shard", "clean", "toxic"],
        )


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for shard, clean, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = [np.frombuffer(x, np.int32) for x in (clean, toxic)]
            total[shard] = [a + x for a, x in zip(total[shard], own, strict=True)] if shard in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), *[pa.array([v[i].tobytes() for v in total.values()]) for i in (0, 1)]], ["shard", "clean", "toxic"])


_COUNTS = "shard int, clean binary, toxic binary"


def ratios(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets kept, their log-count ratios). What reaches the driver has 2**BUCKET_BITS counts."""
    parts = rows.mapInArrow(_count, _COUNTS).repartition(16, "shard").mapInArrow(_sum, _COUNTS).collect()
    by = {r["shard"]: r for r in parts}
    if not by:
        return np.zeros(0, np.int64), np.zeros(0)
    n0, n1 = (int(np.frombuffer(by[-1][c], np.int32)[0]) for c in ("clean", "toxic"))
    c0, c1 = (np.concatenate([np.frombuffer(by[i][c], np.int32) for i in range(_SHARDS)]).astype(float) for c in ("clean", "toxic"))
    r = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    sure = np.abs(r) / np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    sure[c0 + c1 < LEAST_DOCS] = 0
    kept = np.argsort(-sure, kind="stable")[:MAX_FEATURES]
    kept = np.sort(kept[sure[kept] > 3])
    return kept, r[kept]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **columns: str) -> Model:
    """Learn from at most ``max_rows`` labelled texts; without any, every score is 0.5. A class that
    gives a part of its texts counts in the regression as all of them, so that scores keep the scale
    of the whole labelled table."""
    common.arrow_rows(docs.sparkSession)
    rows = common.checkpointed(training_rows(docs, labels, max_rows, **columns))
    kept, r = ratios(rows)
    place = np.full(1 << BUCKET_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    model = Model(place, np.ones(len(kept)), 0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def sparse(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["label"], b["weight"], pa.array([held.value.features(t) for t in b["text"].to_pylist()], pa.list_(pa.int32()))], ["label", "weight", "own"])

    got = rows.mapInArrow(sparse, "label int, weight double, own array<int>").toArrow()
    y, weight = got["label"].to_numpy().astype(float), got["weight"].to_numpy()
    if not len(y):
        return model
    own = got["own"].combine_chunks()
    cols, lengths = own.flatten().to_numpy(), np.diff(own.offsets.to_numpy())
    row_of = np.repeat(np.arange(len(y)), lengths)
    value = r[cols] / np.sqrt(np.maximum(lengths, 1))[row_of]
    w, b = np.zeros(len(kept)), np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):  # Adam over the whole sample
        z = np.bincount(row_of, value * w[cols], minlength=len(y)) + b
        err = weight * (1 / (1 + np.exp(-z)) - y) / weight.sum()
        g = np.append(np.bincount(cols, value * err[row_of], minlength=len(w)) + L2 * w / max(1, len(y)) * 100, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(place, w * r, float(b))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The rows of docs with the score (0 to 1) of the whole text in column ``out``; null text counts
    as empty, and an empty text gets the score of a text without features. Other columns stay (an own
    column of that name is replaced)."""
    common.arrow_rows(docs.sparkSession)
    base = docs.drop(out)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([held.value.score(t or "") for t in b[text].to_pylist()], pa.float64())], [*b.schema.names, out])

    return base.mapInArrow(run, common.extended(base, out, T.DoubleType()))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, held_out, score, predicted; learns only where crc32(doc_id) mod 4 is not 2.

    Null text counts as empty (the score of a text without features), a null id as the empty text in
    the fold; repeated rows are scored alike, other columns are ignored, and an empty table gives no
    rows. Without labels every score is 0.5."""
    held_out = F.col("fold") == 2
    model = fit(docs.where(fold_of(doc_id) != 2), labels, doc_id=doc_id, text=text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), fold_of(doc_id).alias("fold"))
    return score(rows, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))


def fold_of(doc_id: str):
    return common.fold(doc_id, 4)
