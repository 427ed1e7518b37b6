"""Integer k-means whose exact distances are screened by block norms.

A vector of COMPONENTS integers is compressed to two numbers for each segment of SEGMENT components:
its sum s, and f, the norm of what is left around the segment's mean, in 32nds, rounded down. For
vectors x and c the part of their squared distance along the segments' means is (s_x - s_c)**2 / SEGMENT;
for the part around them Cauchy and Schwarz give at least (norm_x - norm_c)**2. So the compressed
forms bound the distance from below, in integers: no rounding can rule out a nearest centroid.

Compressed vectors are computed and written once. A round bounds the distances to all centroids, computes
the one of least bound exactly, then those that its distance doesn't rule out. Sums of a task's
vectors are added up before they are shuffled: a round gathers CENTROIDS x COMPONENTS numbers at
most, whatever the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.iterate import cut

from . import common

COMPONENTS, SEGMENT = 64, 4
CENTROIDS, ROUNDS, SCALE = 16, 3, 64
#: Integers beyond this are taken as this: all distances and bounds then fit in 64 bits.
MOST = 1 << 20


def compressed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's segment sums, and the norms around the segments' means in 32nds, rounded down."""
    parts = v.astype(np.int64).reshape(len(v), -1, SEGMENT)
    sums = parts.sum(2)
    around = SEGMENT * (parts**2).sum(2) - sums**2  # SEGMENT times the squared norm
    f = np.floor(32 * np.sqrt(around / SEGMENT)).astype(np.int64)
    f -= SEGMENT * f * f > 1024 * around  # where the root was rounded up
    return sums, f


def lower_bounds(sums: np.ndarray, norms: np.ndarray, c_sums: np.ndarray, c_norms: np.ndarray) -> np.ndarray:
    """For vectors against one centroid: integers that no squared distance is below."""
    along = ((sums - c_sums) ** 2).sum(1) * (1024 // SEGMENT)
    apart = np.maximum(np.abs(norms - c_norms) - 1, 0)
    return (along + (apart**2).sum(1) + 1023) >> 10


def nearest(v: np.ndarray, sums: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid (of several the first), its squared distance, and how many
    distances were computed."""
    c_sums, c_norms = compressed(centroids)
    bounds = np.stack([lower_bounds(sums, norms, a, b) for a, b in zip(c_sums, c_norms, strict=True)], 1)
    v, centroids = v.astype(np.int64), centroids.astype(np.int64)
    first = bounds.argmin(1)
    cluster, best = first.copy(), ((v - centroids[first]) ** 2).sum(1)
    computed = len(v)
    for j in range(len(centroids)):
        at = np.flatnonzero((bounds[:, j] <= best) & (first != j))
        d = ((v[at] - centroids[j]) ** 2).sum(1)
        closer = (d < best[at]) | (d == best[at]) & (j < cluster[at])
        cluster[at[closer]], best[at[closer]] = j, d[closer]
        computed += len(at)
    return cluster, best, computed


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_PREPARED = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("sums", pa.list_(pa.int32())), ("norms", pa.list_(pa.int32()))])


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, sums, norms) of the vectors of exactly COMPONENTS finite components, written once."""
    wrong = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where((F.size("x") == COMPONENTS) & ~wrong)
    whole = rows.select("vec_id", F.transform("x", lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("int")).alias("v"))

    def run(batches):
        for b in batches:
            sums, norms = compressed(_matrix(b["v"], COMPONENTS))
            yield common.batch(_PREPARED, vec_id=b["vec_id"], v=b["v"], sums=list(sums.astype(np.int32)), norms=list(norms.astype(np.int32)))

    return cut(whole.mapInArrow(run, "vec_id long, v array<int>, sums array<int>, norms array<int>"))


def _assigned(batches: Iterable[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    width = COMPONENTS // SEGMENT
    for b in batches:
        if len(b):
            v = _matrix(b["v"], COMPONENTS)
            cluster, distance, _ = nearest(v, _matrix(b["sums"], width).astype(np.int64), _matrix(b["norms"], width).astype(np.int64), centroids)
            yield b, v, cluster, distance


def moved(ready: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each one's vectors' componentwise sum over count, rounded down;
    those without vectors stay."""
    k = len(centroids)

    def run(batches):
        sums, counts = np.zeros((k, COMPONENTS), np.int64), np.zeros(k, np.int64)
        for _, v, cluster, _ in _assigned(batches, centroids):
            np.add.at(counts, cluster, 1)
            for j in np.unique(cluster):
                sums[j] += v[cluster == j].sum(0, dtype=np.int64)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, COMPONENTS).astype(np.int32)), pa.array(np.tile(np.arange(COMPONENTS), len(held)).astype(np.int32)), pa.array(sums[held].ravel()), pa.array(np.repeat(counts[held], COMPONENTS))],
            ["cluster", "component", "total", "n"],
        )

    totals = ready.mapInArrow(run, "cluster int, component int, total long, n long").groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in totals.collect():  # k x COMPONENTS numbers at most
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of exactly COMPONENTS components, none null, infinite or not a number; a null vector
    isn't. A component x counts as floor(SCALE * x), within +-MOST. The first centroids are the k vectors
    with the least digest of their id (a null id as the empty text), of equal ids the lesser vector; a
    table of fewer vectors has fewer centroids, an empty one gives no rows. Repeated rows count each
    and get rows alike; an inertia of 2**63 or more is null. Other columns are ignored."""
    common.arrow_rows(vectors.sparkSession, 5000)
    ready = prepared(vectors, vec_id, embedding)
    seeds = ready.select(F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), COMPONENTS)
    for _ in range(rounds if len(seeds) else 0):
        centroids = moved(ready, centroids)

    def run(batches):
        for b, _, found, distance in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = cut(ready.mapInArrow(run, "vec_id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    fits = lambda x: int(x) if x < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    rows = [(j, fits(inertia.get(j, 0)), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
