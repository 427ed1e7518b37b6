"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One word: the bytes 0x20 and 0x09-0x0D separate words, nothing else does.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of ``spark.checkpoint.dir``; only on one machine (a local
    master) a temporary folder is used where that is unset."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a local master without one, a temporary folder."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Few rows and bytes to an Arrow batch: texts may be long, and a batch is held in memory whole."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that Python workers can
    import it wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_factweave_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "factweave.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    sc._factweave_shipped = True


def text_column(text: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def quotas(sizes: dict, bound: int) -> dict:
    """How many rows each class gives to a sample of ``bound`` rows: small classes all of theirs, the
    others equally many (the bound is exceeded only where there are more classes than it: one each)."""
    out, left = {}, bound
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        out[name] = max(1, min(n, left // (len(sizes) - k)))
        left = max(0, left - out[name])
    return out


def sample_by_class(rows: DataFrame, key: str, order: list, bound: int) -> tuple[DataFrame, dict, dict]:
    """The rows that come first by ``order`` in each class of ``key``, as many as its quota; and the
    classes' sizes and quotas. There are few classes: their sizes are gathered. A class larger than
    its quota is cut in 64 parts first (to their share of the quota, six standard deviations and ten
    rows), so that the second sort has few more rows than the sample."""
    sizes = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    share = quotas(sizes, bound)
    if not share:
        return rows.limit(0), sizes, share
    of_part = {name: n if sizes[name] <= n else min(n, int(n / 64 + 6 * (n / 64) ** 0.5) + 10) for name, n in share.items()}
    limit, part_limit = (F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col(key)) for of in (share, of_part))
    parts = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("__nth", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)))
    parts = parts.where(F.col("__nth") <= part_limit)
    ranked = parts.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__nth") <= limit)
    return ranked.drop("__part", "__nth"), sizes, share


def extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of df with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def groups_in_order(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows (as tuples, keys included) from batches whose rows are sorted by the keys.

    One group at a time is held; the caller bounds the group's size."""

    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    k = len(keys)
    for key, group in groupby(rows(), key=lambda r: r[:k]):
        yield key, list(group)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component), the component being its least node.

    Alternates the large-star and small-star steps until no edge changes; each step is a hash
    shuffle of the edges with the minimum aggregated before it, and the lineage is cut after each
    round, so a lost executor costs one round at most. Nodes without an edge do not appear.
    """
    e = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the lesser neighbours of each node, and the node, all go to the least of them
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = checkpointed(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
