"""Cutting the lineage of iterations in reliable storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """A new place in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder, master = sc.getConf().get("spark.checkpoint.dir"), sc.getConf().get("spark.master", "")
        if not folder and master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"


#: What a task sorts or groups at once, so that its memory doesn't grow with the tables.
ROWS = 250_000


def parts(*tables: DataFrame) -> int:
    """How many partitions the rows of tables take: more than the session's number if those would hold over ROWS each. The
    tables are counted, so they should be ones whose files tell their number of rows."""
    return max(session_parts(tables[0]), -(-sum(t.count() for t in tables) // ROWS))


def session_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, n: int | None, *by: str) -> DataFrame:
    """df dealt by columns over n partitions; left to Spark if n isn't more than the session's number."""
    return df.repartition(n, *by) if n and n > session_parts(df) else df


def bucketed(df: DataFrame, *by: str, n: int | None = None, placed: bool = False) -> DataFrame:
    """cut, dealt by columns as a bucketed table of n buckets (the session's number of partitions if that is more): an iteration
    that joins it by them in every round shuffles it once. placed: df has been dealt by them already."""
    n, path = max(n or 0, session_parts(df)), _folder(df)
    name = f"cut_{path.rsplit('-', 1)[1]}"
    (df if placed else df.repartition(n, *by)).write.format("parquet").option("compression", "zstd").bucketBy(n, *by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder of spark.checkpoint.dir and read back (to a
    temporary folder only if that is unset, on one machine). What is read has no plan but its scan, so an iteration
    plans each round afresh and survives lost executors."""
    path = _folder(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
