"""Integrity checks: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Distinct non-null references to a parent that isn't there, with their count."""
    known = parent.select(F.col(parent_key).alias(key))
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def order_gaps(rows: DataFrame, group: str, order: str, first: int) -> DataFrame:
    """Groups whose order isn't first, first + 1, ... without gap or repetition."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1 + first
    return rows.withColumn("off", (F.col(order) != nth).cast("int")).groupBy(group).agg(F.sum("off").alias("misplaced")).where("misplaced > 0")


def path_breaks(steps: DataFrame, path: str, order: str, start: str, end: str) -> DataFrame:
    """Steps that don't begin where the step before them ended."""
    before = F.lag(end).over(Window.partitionBy(path).orderBy(order))
    return steps.withColumn("expected", before).where(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col(start))).select(path, order, "expected", F.col(start).alias("found"))


def merge_records(rows: DataFrame, key: str, sets: list[str], fixed: list[str]) -> DataFrame:
    """One record a key: set columns are united and sorted, fixed columns must agree (conflict says
    whether they don't)."""
    united = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in sets]
    same = F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fixed])) > 1
    return rows.groupBy(key).agg(*united, same.alias("conflict"))


def issues(*checks: tuple[str, DataFrame]) -> DataFrame:
    """(code, id): the rows of several checks, each a table with a column ``id``."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [rows.select(F.lit(code).alias("code"), F.col("id").cast("string").alias("id")) for code, rows in checks])


def duplicates(records: DataFrame) -> DataFrame:
    """Ids that several equal records hold."""
    return _repeated(records).where("kinds = 1").select("id")


def id_collisions(records: DataFrame) -> DataFrame:
    """Ids that records with different contents hold."""
    return _repeated(records).where("kinds > 1").select("id")


def _repeated(records: DataFrame) -> DataFrame:
    rest = [c for c in records.columns if c != "id"]
    return records.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("kinds")).where("n > 1")


def wrong_prefix(records: DataFrame, kind: str) -> DataFrame:
    """Records whose id doesn't begin with their kind."""
    return records.where(~F.startswith(F.col("id"), F.concat(F.col(kind), F.lit(":"))))


def wrong_role(child: DataFrame, key: str, parent: DataFrame, role: str, wanted: str) -> DataFrame:
    """Records whose reference is there but has another role than the wanted one."""
    p = parent.select(F.col("id").alias(key), F.col(role).alias("found"))
    return child.join(p, key).where(F.col("found") != wanted)


def wrong_hash(records: DataFrame, content: str, digest: str) -> DataFrame:
    return records.where(F.sha2(content, 256) != F.col(digest))


def bad_ranges(records: DataFrame) -> DataFrame:
    """Ranges that begin before line or column 1, or end before they begin."""
    return records.where("start_line < 1 or start_column < 1 or end_line < start_line or (end_line = start_line and end_column < start_column)")


def unsupported(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Resolved records without any evidence."""
    return records.where("status = 'resolved'").join(evidence.select(F.col(key).alias("id")), "id", "left_anti")


def wrong_summary(rows: DataFrame, group: str, summary: DataFrame, count: str) -> DataFrame:
    """Groups whose stated count isn't that of their rows, groups that are missing on a side included."""
    n = rows.groupBy(F.col(group).alias("id")).agg(F.count("*").alias("found"))
    both = n.join(summary.select(F.col(group).alias("id"), F.col(count).alias("stated")), "id", "full")
    return both.where(~F.coalesce("found", F.lit(0)).eqNullSafe(F.coalesce("stated", F.lit(0)))).select("id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("stated", F.lit(0)).alias("stated"))
