"""Snapshots of facts: canonical JSON in, tables and CSV out, file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSERTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "subjectId", "predicate", "objectId", "status", "ruleId")] + [T.StructField("evidenceIds", T.ArrayType(T.StringType()))]
)
EVIDENCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "fileId", "role", "snippet", "contentHash")] + [T.StructField(n, T.IntegerType()) for n in ("startLine", "startColumn", "endLine", "endColumn")]
)
ENDPOINT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "httpMethod", "path")])
DIAGNOSTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "code", "severity", "message", "subjectId")] + [T.StructField("evidenceIds", T.ArrayType(T.StringType()))])
FAMILIES = {"assertions": ASSERTION, "evidence": EVIDENCE, "endpoints": ENDPOINT, "diagnostics": DIAGNOSTIC}
SNAPSHOT = T.StructType([T.StructField("schemaVersion", T.StringType()), T.StructField("resultState", T.StringType()), *[T.StructField(k, T.ArrayType(v)) for k, v in FAMILIES.items()]])


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; a malformed document fails the read. A family that is absent is null,
    which means unavailable, not empty."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("analysis", F.input_file_name())


def family(snapshots: DataFrame, name: str) -> DataFrame:
    return snapshots.select("analysis", F.explode(name).alias("r")).select("analysis", "r.*")


def availability(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("analysis", F.explode(F.create_map(*[x for k in FAMILIES for x in (F.lit(k), F.when(F.col(k).isNull(), "unavailable").otherwise("available"))])).alias("family", "state"))


def inventory(spark: SparkSession, path: str, max_bytes: int = 1 << 20, suffixes: tuple[str, ...] = (".ts",), excluded: tuple[str, ...] = ("node_modules", "dist", ".git")) -> DataFrame:
    """(path, bytes, hash, reason): every file below a folder; reason is null for those that are kept.
    Only the contents of files within max_bytes are read; others have no hash."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    by_name = F.when(F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))), "excluded_directory").when(~F.regexp_like("path", F.lit("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")), "unsupported_extension")
    large = f.where(F.col("length") > max_bytes).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("hash"), F.coalesce(by_name, F.lit("too_large")).alias("reason"))
    binary = F.when(F.contains("content", F.unhex(F.lit("00"))), "binary")
    small = f.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), F.coalesce(by_name, binary).alias("reason"))
    return small.unionByName(large)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with CRLF line ends; cells that a spreadsheet would take for formulas are neutralised."""
    safe = [F.when(F.regexp_like(F.col(c).cast("string"), F.lit(r"^[=+@-]")), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns]
    df.select(*safe).write.option("header", True).option("lineSep", "\r\n").csv(path)
