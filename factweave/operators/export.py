"""Wide rows for each endpoint, and what is published of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def endpoint_facts(endpoints: DataFrame, families: dict[str, DataFrame | None]) -> DataFrame:
    """One row an endpoint: for each family (endpoint, item, certain) how many items, the sorted
    distinct ones, and a state: unavailable (the family is None), none, complete, or partial if any
    item is uncertain. Each family is aggregated before it is joined."""
    out = endpoints
    for name, rows in families.items():
        if rows is None:
            out = out.withColumn(f"n_{name}", F.lit(None).cast("long")).withColumn(name, F.lit(None).cast("string")).withColumn(f"{name}_state", F.lit("unavailable"))
            continue
        own = rows.groupBy("endpoint").agg(F.count("*").alias(f"n_{name}"), F.array_join(F.array_sort(F.collect_set(F.col("item").cast("string"))), ",").alias(name), F.every("certain").alias("certain"))
        state = F.when(F.col("certain").isNull(), "none").when(F.col("certain"), "complete").otherwise("partial")
        out = out.join(own, "endpoint", "left").withColumn(f"{name}_state", state).drop("certain").na.fill(0, [f"n_{name}"]).na.fill("", [name])
    return out


def control_evidence(facts: DataFrame, version: int, since: dict[str, int]) -> DataFrame:
    """One row an endpoint in the columns of a version: a column that came later is left out."""
    return facts.select([c for c in facts.columns if since.get(c, 1) <= version])


def catalogue(endpoints: DataFrame, records: DataFrame) -> DataFrame:
    """Each endpoint with its records (endpoint, kind, name, detail) as one JSON list, ordered by kind,
    name and detail; an empty list for none."""
    own = records.groupBy("endpoint").agg(F.to_json(F.array_sort(F.collect_list(F.struct("kind", "name", "detail")))).alias("records"))
    return endpoints.join(own, "endpoint", "left").na.fill("[]", ["records"])


def canonical_json(df: DataFrame, family: str) -> DataFrame:
    """(family, record): each row as JSON with its fields in order of name, rows in order of that text."""
    return df.select(F.lit(family).alias("family"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("record")).orderBy("record")


def manifest(artifacts: DataFrame) -> DataFrame:
    """(reporter, kind, files, bytes, digest): what a bundle holds, artifacts (reporter, kind, path,
    content); the digest is of the sorted digests of its files."""
    a = artifacts.select("reporter", "kind", "path", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("hash"))
    return a.groupBy("reporter", "kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash"))), ","), 256).alias("digest"))


def stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (reporter, path) of the last publication that this one doesn't have."""
    return before.select("reporter", "path").distinct().join(now, ["reporter", "path"], "left_anti")
