"""Degrees, reach metrics, bands and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import dealt


def degrees(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(node, fan_out, fan_in): resolved edges, not distinct peers. Nodes are dealt over n partitions, if given."""
    e = edges.where("status = 'resolved' and object is not null")
    ends = e.select(F.col("subject").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("object", F.lit(0), F.lit(1)))
    return dealt(ends, n, "node").groupBy("node").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def reach_counts(nodes: DataFrame, reach: DataFrame, n: int | None = None) -> DataFrame:
    """(node, roots): distinct roots that reach each node, zero included. Nodes are dealt over n partitions, if given."""
    counts = dealt(reach, n, "node").groupBy("node").agg(F.countDistinct("root").alias("roots"))
    return nodes.join(counts, "node", "left").na.fill(0, ["roots"])


def reach_of_roots(nodes: DataFrame, endpoints: DataFrame, handlers: DataFrame) -> DataFrame:
    """(node, endpoints, handlers, roots): how many endpoints and how many handlers reach each node, and their sum. endpoints and
    handlers are reach relations (root, node)."""
    both = endpoints.select("root", "node", F.lit(True).alias("end")).unionByName(handlers.select("root", "node", F.lit(False).alias("end")))
    n = both.groupBy("node").agg(F.countDistinct(F.when(F.col("end"), F.col("root"))).alias("endpoints"), F.countDistinct(F.when(~F.col("end"), F.col("root"))).alias("handlers"))
    return nodes.join(n, "node", "left").na.fill(0, ["endpoints", "handlers"]).withColumn("roots", F.col("endpoints") + F.col("handlers"))


def legend(metric: DataFrame, value: str) -> DataFrame:
    """p50, p75, p90 by nearest rank, 0 for an empty table: one row."""
    return metric.agg(*[F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0)).cast("long").alias(f"p{int(p * 100)}") for p in (0.5, 0.75, 0.9)])


def heat(metric: DataFrame, value: str) -> DataFrame:
    """The rows with ``band``: zero, low, medium, high or very_high by the table's own legend."""
    v = F.col(value)
    band = F.when(v == 0, "zero").when(v <= F.col("p50"), "low").when(v <= F.col("p75"), "medium").when(v <= F.col("p90"), "high").otherwise("very_high")
    return metric.crossJoin(F.broadcast(legend(metric, value))).withColumn("band", band).drop("p50", "p75", "p90")


def ownership(subjects: DataFrame, owners: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """(subject, state, n_owners). owners: (subject, owner, certain); modules: (module, complete), or none if the analysis
    has no modules, which makes every state unavailable. ownership_unknown if an owning edge is uncertain,
    otherwise by the number of owners; without one it is unknown if any module is incomplete."""
    o = owners.groupBy("subject").agg(F.countDistinct("owner").alias("n_owners"), F.every("certain").alias("certain"))
    s = subjects.join(o, "subject", "left").na.fill(0, ["n_owners"])
    if modules is None:
        return s.select("subject", F.lit("unavailable").alias("state"), F.lit(0).cast("long").alias("n_owners"))
    s = s.crossJoin(F.broadcast(modules.agg(F.count_if(~F.col("complete")).alias("gaps"))))  # one row
    n = F.col("n_owners")
    state = F.when(~F.coalesce("certain", F.lit(True)), "ownership_unknown").when(n == 1, "uniquely_owned").when(n > 1, "multiple_owners").when(F.col("gaps") > 0, "ownership_unknown").otherwise("not_declared_by_supported_modules")
    return s.select("subject", state.alias("state"), "n_owners")


def reachability(counts: DataFrame) -> DataFrame:
    """(node, roots, label): nodes that no supported root reaches are named."""
    return counts.withColumn("label", F.when(F.col("roots") == 0, "not_reached_from_supported_roots").otherwise("reached"))


#: Fixed order of certainty, the surest first.
CERTAINTY = ("resolved", "conditional_candidate", "ambiguous", "unknown")


def least_certain(rows: DataFrame, key: str, certainty: str, lists: list[str]) -> DataFrame:
    """One row a key: the least sure of its certainties, and the sorted unions of its lists."""
    order = F.array(*map(F.lit, CERTAINTY))
    united = [F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in lists]
    return rows.groupBy(key).agg(F.element_at(order, F.max(F.array_position(order, F.col(certainty))).cast("int")).alias(certainty), *united)


def architecture(nodes: DataFrame, edges: DataFrame, reach: DataFrame, n: int | None = None) -> DataFrame:
    """One row for each kind of node: how many, how many resolved edges leave and enter them, the
    largest fan-in, and how many no root reaches. Nodes are dealt over n partitions, if given."""
    d = nodes.join(degrees(edges, n), "node", "left").na.fill(0, ["fan_out", "fan_in"])
    d = reachability(reach_counts(d, reach, n))
    return d.groupBy("kind").agg(F.count("*").alias("nodes"), F.sum("fan_out").alias("fan_out"), F.sum("fan_in").alias("fan_in"), F.max("fan_in").alias("most_fan_in"), F.count_if(F.col("roots") == 0).alias("not_reached"))
