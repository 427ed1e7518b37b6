"""Greedy scenes under a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def _walked(edges: DataFrame, max_nodes: int, max_edges: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """The edges that greedy_scene takes, with ``position`` and their columns; and for each root a row without an edge_id,
    whose ``n`` is how many edges it has."""
    kept = ["edge_id", *carry]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, nodes, taken, n = None, set(), 0, 0
        for b in batches:
            out = []  # (root, row of the batch, position, n)
            for i, (own, subject, object_) in enumerate(zip(*(b[c].to_pylist() for c in ("root", "subject", "object")), strict=True)):
                if own != root or n == 0:
                    if n:
                        out.append((root, None, None, n))
                    root, nodes, taken, n = own, {own}, 0, 0
                n += 1
                if taken < max_edges and len(nodes) + len(new := {subject, object_} - nodes) <= max_nodes:
                    nodes |= new
                    taken += 1
                    out.append((own, i, taken, None))
            yield batch(out, lambda c, at: b[c].take(at), b.schema)  # noqa: B023
        if n:
            yield batch([(root, None, None, n)], lambda c, at: pa.nulls(1, b.schema.field(c).type), b.schema)

    def batch(out: list[tuple], column, schema: pa.Schema) -> pa.RecordBatch:
        at = pa.array([r[1] for r in out], pa.int64())
        arrays = [pa.array([r[0] for r in out], schema.field("root").type), *[column(c, at) for c in kept], pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["root", *kept, "position", "n"])

    columns = list(dict.fromkeys(["root", "edge_id", "subject", "object", *carry]))
    ordered = edges.select(*columns, "rank").repartition("root").sortWithinPartitions("root", "rank", "edge_id").select(*columns)
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return ordered.mapInArrow(walk, ", ".join(f"{c} {kinds[c]}" for c in ["root", *kept]) + ", position long, n long")


def greedy_scene(edges: DataFrame, max_nodes: int, max_edges: int) -> DataFrame:
    """(root, edge_id, position): each root's edges by rank and id; the root is in the scene, an edge is taken if its new ends
    fit the node budget, skipped otherwise, until the edge budget is reached. What is taken depends
    on what was, so a root's edges are walked in order; they stream by, and only the scene's nodes
    are held."""
    return _walked(edges, max_nodes, max_edges).where("n is null").drop("n")


def scene(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int, max_evidence: int, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A root's scene: (edges, nodes, evidence, omitted). nodes: root, node, evidence (array); edges: root, edge_id, subject,
    object, rank, evidence; extra: root, id of evidence that belongs to the scene as a whole.

    The evidence budget has two phases: the first evidence of each node and edge, by id, then all other evidence of
    theirs, by id, until the budget is used up. Each element keeps what the scene keeps. omitted: how many nodes, edges and
    pieces of evidence a root has beyond its scene. The edges are walked once and the nodes met once, by root; what is
    written of either is the scene, bounded by its budgets, and the counts of the root."""
    c = F.col
    walked = cut(_walked(edges, max_nodes, max_edges, ("subject", "object", "evidence")))
    own = walked.where("n is null")
    ends = F.flatten(F.collect_list(F.when(c("n").isNull(), F.array("subject", "object"))))
    roots = walked.groupBy("root").agg(F.max("n").alias("all_edges"), F.count("position").alias("edges"), F.array_distinct(ends).alias("ends"))
    here = (c("node") == c("root")) | F.array_contains("ends", c("node"))
    met = nodes.join(roots, "root", "left").groupBy("root")
    met = cut(met.agg(F.count("*").alias("all_nodes"), F.first("all_edges").alias("all_edges"), F.first("edges").alias("edges"), F.collect_list(F.when(here, F.struct("node", "evidence"))).alias("held")))
    held = met.select("root", F.explode("held").alias("h")).select("root", "h.*")
    parts = held.select("root", "evidence").unionByName(own.select("root", "evidence"))
    cited = parts.select("root", F.posexplode("evidence").alias("nth", "id")).select("root", "id", c("nth").cast("int").alias("nth"))
    if extra is not None:
        cited = cited.unionByName(extra.select("root", "id", F.lit(1).alias("nth")))
    cited = cited.repartition("root").groupBy("root", "id").agg((F.min("nth") > 0).alias("optional"))  # dealt once, for the order too
    placed = cited.withColumn("position", F.row_number().over(Window.partitionBy("root").orderBy("optional", "id")))
    kept = placed.where(c("position") <= max_evidence)
    # a root's kept evidence is bounded by the budget
    by_root = kept.groupBy("root").agg(F.collect_set("id").alias("kept"))
    trimmed = F.array_sort(F.array_intersect("evidence", F.coalesce("kept", F.array().cast("array<string>")))).alias("evidence")
    counts = placed.groupBy("root").agg(F.count("*").alias("all_evidence"), F.count_if(c("position") <= max_evidence).alias("evidence"))
    omitted = met.withColumn("nodes", F.size("held")).drop("held").join(counts, "root", "left")
    less = [(F.coalesce(f"all_{x}", F.lit(0)) - F.coalesce(x, F.lit(0))).alias(x) for x in ("nodes", "edges", "evidence")]
    return (
        own.join(by_root, "root", "left").select("root", "edge_id", "position", trimmed),
        held.join(by_root, "root", "left").select("root", "node", trimmed),
        kept.select("root", "id", "position"),
        omitted.select("root", *less),
    )
