"""Documents with one spelling: canonical JSON, the order of code units, and graph documents as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.text import json_string

from .iterate import cut


def code_units(text: Column) -> Column:
    """A key whose byte order is the order of UTF-16 code units. Strings alone compare by code point, which differs
    where a character beyond U+FFFF meets one of U+E000 to U+FFFF."""
    return F.encode(text, "UTF-16BE")


def canonical_json(value: Column, kind: T.DataType, indent: int = 2) -> Column:
    """The value as JSON text with the keys of every object, of structs and of maps, in the order of code units, and two
    spaces a level; without indent on one line. Lists keep their order. Whole numbers are written without a fraction."""
    return _written(value, kind, indent, 0)


def _enclosed(items: Column, left: str, right: str, indent: int, level: int) -> Column:
    inner, outer = ("\n" + " " * indent * (level + 1), "\n" + " " * indent * level) if indent else ("", "")
    return F.when(F.size(items) == 0, left + right).otherwise(F.concat(F.lit(left + inner), F.array_join(items, "," + inner), F.lit(outer + right)))


def _written(v: Column, kind: T.DataType, indent: int, level: int) -> Column:
    colon = '": ' if indent else '":'
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        items = [F.concat(F.lit('"' + f.name + colon), _written(v[f.name], f.dataType, indent, level + 1)) for f in fields]
        out = _enclosed(F.array(*items), "{", "}", indent, level)
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(v), lambda e: F.struct(code_units(e["key"]).alias("at"), e["key"].alias("key"), _written(e["value"], kind.valueType, indent, level + 1).alias("text"))))
        out = _enclosed(F.transform(pairs, lambda p: F.concat(json_string(p["key"]), F.lit(colon[1:]), p["text"])), "{", "}", indent, level)
    elif isinstance(kind, T.ArrayType):
        out = _enclosed(F.transform(v, lambda x: _written(x, kind.elementType, indent, level + 1)), "[", "]", indent, level)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
        out = F.when(whole, F.floor(v).cast("string")).otherwise(v.cast("string"))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = json_string(v)
    else:
        out = v.cast("string")
    return F.coalesce(out, F.lit("null"))


def in_order(rows: DataFrame, key: str, partitions: int = 0) -> DataFrame:
    """The rows with ``position``, from 1, in the whole table's order of ``key`` by code units; equal keys in the order of all
    columns. Ranges are sorted by themselves and written; a range's offset is the sum of those before it,
    so no task sees more than its range."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__at", *rows.columns]
    ranged = rows.withColumn("__at", code_units(F.col(key))).repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged.withColumn("__nth", F.row_number().over(Window.partitionBy("__range").orderBy(*order))))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # as many rows as partitions
    offsets = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    return ranged.join(F.broadcast(offsets), "__range").withColumn("position", F.col("__before") + F.col("__nth")).select(*rows.columns, "position")


#: Fixed order of impact, the strongest last.
IMPACT = ("none", "transitive", "direct")


def graph_elements(steps: DataFrame, facts: DataFrame, impacted: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each root's graph with overlays. steps: root, edge, source, target (null: a gap), relation, status,
    evidence (array); facts: node, label, kind; impacted: root, edge, impact (transitive or direct); rules: node, outcome.

    A step without a target leads to a gap of its own, named after its edge. A node has the strongest impact and all the evidence
    of the edges that touch it, of a gap only its own, and the rules' outcomes by number. nodes: root, node, label, kind,
    uncertainty, impact, evidence, failed, unknown; edges: root, edge, source, target, relation, uncertainty, impact, evidence."""
    gap = F.concat(F.lit("gap:"), F.col("edge"))
    e = steps.join(impacted, ["root", "edge"], "left").withColumn("impact", F.coalesce("impact", F.lit("none"))).withColumn("is_gap", F.col("target").isNull()).withColumn("target", F.coalesce("target", gap))
    edges = e.select("root", "edge", "source", "target", "relation", F.col("status").alias("uncertainty"), "impact", F.array_sort(F.array_distinct("evidence")).alias("evidence"))
    strength = F.array(*map(F.lit, IMPACT))
    ends = e.select("root", "edge", "relation", "status", "evidence", "impact", F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(False).alias("gap")), F.struct(F.col("target").alias("node"), F.col("is_gap").alias("gap")))).alias("x"))
    nodes = ends.groupBy("root", F.col("x.node").alias("node")).agg(
        F.max("x.gap").alias("gap"), F.max(F.array_position(strength, F.col("impact"))).alias("impact"), F.max(F.when(F.col("x.gap"), F.struct("status", "relation"))).alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence")
    )
    outcomes = rules.groupBy("node").agg(F.count_if(F.col("outcome") == "fail").alias("failed"), F.count_if(F.col("outcome") == "unknown").alias("unknown"))
    nodes = nodes.join(facts, "node", "left").join(outcomes, "node", "left").na.fill(0, ["failed", "unknown"])
    label = F.when(F.col("gap"), F.concat_ws(": ", "own.status", "own.relation")).otherwise(F.coalesce("label", "node"))
    return nodes.select(
        "root", "node", label.alias("label"), F.when(F.col("gap"), "gap").otherwise(F.coalesce("kind", F.lit("unknown"))).alias("kind"), F.when(F.col("gap"), F.col("own.status")).otherwise("resolved").alias("uncertainty"), F.element_at(strength, F.col("impact").cast("int")).alias("impact"), "evidence", "failed", "unknown"
    ), edges


def displayed(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, omitted) of a report of bounded size: the first nodes (node, parent, rank) by rank and name, without those
    whose parent isn't among them; of the edges (edge, source, target) with both ends shown the first by name; and how many nodes
    and edges are left out. Only the first max_nodes and max_edges rows of a sort are ever gathered."""
    top = cut(nodes.orderBy("rank", "node").limit(max_nodes))
    shown = top.alias("a").join(F.broadcast(top.select(F.col("node").alias("n"))).alias("b"), F.col("a.parent") == F.col("b.n"), "left").where("a.parent is null or b.n is not null").select("a.*")
    shown = cut(shown)
    names = lambda c: F.broadcast(shown.select(F.col("node").alias(c)))  # noqa: E731  max_nodes rows at most
    kept = cut(edges.join(names("source"), "source", "left_semi").join(names("target"), "target", "left_semi").orderBy("edge").limit(max_edges).select(*edges.columns))
    counts = [df.agg(F.count("*").alias(c)) for df, c in ((nodes, "all_nodes"), (shown, "nodes"), (edges, "all_edges"), (kept, "edges"))]  # one row each
    omitted = reduce(DataFrame.crossJoin, counts).select((F.col("all_nodes") - F.col("nodes")).alias("nodes"), (F.col("all_edges") - F.col("edges")).alias("edges"))
    return shown, kept, omitted
