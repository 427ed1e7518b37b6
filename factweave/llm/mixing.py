"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash; a document's virtual finish time is its source's
cumulative size divided by the source's target. All sources are then served in order of finish time
until the total budget is used up. A source whose target is above its size is gone through again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST_REPEATS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the whole shared out by weight, a
    target stopping at ``most`` times the source's size and the excess going to the others by weight.

    The level at which each source is full, most * size / weight, orders the sources; with those
    below the common level full, the rest share what is left. One row per source, so small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    # the common level if the sources before this one are full and this one isn't
    w = w.withColumn("open", (F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))) / (F.col("all_weight") - (F.sum("weight").over(upto) - F.col("weight"))))
    w = w.withColumn("common", F.min(F.when(F.col("open") <= F.col("level"), F.struct("level", "open"))).over(every)["open"])
    return w.select("source", "source_size", F.when(F.col("level") <= F.coalesce("common", F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("common")).alias("target"))


#: Documents for each slice of the orders, about, and slices at least.
SLICE_ROWS, LEAST_SLICES = 10_000, 64


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", slices: int | None = None, keep_source: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken (= copies * size); with
    ``keep_source`` also source and key, a hash of the text.

    ``slices`` (if not given, in proportion to the documents) divides the order of each source, and
    then the order of finish times, so that running sums are taken within slices and joined to the
    slices' totals: no source, however large, passes through one task. Documents of equal hash are ordered by id; repeated rows are documents of their
    own. Size 0 (null or blank text) is never taken. Documents without an id are shuffled by their text; a null
    source is an ordinary value. Reruns agree, however the rows are partitioned.
    The document that would exceed the budget, and all after it, are left out. Other columns are
    ignored; an empty table gives no rows.
    """
    t = common.text_column(text)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(t, F.lit(common.WORD)).cast("long").alias("size"), F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(doc_id).cast("string"), F.md5(t)))).alias("shuffled"), F.xxhash64(t).alias("key"))
    d = common.checkpointed(d)  # texts are read once
    slices = slices or max(LEAST_SLICES, d.count() // SLICE_ROWS)
    d = d.withColumn("slice", F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * slices / F.lit(2**32)).cast("int"))
    per = d.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    by_source = targets(per.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    starts = (
        per.withColumn("start", before)
        .alias("p")
        .join(by_source.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")))
        .select("p.source", "p.slice", "p.start", "b.source_size", "b.target")
    )
    d, s = d.alias("d"), starts.alias("s")  # broadcast only if Spark finds it small
    run = Window.partitionBy("source", "slice").orderBy("shuffled", F.col("doc_id").asc_nulls_last(), "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice"))).select("d.doc_id", "d.source", "d.key", "d.size", "d.shuffled", "d.slice", "s.start", "s.source_size", "s.target")
    d = d.withColumn("ends", F.col("start") + F.sum("size").over(run))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy("source", "slice").orderBy("shuffled", F.col("doc_id").asc_nulls_last(), "size", "key")))
    # a pass of its source later, the same document finishes one source_size later
    served = (
        d.where("size > 0 and target > 0")
        .withColumn("again", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int"))))
        .withColumn("finish", (F.col("ends") + F.col("again") * F.col("source_size")) / F.col("target"))
        .where(F.col("again") < MOST_REPEATS)
        .withColumn("step", F.floor(F.col("finish") * slices).cast("long"))
        .select("source", "slice", "nth", "shuffled", "doc_id", "size", "again", "finish", "step")
    )
    steps = served.groupBy("step").agg(F.sum("size").alias("step_size")).withColumn("sent", F.sum("step_size").over(Window.orderBy("step")) - F.col("step_size"))
    budget = by_source.agg(F.sum("source_size").alias("budget"))
    turn = Window.partitionBy("step").orderBy("finish", "shuffled", F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "again", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = (
        served.join(steps, "step")
        .crossJoin(F.broadcast(budget))  # one row
        .withColumn("upto", F.col("sent") + F.sum("size").over(turn))
        .where("upto <= budget")
        .groupBy("source", "slice", "nth")
        .agg(F.count("*").alias("copies"))
    )
    k = kept.alias("k")
    source_too = ["d.source", "d.key"] if keep_source else []
    return (
        d.alias("d")
        .join(k, F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.slice") == F.col("k.slice")) & (F.col("d.nth") == F.col("k.nth")), "left")
        .select("d.doc_id", *source_too, "d.size", "d.source_size", "d.target", F.coalesce("k.copies", F.lit(0)).alias("copies"), (F.col("d.size") * F.coalesce("k.copies", F.lit(0))).alias("taken"))
    )
