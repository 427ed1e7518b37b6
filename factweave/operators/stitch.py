"""Correlating producers and consumers of several services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _offers(consumers: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many consumers a group offers, and the least and greatest of their realms."""
    return consumers.groupBy(*by).agg(F.count("consumer").alias(f"{name}_n"), F.min("realm").alias(f"{name}_low"), F.max("realm").alias(f"{name}_high"))


def _jobs(producers: DataFrame, consumers: DataFrame) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    return tuple(df if "job" in df.columns else df.withColumn("job", none) for df in (producers, consumers))


def correlate(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(producer, state, reason, candidates): producers (producer, contract, realm, eligible, single)
    against consumers (consumer, contract, realm), a null realm being undeclared. Both may have a ``job`` (the contract then is the
    queue): a consumer without one takes every job of its contract.

    In this order: not eligible -> unmatched; no candidate -> unmatched; several declared realms ->
    unmatched; several candidates where one is asked for -> ambiguous; all in the producer's realm ->
    declared_realm_candidate; else target_only_candidate."""
    producers, consumers = _jobs(producers, consumers)
    # consumers are counted before the join: no row for each pair of a producer and a candidate
    exact, any_ = consumers.where("job is not null"), consumers.where("job is null")
    g = (
        producers.select("producer", F.when(F.col("eligible"), F.col("contract")).alias("contract"), "job", "realm", "eligible", "single")
        .join(_offers(exact, ["contract", "job"], "e"), ["contract", "job"], "left")
        .join(_offers(any_, ["contract"], "a"), "contract", "left")
        .join(exact.groupBy("contract", "job", "realm").agg(F.count("consumer").alias("e_here")), ["contract", "job", "realm"], "left")
        .join(any_.groupBy("contract", "realm").agg(F.count("consumer").alias("a_here")), ["contract", "realm"], "left")
        .na.fill(0, ["e_n", "a_n", "e_here", "a_here"])
        .withColumn("candidates", F.col("e_n") + F.col("a_n"))
        .withColumn("elsewhere", F.col("candidates") - F.col("e_here") - F.col("a_here"))
        .withColumn("low", F.least("e_low", "a_low")).withColumn("high", F.greatest("e_high", "a_high"))
    )
    several = F.coalesce((F.col("low") != F.col("high")) | (F.col("low").isNotNull() & F.col("realm").isNotNull() & (F.col("elsewhere") == F.col("candidates"))), F.lit(False))
    reason = F.when(~F.col("eligible"), "unsupported_identity").when(F.col("candidates") == 0, "producer_only").when(several, "realm_mismatch").when((F.col("candidates") > 1) & F.col("single"), "multiple_consumers")
    state = F.when(reason == "multiple_consumers", "ambiguous").when(reason.isNotNull(), "unmatched").when(F.col("elsewhere") == 0, "declared_realm_candidate").otherwise("target_only_candidate")
    return g.select("producer", state.alias("state"), reason.alias("reason"), "candidates")


def leftovers(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Consumers that no eligible producer has as a candidate."""
    producers, consumers = _jobs(producers.where("eligible"), consumers)
    exact = consumers.where("job is not null").join(producers.select("contract", "job").distinct(), ["contract", "job"], "left_anti")
    any_ = consumers.where("job is null").join(producers.select("contract").distinct(), "contract", "left_anti")
    return exact.select("consumer").unionByName(any_.select("consumer")).withColumn("reason", F.lit("consumer_only"))


def display_selection(nodes: DataFrame, limit: int) -> DataFrame:
    """The first nodes by rank and name, without those whose parent isn't among them."""
    top = nodes.orderBy("rank", "node").limit(limit)
    return top.alias("a").join(top.select(F.col("node").alias("n")).alias("b"), F.col("a.parent") == F.col("b.n"), "left").where("a.parent is null or b.n is not null").select("a.node", "a.parent", "a.rank")


def system_paths(reached: DataFrame, producers: DataFrame, correlated: DataFrame, consumers: DataFrame, effects: DataFrame) -> DataFrame:
    """(root, contract, realm, state, producers, consumer, effect): the conditional paths from a root
    through the producers it reaches (root, producer) to a correlated consumer's effects (consumer,
    effect). Producers alike in root, contract, realm and state share their paths and are counted;
    unmatched and ambiguous ones have none."""
    follows = correlated.where(F.col("state").isin("declared_realm_candidate", "target_only_candidate")).select("producer", "state")
    alike = (
        reached.select("root", "producer").distinct()
        .join(producers.select("producer", "contract", "realm"), "producer")
        .join(follows, "producer")
        .groupBy("root", "contract", "realm", "state").agg(F.count("*").alias("producers"))
    )
    offers = consumers.select("consumer", "contract").join(effects.select("consumer", "effect").distinct(), "consumer")
    return alike.join(offers, "contract").select("root", "contract", "realm", "state", "producers", "consumer", "effect")


def stitched(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(producer, consumer, state, reason, candidates): one row a producer, and one a consumer that no
    producer has as a candidate. producers (producer, kind, contract, realm, eligible, single), consumers
    (consumer, kind, contract, realm, eligible).

    Only eligible consumers are candidates. A producer without one is a target_mismatch if an
    eligible consumer of its kind exists, else producer_only. A candidate is consumed even if its
    producer ends up unmatched or ambiguous. What is left over is consumer_only, or unsupported_identity
    if it isn't eligible."""
    able = consumers.where("eligible")
    kinds = able.select("kind").distinct().withColumn("offered", F.lit(True))
    p = correlate(producers, able).join(producers.select("producer", "kind"), "producer").join(kinds, "kind", "left")
    reason = F.when((F.col("reason") == "producer_only") & F.col("offered").isNotNull(), "target_mismatch").otherwise(F.col("reason"))
    left = leftovers(producers, able).unionByName(consumers.where("not eligible").select("consumer", F.lit("unsupported_identity").alias("reason")))
    none = F.lit(None)
    of_consumers = left.select(none.cast(dict(producers.dtypes)["producer"]).alias("producer"), "consumer", F.lit("unmatched").alias("state"), "reason", F.lit(0).cast("long").alias("candidates"))
    return p.select("producer", none.cast(dict(consumers.dtypes)["consumer"]).alias("consumer"), "state", reason.alias("reason"), F.col("candidates").cast("long")).unionByName(of_consumers)
