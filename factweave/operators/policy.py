"""Rules with four outcomes (pass, fail, unknown, not_applicable), and their severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard_on_write(writes: Column, unsure_writes: Column, guards: Column, unsure_guards: Column, records: Column | None = None, unsure_globally: Column | None = None) -> Column:
    """Counts of resolved and unresolved writes and guards of a subject. Several records of one identity (``records``) say
    nothing; neither does an endpoint without a proven guard where it isn't known which guards hold everywhere."""
    unclear = unsure_guards > 0 if unsure_globally is None else (unsure_guards > 0) | unsure_globally
    several = F.lit(False) if records is None else records > 1
    return (
        F.when(several, "unknown").when((writes == 0) & (unsure_writes == 0), "not_applicable").when(writes == 0, "unknown").when(guards > 0, "pass").when(unclear, "unknown").otherwise("fail")
    )


def complete_write_trace(writes: Column, unsure_writes: Column, gaps: Column, write_verb: Column | None = None) -> Column:
    """A gap without any write says something only of an endpoint whose verb writes (of every one, if the verb isn't given)."""
    may_write = F.lit(True) if write_verb is None else write_verb
    return F.when((writes > 0) & (gaps > 0), "fail").when(writes > 0, "pass").when((unsure_writes > 0) | (may_write & (gaps > 0)), "unknown").otherwise("not_applicable")


def repository_access(records: Column, resolved: Column, unsure: Column) -> Column:
    """Of a controller: it isn't there, is there twice, accesses a repository, may access one, or doesn't."""
    return F.when(records == 0, "not_applicable").when(records > 1, "unknown").when(resolved > 0, "fail").when(unsure > 0, "unknown").otherwise("pass")


def activation(state: Column) -> Column:
    return F.when(state.isin("eager", "proven"), "pass").when(state == "cold", "fail").otherwise("unknown")


def dynamic_target(state: Column) -> Column:
    return F.when(state == "static", "pass").when(state == "dynamic", "fail").otherwise("unknown")


def local_handler(matches: Column, uncertain: Column, dynamic: Column) -> Column:
    return F.when(matches > 0, "pass").when(dynamic | (uncertain > 0), "unknown").otherwise("fail")


def authorization(requirements: Column, proven: Column) -> Column:
    return F.when(requirements == 0, "not_applicable").when(proven == requirements, "pass").otherwise("unknown")


def evaluated(features: DataFrame, rule: str, outcome: Column, severity: str = "error", on_unknown: str = "warning") -> DataFrame:
    """(rule, subject, outcome, severity, blocking): a failure, or an unknown, at severity error blocks."""
    level = F.when(F.col("outcome") == "unknown", on_unknown).otherwise(severity)
    rows = features.select(F.lit(rule).alias("rule"), "subject", outcome.alias("outcome")).withColumn("severity", level)
    return rows.withColumn("blocking", F.col("outcome").isin("fail", "unknown") & (F.col("severity") == "error"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("rule").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("pass", "fail", "unknown", "not_applicable")], F.count_if("blocking").alias("blocking"))


def new_diagnostics(baseline: Column, new: Column, ambiguous: Column) -> Column:
    """Whether there is a baseline, and how many new diagnostics of the least severity or more and how
    many ambiguous keys the comparison with it has."""
    return F.when(~baseline, "not_applicable").when(new > 0, "fail").when(ambiguous > 0, "unknown").otherwise("pass")


def declared_realm(producer: Column, state: Column, reason: Column) -> Column:
    """A correlation without a producer is no subject."""
    unsure = (state == "ambiguous") | F.coalesce(reason == "unsupported_identity", F.lit(False))
    return F.when(producer.isNull(), "not_applicable").when(state == "declared_realm_candidate", "pass").when(unsure, "unknown").otherwise("fail")


def unambiguous(producer: Column, state: Column) -> Column:
    return F.when(producer.isNull(), "not_applicable").when(state == "ambiguous", "fail").otherwise("pass")


def result_state(canceled: Column, fatal: Column, facts: Column, errors: Column, diagnostics: Column) -> Column:
    """Of an analysis: canceled, failed (fatal, or errors and nothing found), completed (no diagnostics), or completed with gaps."""
    return F.when(canceled, "canceled").when(fatal | ((facts == 0) & (errors > 0)), "failed").when(diagnostics == 0, "completed").otherwise("completed_with_gaps")


def mutation_class(writes: Column, unknown: Column, traced: Column | None = None, gaps: Column | None = None) -> Column:
    """write if any access writes; non_write only if nothing else can be: no access is unclear, the endpoint is traced and
    its trace has no gaps (of calls or of the database); else unknown."""
    whole = (F.lit(True) if traced is None else traced) & (F.lit(True) if gaps is None else gaps == 0)
    return F.when(writes > 0, "write").when((unknown > 0) | ~whole, "unknown").otherwise("non_write")
