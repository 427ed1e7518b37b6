"""Services, their endpoints and the brokers between them, before they are correlated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import stable_id

#: Fixed form of a service's namespace, its greatest length, and the least snapshot version.
NAMESPACE, LONGEST, LEAST_VERSION = r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$", 128, 3


def admission(services: DataFrame) -> DataFrame:
    """(service, namespace, id, state): admitted, or why not. services: service, namespace, version,
    completed, interactions."""
    n = services.groupBy("namespace").agg(F.count("*").alias("n"))
    state = (
        F.when(~F.regexp_like("namespace", F.lit(NAMESPACE)) | (F.length("namespace") > LONGEST), "invalid_namespace")
        .when(F.col("n") > 1, "repeated_namespace")
        .when(F.col("version") < LEAST_VERSION, "unsupported_version")
        .when(~F.col("completed"), "incomplete_analysis")
        .when(~F.col("interactions"), "interactions_not_analysed")
        .otherwise("admitted")
    )
    return services.join(n, "namespace").select("service", "namespace", stable_id("system_service", F.col("namespace")).alias("id"), state.alias("state"))


def eligibility(role: Column, kind: Column, technology: Column, name: Column, detail: Column, state: Column) -> Column:
    """Why a producer or consumer isn't correlated, null if it is. state: a producer's activation, a
    consumer's registration. A queue's consumer may take any job, so its queue alone must be known."""
    exact = name.isNotNull() & (detail.isNotNull() | (kind != "job_queue"))
    known = F.when(role == "producer", exact).otherwise(name.isNotNull() & ((kind == "job_queue") | exact))
    return (
        F.when((kind == "job_queue") & (technology != "bullmq"), F.concat(F.lit("queue technology "), technology, F.lit(" is not supported")))
        .when(~known, F.when(role == "producer", "target identity is not exact").otherwise("handler target identity is not exact"))
        .when((role == "producer") & ~state.isin("eager", "proven_activated"), F.concat(F.lit("activation is "), state))
        .when((role == "consumer") & (state != "proven_registered"), F.concat(F.lit("registration is "), state))
    )


def bound_realms(endpoints: DataFrame, bindings: DataFrame, realms: DataFrame) -> DataFrame:
    """(endpoint, state, realm): endpoints (endpoint, namespace, role, contract, record, transport) under
    topology bindings (binding, namespace, role, contract, record or null for any, realm) of realms
    (realm, transport): unbound, bound, several_bindings, missing_realm or transport_contradiction."""
    e, b = endpoints.alias("e"), bindings.alias("b")
    on = [F.col(f"e.{c}") == F.col(f"b.{c}") for c in ("namespace", "role", "contract")]
    met = e.join(b, [*on, F.col("b.record").isNull() | (F.col("b.record") == F.col("e.record"))], "left")
    one = met.groupBy("endpoint", "transport").agg(F.count("b.binding").alias("n"), F.min("b.realm").alias("realm"))
    r = one.join(realms.select("realm", F.col("transport").alias("of_realm"), F.lit(True).alias("known")), "realm", "left")
    state = F.when(F.col("n") == 0, "unbound").when(F.col("n") > 1, "several_bindings").when(F.col("known").isNull(), "missing_realm").when(F.col("transport") != F.col("of_realm"), "transport_contradiction").otherwise("bound")
    return r.select("endpoint", state.alias("state"), F.when(state == "bound", F.col("realm")).alias("realm"))


def unused_bindings(endpoints: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bindings that select no endpoint."""
    keys = ["namespace", "role", "contract"]
    any_ = bindings.where("record is null").join(endpoints, keys, "left_anti")
    exact = bindings.where("record is not null").join(endpoints, [*keys, "record"], "left_anti")
    return any_.select("binding").unionByName(exact.select("binding"))


def topology_issues(realms: DataFrame, bindings: DataFrame) -> DataFrame:
    """(code, item): repeated realm aliases, realms (realm, technology, transport, destination) whose parts
    don't go together, and bindings (binding, realm) to realms that aren't there."""
    queue = (F.col("technology") == "bullmq") & (F.col("transport") == "bullmq") & (F.col("destination") == "queue")
    message = (F.col("technology") == "nest_microservices") & (F.col("transport") != "bullmq")
    repeated = realms.groupBy("realm").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_alias").alias("code"), F.col("realm").cast("string").alias("item"))
    wrong = realms.where(~(queue | message)).select(F.lit("incompatible_realm").alias("code"), F.col("realm").cast("string").alias("item"))
    missing = bindings.join(realms.select("realm"), "realm", "left_anti").select(F.lit("missing_realm").alias("code"), F.col("binding").cast("string").alias("item"))
    return repeated.unionByName(wrong).unionByName(missing)
