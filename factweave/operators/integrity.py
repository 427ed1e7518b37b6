"""Whether snapshots hold together: one row for each issue, generated from the catalogue of families.

families: family name to its records, and ``header`` (see sources/catalogue). All references of all families are one relation, joined
once with all records' ids. Issues are (analysis, code, id, path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.catalogue import FAMILIES, PREDICATES, REFERENCES, VALUES

from .iterate import cut, dealt, parts

c = F.col


def _issue(rows: DataFrame, code: str, path: str | Column | None = None, id_: str = "id") -> DataFrame:
    where = path if isinstance(path, Column) else F.lit(path)
    return rows.select("analysis", F.lit(code).alias("code"), c(id_).alias("id"), where.cast("string").alias("path"))


def records(families: dict[str, DataFrame]) -> DataFrame:
    """(analysis, id, kind, content) of all families."""
    rows = [families[f].select("analysis", "id", F.lit(kind).alias("kind"), F.xxhash64(F.to_json(F.struct(*[x for x in families[f].columns if x != "analysis"]))).alias("content")) for f, (kind, _) in FAMILIES.items() if f in families]
    return reduce(DataFrame.unionByName, rows)


def _referred(family: str, field: str) -> Column:
    """array<struct<path, reference, listed>> of one field."""
    whole, _, inner = field.partition("[].")
    if inner:
        return F.transform(c(whole), lambda x: F.struct(F.lit(f"{whole}.{inner}").alias("path"), x[inner].alias("reference"), F.lit(False).alias("listed")))
    path = field.removesuffix("[]")
    if path.startswith("declaredType."):
        values = F.expr(f"try_variant_get(declaredType, '$.{path.split('.')[1]}', 'array<string>')")
    else:
        values = c(path) if field.endswith("[]") else F.array(c(path))
    return F.transform(values, lambda x: F.struct(F.lit(path).alias("path"), x.alias("reference"), F.lit(field.endswith("[]")).alias("listed")))


def _wanted(referred: Column, kind: str | None) -> Column:
    return F.transform(F.coalesce(referred, F.array()), lambda x: F.struct(x["path"].alias("path"), x["reference"].alias("reference"), F.lit(kind).cast("string").alias("wanted"), x["listed"].alias("listed")))


def references(families: dict[str, DataFrame]) -> DataFrame:
    """(analysis, id, path, reference, wanted, listed): every reference that isn't null; wanted is the kind that it has to be of."""
    out = []
    for family, fields in REFERENCES.items():
        if family not in families:
            continue
        parts = [_wanted(_referred(family, field), kind) for field, kind in fields.items()]
        out.append(families[family].select("analysis", "id", F.explode(F.concat(*parts)).alias("r")).select("analysis", "id", "r.*"))
    kinds = F.create_map(*[F.lit(x) for p, (a, b) in PREDICATES.items() for x in (p, f"{a}|{b}")])
    a = families["assertions"].withColumn("ends", F.split(F.element_at(kinds, c("predicate")), r"\|"))
    for k, field in enumerate(("subjectId", "objectId")):
        out.append(a.select("analysis", "id", F.lit(field).alias("path"), c(field).alias("reference"), F.get("ends", F.lit(k)).alias("wanted"), F.lit(False).alias("listed")))
    if "interactionHandlerBranchEffects" in families:
        kind = F.when(c("kind") == "calls_method", "method").when(c("kind") == "initiates_interaction", "interaction").when(c("kind") == "accesses_resource", "resource_access").otherwise("table")
        out.append(families["interactionHandlerBranchEffects"].select("analysis", "id", F.lit("targetId").alias("path"), c("targetId").alias("reference"), kind.alias("wanted"), F.lit(False).alias("listed")))
    return reduce(DataFrame.unionByName, out).where("reference is not null")


def identity_issues(every: DataFrame, n: int | None = None) -> list[DataFrame]:
    """Ids of the wrong prefix, and ids that several records of a snapshot hold, with the same content or not."""
    held = dealt(every, n, "analysis", "id").groupBy("analysis", "id").agg(F.count("*").alias("n"), F.countDistinct("kind", "content").alias("kinds")).where("n > 1")
    return [_issue(every.where(~F.startswith("id", F.concat("kind", F.lit(":")))), "RECORD_ID_KIND_MISMATCH"), _issue(held.where("kinds = 1"), "DUPLICATE_RECORD_ID"), _issue(held.where("kinds > 1"), "STABLE_ID_COLLISION")]


def reference_issues(every: DataFrame, refs: DataFrame, n: int | None = None) -> list[DataFrame]:
    """References to nothing, to a record of another kind, and repeated in one list."""
    known = dealt(every.withColumnRenamed("id", "reference"), n, "analysis", "reference").groupBy("analysis", "reference").agg(F.min("kind").alias("found"))
    met = dealt(refs, n, "analysis", "reference").join(known, ["analysis", "reference"], "left")
    again = dealt(refs.where("listed"), n, "analysis", "id").groupBy("analysis", "id", "path", "reference").agg(F.count("*").alias("n")).where("n > 1")
    return [_issue(met.where("found is null"), "MISSING_REFERENCE", c("path")), _issue(met.where("wanted is not null and found <> wanted"), "REFERENCE_KIND_MISMATCH", c("path")), _issue(again, "DUPLICATE_REFERENCE", c("path"))]


def _looked_up(rows: DataFrame, key: str, records_: DataFrame, *columns: str) -> DataFrame:
    """rows with the columns of the record that ``key`` names, as x_<column>; rows without one are left out."""
    return rows.join(records_.select("analysis", c("id").alias(key), *[c(x).alias(f"x_{x}") for x in columns]), ["analysis", key])


def _role_issues(f: dict[str, DataFrame], refs: DataFrame) -> list[DataFrame]:
    out = []
    for family, role in (("guards", "guard"), ("entities", "entity"), ("modules", "module")):
        if family in f:
            out.append(_issue(_looked_up(f[family], "classId", f["classes"], "roles").where(~F.array_contains("x_roles", role)), "CLASS_ROLE_MISMATCH", "classId"))
    wanted = F.when(c("path") == "declarationEvidenceId", "declaration").when(c("path") == "callPath.callEvidenceId", "call_site")
    cited = _looked_up(refs.withColumn("role", wanted).where("role is not null"), "reference", f["evidence"], "role")
    return [*out, _issue(cited.where("x_role <> role"), "EVIDENCE_ROLE_MISMATCH", c("path"))]


def _assertion_issues(f: dict[str, DataFrame]) -> list[DataFrame]:
    a = f["assertions"]
    e = _looked_up(f["evidence"], "fileId", f["sourceFiles"], "contentHash")
    ordered = F.struct("startLine", "startColumn") <= F.struct("endLine", "endColumn")
    return [
        _issue(a.where("objectId is null and status in ('resolved', 'ambiguous')"), "MISSING_ASSERTION_TARGET", "objectId"),
        _issue(a.where((c("status") == "resolved") & (F.size("evidenceIds") == 0)), "RESOLVED_ASSERTION_WITHOUT_EVIDENCE", "evidenceIds"),
        _issue(e.where("contentHash <> x_contentHash"), "EVIDENCE_HASH_MISMATCH", "contentHash"),
        _issue(f["evidence"].where(~ordered), "INVALID_EVIDENCE_RANGE"),
    ]


def _influence_issues(f: dict[str, DataFrame]) -> list[DataFrame]:
    i = f["columnInfluences"]
    origin = f["requestFieldOrigins"].join(f["requestParameters"].select("analysis", c("id").alias("requestParameterId"), c("methodId").alias("begins")), ["analysis", "requestParameterId"])
    i = i.join(origin.select("analysis", c("id").alias("originId"), "begins"), ["analysis", "originId"], "left")
    steps = i.select("analysis", "id", "methodId", "begins", F.size("callPath").alias("n"), F.posexplode("callPath").alias("nth", "s"))
    before = F.lag("s.calleeMethodId").over(Window.partitionBy("analysis", "id").orderBy("nth"))
    steps = steps.withColumn("expected", F.when(c("nth") == 0, c("begins")).otherwise(before))
    broken = ~c("expected").eqNullSafe(c("s.callerMethodId")) | ((c("nth") == c("n") - 1) & (c("s.calleeMethodId") != c("methodId")))
    a = _looked_up(i, "assertionId", f["assertions"], "subjectId", "objectId", "predicate", "evidenceIds")
    wrong = (c("x_subjectId") != c("originId")) | ~c("x_objectId").eqNullSafe(c("columnId")) | (c("x_predicate") != "REQUEST_FIELD_MAY_FLOW_TO_COLUMN") | ~F.array_contains("x_evidenceIds", c("sinkEvidenceId")) | ~F.array_contains("x_evidenceIds", c("operationEvidenceId")) | F.exists("callPath", lambda s: ~F.array_contains("x_evidenceIds", s["callEvidenceId"]))
    code = "COLUMN_INFLUENCE_ASSERTION_MISMATCH"
    return [_issue(i.where((F.size("callPath") == 0) & ~c("begins").eqNullSafe(c("methodId"))), code, "callPath"), _issue(steps.where(broken), code, F.concat(F.lit("callPath."), c("nth").cast("string"))), _issue(a.where(wrong), code, "assertionId")]


def _guard_issues(f: dict[str, DataFrame]) -> list[DataFrame]:
    r, h = f["globalGuardRegistrations"], f["header"]
    a = _looked_up(r, "assertionId", f["assertions"], "subjectId", "objectId", "predicate", "status", "evidenceIds")
    predicate = F.when(c("kind") == "bootstrap_use_global_guards", "APPLICATION_REGISTERS_GLOBAL_GUARD").otherwise("MODULE_REGISTERS_GLOBAL_GUARD")
    wrong = (c("x_subjectId") != c("moduleId")) | ~c("x_objectId").eqNullSafe(c("guardId")) | (c("x_predicate") != predicate) | (c("x_status") != "resolved") | ~F.array_contains("x_evidenceIds", c("registrationEvidenceId"))
    by = Window.partitionBy("analysis").orderBy("order", "id")  # a snapshot registers few guards
    placed = r.withColumn("expected", F.row_number().over(by) - 1).withColumn("again", F.row_number().over(Window.partitionBy("analysis", "order").orderBy("id")))
    counted = r.groupBy("analysis").agg(F.count("*").alias("registrations"))
    gaps = f["modules"].where("metadataCompleteness = 'incomplete'").select("analysis").union(f["diagnostics"].where(c("code").isin("NEST_MODULE_METADATA_UNRESOLVED", "NEST_GLOBAL_GUARD_UNRESOLVED", "NEST_BOOTSTRAP_GUARD_UNRESOLVED")).select("analysis")).distinct().withColumn("gaps", F.lit(True))
    h = h.where("globalGuardAnalysis is not null").join(counted, "analysis", "left").join(gaps, "analysis", "left").withColumn("id", F.lit(None).cast("string"))
    complete, state = c("globalGuardAnalysis.completeness"), c("globalGuardAnalysis.state")
    expected = F.when(c("registrations") > 0, "declared").when(complete == "complete", "none_proven").otherwise("unknown")
    return [
        _issue(a.where(wrong), "GLOBAL_GUARD_REGISTRATION_MISMATCH", "assertionId"), _issue(placed.where("expected <> order"), "GLOBAL_GUARD_REGISTRATION_MISMATCH", "order"), _issue(placed.where("again > 1"), "DUPLICATE_REFERENCE", "order"),
        _issue(h.where(c("gaps") & (complete != "incomplete")), "GLOBAL_GUARD_STATE_MISMATCH", "globalGuardAnalysis.completeness"), _issue(h.where(state != expected), "GLOBAL_GUARD_STATE_MISMATCH", "globalGuardAnalysis.state"),
    ]


#: Fixed: what a snapshot of this shape can represent.
INTERACTION_KINDS = ("in_process_event", "job_queue", "microservice_message", "outbound_http")


def _interaction_issues(f: dict[str, DataFrame]) -> list[DataFrame]:
    apps, sent, handlers, a = f["applications"], f["interactions"], f["interactionHandlers"], f["assertions"]
    valid = F.when(c("kind") == "http", (c("transportState") == "not_applicable") & c("transport").isNull()).when(c("transportState") == "resolved", c("transport").isNotNull()).otherwise((c("transportState") == "unknown") & c("transport").isNull())
    out = [_issue(apps.where((c("rootResolution") == "resolved") != c("rootModuleId").isNotNull()), "APPLICATION_STATE_MISMATCH", "rootResolution"), _issue(apps.where(~valid), "APPLICATION_STATE_MISMATCH", "transportState")]
    code, sure = "INTERACTION_ASSERTION_MISMATCH", c("status") == "resolved"
    of = lambda p: a.where(c("predicate") == p)
    root = _looked_up(of("APPLICATION_USES_ROOT_MODULE").withColumnRenamed("subjectId", "application"), "application", apps, "rootResolution", "rootModuleId", "bootstrapEvidenceId")
    out.append(_issue(root.where(~sure | (c("x_rootResolution") != "resolved") | ~c("x_rootModuleId").eqNullSafe(c("objectId")) | ~F.array_contains("evidenceIds", c("x_bootstrapEvidenceId"))), code))
    begun = _looked_up(of("METHOD_INITIATES_INTERACTION").withColumnRenamed("objectId", "interaction"), "interaction", sent, "sourceMethodId", "evidenceIds")
    out.append(_issue(begun.where(~sure | (c("x_sourceMethodId") != c("subjectId")) | ~F.arrays_overlap("x_evidenceIds", "evidenceIds")), code))
    made = _looked_up(of("HANDLER_IMPLEMENTED_BY").withColumnRenamed("subjectId", "handler"), "handler", handlers, "methodId", "handlerEvidenceId")
    out.append(_issue(made.where(~sure | ~c("x_methodId").eqNullSafe(c("objectId")) | ~F.array_contains("evidenceIds", c("x_handlerEvidenceId"))), code))
    met = _looked_up(of("INTERACTION_MATCHES_LOCAL_HANDLER").withColumnRenamed("subjectId", "interaction"), "interaction", sent, "kind", "applicationId", "target")
    met = met.withColumnsRenamed({"x_kind": "i_kind", "x_applicationId": "i_app", "x_target": "i_target"}).withColumnRenamed("objectId", "handler")
    met = _looked_up(met, "handler", handlers, "kind", "applicationId", "target")
    mode = F.expr("try_variant_get(i_target, '$.mode', 'string')")
    apart = F.when(c("i_kind") == "microservice_message", ~F.coalesce(c("i_app") == c("x_applicationId"), F.lit(False))).otherwise(F.coalesce(c("i_app") != c("x_applicationId"), F.lit(False)))
    status = ~sure & ~((c("status") == "ambiguous") & (c("i_kind") == "microservice_message") & F.coalesce(mode == "request_response", F.lit(False)))
    plain = F.expr("try_variant_get(x_target, '$.pattern', 'variant')").isNull() & (c("i_kind") == "in_process_event")
    out.append(_issue(met.where(status | (c("i_kind") != c("x_kind")) | apart | (plain & (F.to_json("i_target") != F.to_json("x_target")))), code))
    for rows, p, key, wanted, path in ((apps.where("rootResolution = 'resolved'"), "APPLICATION_USES_ROOT_MODULE", "subjectId", True, "rootModuleId"), (sent, "METHOD_INITIATES_INTERACTION", "objectId", True, None), (handlers, "HANDLER_IMPLEMENTED_BY", "subjectId", True, None)):
        known = of(p).where(sure | F.lit(not wanted)).select("analysis", c(key).alias("id")).distinct()
        out.append(_issue(rows.join(known, ["analysis", "id"], "left_anti"), code, path))
    h = f["header"].where("interactionAnalysis is not null").select("analysis", F.lit(None).cast("string").alias("id"), "interactionAnalysis.*")
    capability = "INTERACTION_CAPABILITY_MISMATCH"
    known = F.array(*map(F.lit, INTERACTION_KINDS))
    out += [
        _issue(h.where(F.array_sort("schemaKinds") != known), capability, "interactionAnalysis.schemaKinds"), _issue(h.where(F.size(F.array_except("supportedKinds", known)) > 0), capability, "interactionAnalysis.supportedKinds"),
        _issue(h.where(F.size(F.array_except("enabledKinds", "supportedKinds")) > 0), capability, "interactionAnalysis.enabledKinds"), _issue(h.where((c("state") == "not_run") & (F.size("enabledKinds") > 0)), capability, "interactionAnalysis.state"),
    ]
    return out


def _relationship_issues(f: dict[str, DataFrame]) -> list[DataFrame]:
    a, out = f["assertions"], []
    e = _looked_up(f["authorizationEnforcements"].withColumnRenamed("endpointId", "endpoint"), "metadataId", f["authorizationMetadata"], "endpointId")
    code = "AUTHORIZATION_RELATIONSHIP_MISMATCH"
    out.append(_issue(e.where("endpoint <> x_endpointId"), code, "endpointId"))
    g = _looked_up(f["authorizationEnforcements"].where("guardId is not null"), "guardAssertionId", a, "subjectId", "objectId", "predicate", "status")
    g = g.join(f["globalGuardRegistrations"].select("analysis", c("assertionId").alias("guardAssertionId"), F.lit(True).alias("everywhere")).distinct(), ["analysis", "guardAssertionId"], "left")
    own = (c("x_predicate") == "ENDPOINT_USES_GUARD") & (c("x_subjectId") == c("endpointId"))
    out.append(_issue(g.where((~own & c("everywhere").isNull()) | ~c("x_objectId").eqNullSafe(c("guardId")) | (c("x_status") != "resolved")), code, "guardAssertionId"))
    out.append(_issue(f["authorizationMetadata"].join(f["authorizationEnforcements"].select("analysis", c("metadataId").alias("id")).distinct(), ["analysis", "id"], "left_anti"), code))
    code, access = "RESOURCE_ACCESS_RELATIONSHIP_MISMATCH", f["resourceAccesses"]
    to = a.where("predicate = 'METHOD_ACCESSES_RESOURCE' and objectId is not null")
    met = _looked_up(to.withColumnRenamed("objectId", "access"), "access", access, "sourceMethodId", "ruleId", "evidenceIds")
    out.append(_issue(met.where((c("status") != "resolved") | (c("subjectId") != c("x_sourceMethodId")) | (c("ruleId") != c("x_ruleId")) | ~F.arrays_overlap("x_evidenceIds", "evidenceIds")), code))
    out.append(_issue(access.join(to.select("analysis", c("objectId").alias("id")).distinct(), ["analysis", "id"], "left_anti"), code))
    h = f["header"].where("resourceAccessAnalysis is not null").select("analysis", F.lit(None).cast("string").alias("id"), "resourceAccessAnalysis.*")
    whole = F.array(*map(F.lit, ("cache_manager", "ioredis", "redlock")))
    out.append(_issue(h.where((F.array_sort("supportedTechnologies") != whole) | (F.array_sort("enabledTechnologies") != whole)), code, "resourceAccessAnalysis"))
    code, s = "CRITICAL_SECTION_RELATIONSHIP_MISMATCH", f["criticalSections"].withColumnRenamed("sourceMethodId", "method")
    locks = _looked_up(s.select("analysis", "id", "method", F.explode("lockResourceAccessIds").alias("lock")), "lock", access, "sourceMethodId", "technology", "resourceKind", "operation")
    out.append(_issue(locks.where("x_sourceMethodId <> method or x_technology <> 'redlock' or x_resourceKind <> 'distributed_lock' or x_operation <> 'critical_section'"), code, "lockResourceAccessIds"))
    effects = _looked_up(s.select("analysis", "id", "method", F.explode("effectAssertionIds").alias("effect")), "effect", a, "subjectId", "predicate")
    allowed = ("METHOD_CALLS_METHOD", "METHOD_READS_TABLE", "METHOD_WRITES_TABLE", "METHOD_ACCESSES_RESOURCE", "METHOD_INITIATES_INTERACTION")
    out.append(_issue(effects.where((c("x_subjectId") != c("method")) | ~c("x_predicate").isin(*allowed)), code, "effectAssertionIds"))
    return out


def issues(families: dict[str, DataFrame]) -> DataFrame:
    """(analysis, code, id, path): every issue of every snapshot; one issue for each record, code and path. Families that
    aren't given are unavailable, and what would be checked against them isn't."""
    given = {k: v for k, v in families.items() if v is not None}
    every, refs = cut(records(given)), cut(references(given))
    n = parts(every, refs)
    found = [*identity_issues(every, n), *reference_issues(every, refs, n), *_role_issues(given, refs), *_assertion_issues(given)]
    for (family, field), values in VALUES.items():
        if family in given:
            found.append(_issue(given[family].where(~c(field).isin(*values)), "SCHEMA_INVALID", field))
    for needs, check in (
        (("columnInfluences", "requestFieldOrigins", "requestParameters"), _influence_issues), (("globalGuardRegistrations", "modules", "header"), _guard_issues), (("applications", "interactions", "interactionHandlers", "header"), _interaction_issues),
        (("authorizationMetadata", "authorizationEnforcements", "resourceAccesses", "criticalSections", "globalGuardRegistrations", "header"), _relationship_issues),
    ):
        if all(n in given for n in needs):
            found += check(given)
    return dealt(reduce(DataFrame.unionByName, found), n, "analysis", "id").distinct()

