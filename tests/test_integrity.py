"""Snapshots read from JSON, and one broken snapshot for each way to break one."""

import copy
import json

import pytest

from factweave.operators import integrity
from factweave.sources import catalogue


def whole():
    """A snapshot with a record of every family that holds together."""
    ev = lambda n, role="declaration": {"id": f"evidence:{n}", "fileId": "source:1", "startLine": 1, "startColumn": 1, "endLine": 1, "endColumn": 9, "role": role, "contentHash": "h"}
    edge = lambda n, a, p, b, rule="r", e="evidence:1": {"id": f"assertion:{n}", "subjectId": a, "predicate": p, "objectId": b, "status": "resolved", "ruleId": rule, "evidenceIds": [e, "evidence:2"]}
    d = {"declarationEvidenceId": "evidence:1"}
    kinds = list(integrity.INTERACTION_KINDS)
    return {
        "schemaVersion": "8", "resultState": "completed", "globalGuardAnalysis": {"completeness": "complete", "state": "declared"},
        "interactionAnalysis": {"schemaKinds": kinds, "supportedKinds": kinds, "enabledKinds": kinds[:1], "state": "completed"},
        "resourceAccessAnalysis": {"supportedTechnologies": ["ioredis", "redlock", "cache_manager"], "enabledTechnologies": ["ioredis", "redlock", "cache_manager"]},
        "sourceFiles": [{"id": "source:1", "path": "a.ts", "contentHash": "h", "byteLength": 9}],
        "classes": [{"id": f"class:{n}", "sourceFileId": "source:1", "roles": [n], **d} for n in ("guard", "entity", "module")],
        "methods": [{"id": f"method:{n}", "classId": "class:module", **d} for n in (1, 2)],
        "endpoints": [{"id": "endpoint:1", "httpMethod": "GET", "path": "/"}], "guards": [{"id": "guard:1", "classId": "class:guard"}],
        "repositoryBindings": [{"id": "repository_binding:1", "ownerClassId": "class:module", **d}], "entities": [{"id": "entity:1", "classId": "class:entity"}], "tables": [{"id": "table:1", "name": "t"}],
        "evidence": [ev(1), ev(2, "call_site"), ev(3, "resolution_basis")], "diagnostics": [{"id": "diagnostic:1", "code": "X", "severity": "info", "subjectId": "method:1", "evidenceIds": ["evidence:1"]}],
        "modules": [{"id": "module:1", "classId": "class:module", "metadataCompleteness": "complete", **d}],
        "globalGuardRegistrations": [{"id": "global_guard_registration:1", "guardId": "guard:1", "moduleId": "module:1", "kind": "module", "order": 0, "assertionId": "assertion:guard", "registrationEvidenceId": "evidence:1"}],
        "contractTypes": [{"id": "contract_type:1", "sourceFileId": "source:1", **d}], "contractFields": [{"id": "contract_field:1", "contractTypeId": "contract_type:1", "declaredConstraints": [{"name": "Min", "decoratorEvidenceId": "evidence:3"}]}],
        "requestParameters": [{"id": "request_parameter:1", "methodId": "method:1", "decoratorEvidenceId": "evidence:3", "declaredType": {"contractTypeIds": ["contract_type:1"]}, **d}],
        "responseContracts": [{"id": "response_contract:1", "methodId": "method:1", "declaredType": {"contractTypeIds": []}, **d}],
        "entityColumns": [{"id": "entity_column:1", "entityId": "entity:1", "declaringClassId": "class:entity", "decoratorEvidenceId": "evidence:3", **d}],
        "requestFieldOrigins": [{"id": "request_field_origin:1", "requestParameterId": "request_parameter:1", "contractFieldIds": ["contract_field:1"], "originEvidenceId": "evidence:3"}],
        "columnInfluences": [{"id": "column_influence:1", "methodId": "method:2", "originId": "request_field_origin:1", "columnId": "entity_column:1", "assertionId": "assertion:flow", "sinkEvidenceId": "evidence:1", "operationEvidenceId": "evidence:1", "propagationEvidenceIds": [], "callPath": [{"callerMethodId": "method:1", "calleeMethodId": "method:2", "callEvidenceId": "evidence:2"}]}],
        "applications": [{"id": "application:1", "kind": "http", "rootModuleId": "module:1", "rootResolution": "resolved", "transportState": "not_applicable", "bootstrapEvidenceId": "evidence:1"}],
        "interactions": [{"id": "interaction:1", "kind": "job_queue", "sourceMethodId": "method:1", "applicationId": "application:1", "target": {"queue": "q"}, "evidenceIds": ["evidence:1"]}],
        "interactionHandlers": [{"id": "interaction_handler:1", "kind": "job_queue", "methodId": "method:2", "applicationId": "application:1", "registrationState": "proven_registered", "target": {"queue": "q"}, "handlerEvidenceId": "evidence:1"}],
        "interactionHandlerDispatches": [{"id": "interaction_handler_dispatch:1", "handlerId": "interaction_handler:1", "state": "complete", "branchIds": ["interaction_handler_branch:1"], "evidenceIds": []}],
        "interactionHandlerBranches": [{"id": "interaction_handler_branch:1", "dispatchId": "interaction_handler_dispatch:1", "selector": {"kind": "all_jobs"}, "evidenceIds": []}],
        "interactionHandlerBranchEffects": [{"id": "interaction_handler_branch_effect:1", "branchId": "interaction_handler_branch:1", "kind": "calls_method", "targetId": "method:1", "sourceAssertionId": "assertion:call", "status": "resolved", "evidenceIds": []}],
        "authorizationMetadata": [{"id": "authorization_metadata:1", "endpointId": "endpoint:1", "decorator": {"sourceFileId": None}, "evidenceIds": []}],
        "authorizationEnforcements": [{"id": "authorization_enforcement:1", "metadataId": "authorization_metadata:1", "endpointId": "endpoint:1", "guardId": "guard:1", "guardAssertionId": "assertion:uses", "evidenceIds": []}],
        "resourceAccesses": [{"id": "resource_access:1", "sourceMethodId": "method:1", "resourceKind": "distributed_lock", "operation": "critical_section", "technology": "redlock", "ruleId": "r", "evidenceIds": ["evidence:1"]}],
        "criticalSections": [{"id": "critical_section:1", "sourceMethodId": "method:1", "callbackEvidenceId": "evidence:1", "lockResourceAccessIds": ["resource_access:1"], "effectAssertionIds": ["assertion:call"], "evidenceIds": []}],
        "assertions": [
            edge("impl", "endpoint:1", "ENDPOINT_IMPLEMENTED_BY", "method:1"), edge("call", "method:1", "METHOD_CALLS_METHOD", "method:2"), edge("uses", "endpoint:1", "ENDPOINT_USES_GUARD", "guard:1"), edge("guard", "module:1", "MODULE_REGISTERS_GLOBAL_GUARD", "guard:1"),
            edge("flow", "request_field_origin:1", "REQUEST_FIELD_MAY_FLOW_TO_COLUMN", "entity_column:1"), edge("root", "application:1", "APPLICATION_USES_ROOT_MODULE", "module:1"), edge("begin", "method:1", "METHOD_INITIATES_INTERACTION", "interaction:1"),
            edge("meet", "interaction:1", "INTERACTION_MATCHES_LOCAL_HANDLER", "interaction_handler:1"), edge("made", "interaction_handler:1", "HANDLER_IMPLEMENTED_BY", "method:2"), edge("lock", "method:1", "METHOD_ACCESSES_RESOURCE", "resource_access:1"),
        ],
    }


def at(s, family, key):
    return next(r for r in s[family] if r["id"] == key)


def put(family, key, **fields):
    return lambda s: at(s, family, key).update(fields)


#: What is done to a snapshot, and an issue that it has to give.
BREAKS = [
    (put("methods", "method:1", classId="class:none"), ("MISSING_REFERENCE", "method:1", "classId")),
    (put("methods", "method:1", classId="table:1"), ("REFERENCE_KIND_MISMATCH", "method:1", "classId")),
    (put("assertions", "assertion:impl", objectId="table:1"), ("REFERENCE_KIND_MISMATCH", "assertion:impl", "objectId")),
    (put("requestParameters", "request_parameter:1", declaredType={"contractTypeIds": ["contract_type:9"]}), ("MISSING_REFERENCE", "request_parameter:1", "declaredType.contractTypeIds")),
    (put("interactionHandlerBranchEffects", "interaction_handler_branch_effect:1", kind="reads_table"), ("REFERENCE_KIND_MISMATCH", "interaction_handler_branch_effect:1", "targetId")),
    (lambda s: s["tables"].append(dict(s["tables"][0])), ("DUPLICATE_RECORD_ID", "table:1", None)),
    (lambda s: s["tables"].append({"id": "table:1", "name": "u"}), ("STABLE_ID_COLLISION", "table:1", None)),
    (lambda s: s["tables"].append({"id": "class:t", "name": "u"}), ("RECORD_ID_KIND_MISMATCH", "class:t", None)),
    (put("diagnostics", "diagnostic:1", evidenceIds=["evidence:1", "evidence:1"]), ("DUPLICATE_REFERENCE", "diagnostic:1", "evidenceIds")),
    (lambda s: s["globalGuardRegistrations"].append({**s["globalGuardRegistrations"][0], "id": "global_guard_registration:2"}), ("DUPLICATE_REFERENCE", "global_guard_registration:2", "order")),
    (put("globalGuardRegistrations", "global_guard_registration:1", order=3), ("GLOBAL_GUARD_REGISTRATION_MISMATCH", "global_guard_registration:1", "order")),
    (put("assertions", "assertion:guard", status="ambiguous"), ("GLOBAL_GUARD_REGISTRATION_MISMATCH", "global_guard_registration:1", "assertionId")),
    (put("modules", "module:1", metadataCompleteness="incomplete"), ("GLOBAL_GUARD_STATE_MISMATCH", None, "globalGuardAnalysis.completeness")),
    (lambda s: s["globalGuardAnalysis"].update(state="unknown"), ("GLOBAL_GUARD_STATE_MISMATCH", None, "globalGuardAnalysis.state")),
    (put("classes", "class:guard", roles=["entity"]), ("CLASS_ROLE_MISMATCH", "guard:1", "classId")),
    (put("methods", "method:2", declarationEvidenceId="evidence:2"), ("EVIDENCE_ROLE_MISMATCH", "method:2", "declarationEvidenceId")),
    (put("columnInfluences", "column_influence:1", callPath=[{"callerMethodId": "method:2", "calleeMethodId": "method:2", "callEvidenceId": "evidence:2"}]), ("COLUMN_INFLUENCE_ASSERTION_MISMATCH", "column_influence:1", "callPath.0")),
    (put("columnInfluences", "column_influence:1", callPath=[]), ("COLUMN_INFLUENCE_ASSERTION_MISMATCH", "column_influence:1", "callPath")),
    (put("assertions", "assertion:flow", objectId="entity_column:1", evidenceIds=["evidence:1"]), ("COLUMN_INFLUENCE_ASSERTION_MISMATCH", "column_influence:1", "assertionId")),
    (put("applications", "application:1", rootModuleId=None), ("APPLICATION_STATE_MISMATCH", "application:1", "rootResolution")),
    (put("applications", "application:1", transport="tcp"), ("APPLICATION_STATE_MISMATCH", "application:1", "transportState")),
    (put("interactionHandlers", "interaction_handler:1", methodId="method:1"), ("INTERACTION_ASSERTION_MISMATCH", "assertion:made", None)),
    (put("interactionHandlers", "interaction_handler:1", kind="in_process_event"), ("INTERACTION_ASSERTION_MISMATCH", "assertion:meet", None)),
    (lambda s: s["assertions"].remove(at(s, "assertions", "assertion:begin")), ("INTERACTION_ASSERTION_MISMATCH", "interaction:1", None)),
    (lambda s: s["interactionAnalysis"].update(enabledKinds=["other"]), ("INTERACTION_CAPABILITY_MISMATCH", None, "interactionAnalysis.enabledKinds")),
    (put("authorizationEnforcements", "authorization_enforcement:1", guardAssertionId="assertion:call"), ("AUTHORIZATION_RELATIONSHIP_MISMATCH", "authorization_enforcement:1", "guardAssertionId")),
    (lambda s: s["authorizationEnforcements"].clear(), ("AUTHORIZATION_RELATIONSHIP_MISMATCH", "authorization_metadata:1", None)),
    (put("resourceAccesses", "resource_access:1", ruleId="q"), ("RESOURCE_ACCESS_RELATIONSHIP_MISMATCH", "assertion:lock", None)),
    (put("resourceAccesses", "resource_access:1", technology="ioredis"), ("CRITICAL_SECTION_RELATIONSHIP_MISMATCH", "critical_section:1", "lockResourceAccessIds")),
    (put("criticalSections", "critical_section:1", effectAssertionIds=["assertion:made"]), ("CRITICAL_SECTION_RELATIONSHIP_MISMATCH", "critical_section:1", "effectAssertionIds")),
    (put("assertions", "assertion:call", objectId=None), ("MISSING_ASSERTION_TARGET", "assertion:call", "objectId")),
    (put("assertions", "assertion:call", evidenceIds=[]), ("RESOLVED_ASSERTION_WITHOUT_EVIDENCE", "assertion:call", "evidenceIds")),
    (put("evidence", "evidence:1", contentHash="x"), ("EVIDENCE_HASH_MISMATCH", "evidence:1", "contentHash")),
    (put("evidence", "evidence:1", endColumn=0), ("INVALID_EVIDENCE_RANGE", "evidence:1", None)),
    (put("endpoints", "endpoint:1", httpMethod="FETCH"), ("SCHEMA_INVALID", "endpoint:1", "httpMethod")),
]


def test_every_break_gives_its_issue_and_a_whole_snapshot_none(spark, tmp_path):
    (tmp_path / "whole.json").write_text(json.dumps(whole()))
    for i, (change, _) in enumerate(BREAKS):
        s = copy.deepcopy(whole())
        change(s)
        (tmp_path / f"break_{i}.json").write_text(json.dumps(s))
    families = catalogue.read(spark, str(tmp_path))
    assert families["header"].count() == len(BREAKS) + 1 and set(families["header"].first()["available"]) == set(catalogue.FAMILIES)
    found = {}
    for r in integrity.issues(families).collect():
        found.setdefault(r["analysis"].rsplit("/", 1)[1].removesuffix(".json"), set()).add((r["code"], r["id"], r["path"]))
    assert "whole" not in found, found["whole"]
    missed = [(i, want, found.get(f"break_{i}")) for i, (_, want) in enumerate(BREAKS) if want not in found.get(f"break_{i}", ())]
    assert not missed
    assert len({want[0] for _, want in BREAKS}) == 22


def test_absent_families_are_unavailable_and_malformed_documents_fail(spark, tmp_path):
    s = whole()
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps({k: s[k] for k in ("schemaVersion", "sourceFiles", "evidence", "assertions", "classes")}))
    families = catalogue.read(spark, str(tmp_path / "a"))
    assert set(families["header"].first()["available"]) == {"sourceFiles", "evidence", "assertions", "classes"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{"schemaVersion": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        catalogue.read(spark, str(tmp_path / "b"))["header"].count()
