"""Every family of facts that a snapshot may have: its records' kind and columns, and what they refer to.

Names, kinds and allowed values are fixed: they are those of the documents. Unions of several shapes are variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IDS = "array<string>"
#: family: kind of its records, columns besides id
FAMILIES = {
    "sourceFiles": ("source", "path string, contentHash string, byteLength bigint"),
    "classes": ("class", f"sourceFileId string, qualifiedName string, displayName string, roles {_IDS}, declarationEvidenceId string"),
    "methods": ("method", "classId string, qualifiedName string, displayName string, signature string, declarationEvidenceId string"),
    "endpoints": ("endpoint", "httpMethod string, path string"),
    "guards": ("guard", "classId string, displayName string"),
    "repositoryBindings": ("repository_binding", "ownerClassId string, memberName string, declarationEvidenceId string"),
    "entities": ("entity", "classId string, displayName string"),
    "tables": ("table", "name string, nameSource string"),
    "assertions": ("assertion", f"subjectId string, predicate string, objectId string, status string, ruleId string, evidenceIds {_IDS}"),
    "evidence": ("evidence", "fileId string, startLine int, startColumn int, endLine int, endColumn int, role string, snippet string, contentHash string"),
    "diagnostics": ("diagnostic", f"code string, severity string, message string, subjectId string, evidenceIds {_IDS}"),
    "modules": ("module", "classId string, isGlobal boolean, metadataCompleteness string, declarationEvidenceId string"),
    "globalGuardRegistrations": ("global_guard_registration", "guardId string, moduleId string, kind string, `order` int, assertionId string, registrationEvidenceId string"),
    "contractTypes": ("contract_type", "sourceFileId string, displayName string, declarationKind string, shapeSource string, declarationEvidenceId string"),
    "contractFields": ("contract_field", "contractTypeId string, declaringContractTypeId string, name string, optional boolean, declarationEvidenceId string, declaredConstraints array<struct<name:string,decoratorEvidenceId:string>>"),
    "requestParameters": ("request_parameter", "methodId string, parameterIndex int, sourceKind string, selector string, declarationEvidenceId string, decoratorEvidenceId string, declaredType variant"),
    "responseContracts": ("response_contract", "methodId string, handling string, promiseUnwrapped boolean, declarationEvidenceId string, manualResponseEvidenceId string, declaredType variant"),
    "entityColumns": ("entity_column", "entityId string, declaringClassId string, propertyName string, databaseName string, insert boolean, update boolean, declarationEvidenceId string, decoratorEvidenceId string"),
    "requestFieldOrigins": ("request_field_origin", f"requestParameterId string, propertyPath {_IDS}, contractFieldIds {_IDS}, resolution string, originEvidenceId string"),
    "columnInfluences": ("column_influence", f"methodId string, originId string, columnId string, assertionId string, state string, sinkKind string, sinkEvidenceId string, operationEvidenceId string, propagationEvidenceIds {_IDS}, callPath array<struct<callerMethodId:string,calleeMethodId:string,callEvidenceId:string>>"),
    "applications": ("application", "kind string, rootModuleId string, rootResolution string, transportState string, transport string, bootstrapEvidenceId string"),
    "interactions": ("interaction", f"kind string, sourceMethodId string, applicationId string, activation string, boundary string, dispatchTiming string, target variant, evidenceIds {_IDS}"),
    "interactionHandlers": ("interaction_handler", f"kind string, methodId string, applicationId string, registrationState string, ruleId string, target variant, handlerEvidenceId string, configurationEvidenceIds {_IDS}"),
    "interactionHandlerDispatches": ("interaction_handler_dispatch", f"handlerId string, state string, branchIds {_IDS}, evidenceIds {_IDS}"),
    "interactionHandlerBranches": ("interaction_handler_branch", f"dispatchId string, selector variant, controlFlow string, evidenceIds {_IDS}"),
    "interactionHandlerBranchEffects": ("interaction_handler_branch_effect", f"branchId string, kind string, targetId string, sourceAssertionId string, status string, evidenceIds {_IDS}"),
    "authorizationMetadata": ("authorization_metadata", f"endpointId string, scope string, metadataKey string, decorator struct<sourceFileId:string>, valueShape variant, evidenceIds {_IDS}"),
    "authorizationEnforcements": ("authorization_enforcement", f"metadataId string, endpointId string, state string, guardId string, guardAssertionId string, evidenceIds {_IDS}"),
    "resourceAccesses": ("resource_access", f"sourceMethodId string, resourceKind string, operation string, technology string, api string, target variant, selector variant, ruleId string, evidenceIds {_IDS}"),
    "criticalSections": ("critical_section", f"sourceMethodId string, callbackEvidenceId string, lockResourceAccessIds {_IDS}, effectAssertionIds {_IDS}, evidenceIds {_IDS}"),
}
#: What a document says of itself, besides families.
HEADER = (
    "schemaVersion string, resultState string, globalGuardAnalysis struct<completeness:string,state:string>, "
    f"interactionAnalysis struct<schemaKinds:{_IDS},supportedKinds:{_IDS},enabledKinds:{_IDS},state:string>, resourceAccessAnalysis struct<supportedTechnologies:{_IDS},enabledTechnologies:{_IDS}>"
)

#: family: field to the kind that it refers to. x[] is a list, x.y a field of an object, x[].y of each object in a list.
REFERENCES = {
    "classes": {"sourceFileId": "source", "declarationEvidenceId": "evidence"},
    "methods": {"classId": "class", "declarationEvidenceId": "evidence"},
    "guards": {"classId": "class"},
    "repositoryBindings": {"ownerClassId": "class", "declarationEvidenceId": "evidence"},
    "entities": {"classId": "class"},
    "assertions": {"evidenceIds[]": "evidence"},
    "evidence": {"fileId": "source"},
    "diagnostics": {"subjectId": None, "evidenceIds[]": "evidence"},
    "modules": {"classId": "class", "declarationEvidenceId": "evidence"},
    "globalGuardRegistrations": {"guardId": "guard", "moduleId": "module", "assertionId": "assertion", "registrationEvidenceId": "evidence"},
    "contractTypes": {"sourceFileId": "source", "declarationEvidenceId": "evidence"},
    "contractFields": {"contractTypeId": "contract_type", "declaringContractTypeId": "contract_type", "declarationEvidenceId": "evidence", "declaredConstraints[].decoratorEvidenceId": "evidence"},
    "requestParameters": {"methodId": "method", "declarationEvidenceId": "evidence", "decoratorEvidenceId": "evidence", "declaredType.contractTypeIds[]": "contract_type"},
    "responseContracts": {"methodId": "method", "declarationEvidenceId": "evidence", "manualResponseEvidenceId": "evidence", "declaredType.contractTypeIds[]": "contract_type"},
    "entityColumns": {"entityId": "entity", "declaringClassId": "class", "declarationEvidenceId": "evidence", "decoratorEvidenceId": "evidence"},
    "requestFieldOrigins": {"requestParameterId": "request_parameter", "originEvidenceId": "evidence", "contractFieldIds[]": "contract_field"},
    "columnInfluences": {"methodId": "method", "originId": "request_field_origin", "columnId": "entity_column", "assertionId": "assertion", "sinkEvidenceId": "evidence", "operationEvidenceId": "evidence", "propagationEvidenceIds[]": "evidence", "callPath[].callerMethodId": "method", "callPath[].calleeMethodId": "method", "callPath[].callEvidenceId": "evidence"},
    "applications": {"bootstrapEvidenceId": "evidence", "rootModuleId": "module"},
    "interactions": {"sourceMethodId": "method", "applicationId": "application", "evidenceIds[]": "evidence"},
    "interactionHandlers": {"methodId": "method", "applicationId": "application", "handlerEvidenceId": "evidence", "configurationEvidenceIds[]": "evidence"},
    "interactionHandlerDispatches": {"handlerId": "interaction_handler", "branchIds[]": "interaction_handler_branch", "evidenceIds[]": "evidence"},
    "interactionHandlerBranches": {"dispatchId": "interaction_handler_dispatch", "evidenceIds[]": "evidence"},
    "interactionHandlerBranchEffects": {"branchId": "interaction_handler_branch", "sourceAssertionId": "assertion", "evidenceIds[]": "evidence"},
    "authorizationMetadata": {"endpointId": "endpoint", "decorator.sourceFileId": "source", "evidenceIds[]": "evidence"},
    "authorizationEnforcements": {"metadataId": "authorization_metadata", "endpointId": "endpoint", "guardId": "guard", "guardAssertionId": "assertion", "evidenceIds[]": "evidence"},
    "resourceAccesses": {"sourceMethodId": "method", "evidenceIds[]": "evidence"},
    "criticalSections": {"sourceMethodId": "method", "callbackEvidenceId": "evidence", "lockResourceAccessIds[]": "resource_access", "effectAssertionIds[]": "assertion", "evidenceIds[]": "evidence"},
}
#: predicate: kinds of its subject and object
PREDICATES = {
    "ENDPOINT_IMPLEMENTED_BY": ("endpoint", "method"), "METHOD_CALLS_METHOD": ("method", "method"), "CLASS_INJECTS_CLASS": ("class", "class"), "CLASS_INJECTS_REPOSITORY": ("class", "repository_binding"),
    "REPOSITORY_FOR_ENTITY": ("repository_binding", "entity"), "ENTITY_MAPS_TO_TABLE": ("entity", "table"), "METHOD_READS_TABLE": ("method", "table"), "METHOD_WRITES_TABLE": ("method", "table"), "ENDPOINT_USES_GUARD": ("endpoint", "guard"),
    "MODULE_IMPORTS_MODULE": ("module", "module"), "MODULE_PROVIDES_CLASS": ("module", "class"), "MODULE_EXPORTS_CLASS": ("module", "class"), "MODULE_EXPORTS_MODULE": ("module", "module"), "MODULE_DECLARES_CONTROLLER": ("module", "class"),
    "MODULE_REGISTERS_GLOBAL_GUARD": ("module", "guard"), "APPLICATION_REGISTERS_GLOBAL_GUARD": ("module", "guard"), "APPLICATION_USES_ROOT_MODULE": ("application", "module"),
    "METHOD_DECLARES_REQUEST_PARAMETER": ("method", "request_parameter"), "METHOD_DECLARES_RESPONSE": ("method", "response_contract"), "CONTRACT_TYPE_DECLARES_FIELD": ("contract_type", "contract_field"), "ENTITY_DECLARES_COLUMN": ("entity", "entity_column"),
    "REQUEST_PARAMETER_HAS_FIELD_ORIGIN": ("request_parameter", "request_field_origin"), "REQUEST_FIELD_MAY_FLOW_TO_COLUMN": ("request_field_origin", "entity_column"), "METHOD_INITIATES_INTERACTION": ("method", "interaction"),
    "INTERACTION_MATCHES_LOCAL_HANDLER": ("interaction", "interaction_handler"), "HANDLER_IMPLEMENTED_BY": ("interaction_handler", "method"), "METHOD_ACCESSES_RESOURCE": ("method", "resource_access"),
}
#: (family, field): allowed values
VALUES = {
    ("assertions", "status"): ("resolved", "ambiguous", "unresolved", "unsupported"),
    ("assertions", "predicate"): tuple(PREDICATES),
    ("endpoints", "httpMethod"): ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ALL"),
    ("diagnostics", "severity"): ("info", "warning", "error"),
    ("modules", "metadataCompleteness"): ("complete", "incomplete"),
    ("interactionHandlers", "registrationState"): ("proven_registered", "not_proven", "unknown"),
    ("interactionHandlerDispatches", "state"): ("complete", "partial", "unsupported"),
}


def record_schema(family: str) -> str:
    return f"id string, {FAMILIES[family][1]}"


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The snapshots of a folder: ``header`` (analysis, and what a document says of itself) and each family (analysis, id, ...).
    A document that isn't JSON, or of other types, fails the read. A family that a document lacks is unavailable:
    its name isn't in ``header``'s ``available``."""
    arrays = ", ".join(f"{name} array<struct<{', '.join(_field(x) for x in _fields(record_schema(name)))}>>" for name in FAMILIES)
    docs = spark.read.schema(f"{HEADER}, {arrays}").option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("analysis", F.input_file_name())
    available = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in FAMILIES]))
    out = {"header": docs.select("analysis", *[f.split(" ")[0] for f in _fields(HEADER)], available.alias("available"))}
    for name in FAMILIES:
        out[name] = docs.select("analysis", F.explode(name).alias("r")).select("analysis", "r.*")
    return out


def _fields(ddl: str) -> list[str]:
    """The columns of a list, which stand outside of angle brackets."""
    out, depth, last = [], 0, 0
    for i, x in enumerate(ddl):
        depth += {"<": 1, ">": -1}.get(x, 0)
        if x == "," and not depth:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]


def _field(column: str) -> str:
    name, _, kind = column.partition(" ")
    return f"{name}: {kind}"


def family(rows: DataFrame, name: str) -> DataFrame:
    """Rows with some of a family's columns, as the family: what is missing is null, a list empty."""
    columns = []
    for field in ["analysis string", *_fields(record_schema(name))]:
        column, _, kind = field.partition(" ")
        column = column.strip("`")
        columns.append((F.col(column) if column in rows.columns else F.array() if kind.startswith("array") else F.lit(None)).cast(kind).alias(column))
    return rows.select(*columns)
