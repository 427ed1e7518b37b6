"""OpenAPI documents: their operations matched to endpoints, and written back with what is known of them.

A document is a row (doc, text). Its operations are taken apart, matched by verb and normalized path, and put
together again with an extension each; everything else in a document stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.text import normalize_route, route_to_openapi

#: Fixed names: the verbs that are operations, and the extension's key.
VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
EXTENSION = "x-api-intel"
_MAP = "map<string,variant>"


def _object(text: Column) -> Column:
    return F.from_json(text, _MAP)


def readable(documents: DataFrame) -> DataFrame:
    """(doc, state): supported, or why a document is refused: malformed, unsupported_version, no_paths or invalid_path."""
    root = F.from_json("text", "openapi string, paths map<string,variant>")
    d = documents.select("doc", F.try_parse_json("text").isNull().alias("broken"), root.alias("r"))
    supported = F.coalesce(F.regexp_like("r.openapi", F.lit(r"^3\.[01]\.")), F.lit(False))
    paths = F.map_keys("r.paths")
    state = F.when(F.col("broken"), "malformed").when(~supported, "unsupported_version").when(F.col("r.paths").isNull(), "no_paths").when(F.exists(paths, lambda p: ~F.startswith(p, F.lit("/"))), "invalid_path").otherwise("supported")
    return d.select("doc", state.alias("state"))


def operations(documents: DataFrame) -> DataFrame:
    """(doc, path, key, verb, slot, operation): every operation of documents that can be read, as JSON text; key is the verb as
    it is written, slot the normalized path."""
    d = documents.join(readable(documents).where("state = 'supported'").select("doc"), "doc")
    items = d.select("doc", F.explode(F.from_json("text", "paths map<string,variant>")["paths"]).alias("path", "item"))
    ops = items.select("doc", "path", F.explode(_object(F.to_json("item"))).alias("key", "operation")).where(F.lower("key").isin(*VERBS))
    return ops.select("doc", "path", "key", F.upper("key").alias("verb"), normalize_route(F.col("path")).alias("slot"), F.to_json("operation").alias("operation"))


def matched(ops: DataFrame, endpoints: DataFrame, prefix: str = "/") -> tuple[DataFrame, DataFrame]:
    """(operations, unmatched). endpoints: doc, endpoint, verb, path, resolved (whether its own selection is). operations have
    resolution: ambiguous (several operations or several endpoints in a slot), unmatched, unresolved or resolved, and the
    sorted candidates. unmatched: doc, endpoint, verb, path, slot of endpoints that no operation has."""
    e = endpoints.withColumn("slot", route_to_openapi(F.col("path"), prefix))
    by = ["doc", "verb", "slot"]
    found = e.groupBy(*by).agg(F.array_sort(F.collect_set("endpoint")).alias("candidates"), F.count("*").alias("n"), F.every("resolved").alias("sure"))
    times = F.count("*").over(Window.partitionBy(*by))
    o = ops.withColumn("times", times).join(found, by, "left")
    resolution = F.when((F.col("times") > 1) | (F.coalesce("n", F.lit(0)) > 1), "ambiguous").when(F.col("n").isNull(), "unmatched").when(F.col("sure"), "resolved").otherwise("unresolved")
    o = o.select(*ops.columns, resolution.alias("resolution"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    return o, e.join(ops.select(*by).distinct(), by, "left_anti").select("doc", "endpoint", "verb", "path", "slot")


def extensions(ops: DataFrame, facts: DataFrame, version: str) -> DataFrame:
    """The matched operations with ``extension``, JSON text: of a resolved one its endpoint with its facts (doc, endpoint, fields:
    JSON text of an object), of the others their candidates."""
    o = ops.withColumn("endpoint", F.when(F.col("resolution") == "resolved", F.get("candidates", F.lit(0)))).join(facts, ["doc", "endpoint"], "left")
    head = F.concat(F.lit(f'{{"schemaVersion":"{version}","resolution":"'), F.col("resolution"), F.lit('"'))
    own = F.concat(F.lit(',"endpointId":'), F.to_json(F.col("endpoint").cast("variant")), F.when(F.length("fields") > 2, F.concat(F.lit(","), F.substring("fields", 2, 1 << 30))).otherwise("}"))
    rest = F.concat(F.lit(',"candidateEndpointIds":'), F.to_json("candidates"), F.lit("}"))
    return o.select(*ops.columns, F.concat(head, F.when(F.col("endpoint").isNotNull(), F.coalesce(own, F.lit("}"))).otherwise(rest)).alias("extension"))


def written_back(documents: DataFrame, extended: DataFrame) -> DataFrame:
    """(doc, text): the documents with each operation's extension, replacing one that it has; keys in order. Documents that can't be
    read are left out."""
    e = extended.select("doc", "path", "key", F.to_json(F.map_concat(F.map_filter(_object(F.col("operation")), lambda k, _: k != EXTENSION), F.create_map(F.lit(EXTENSION), F.parse_json("extension")))).alias("operation"))
    changed = e.groupBy("doc", "path").agg(F.map_from_entries(F.collect_list(F.struct("key", "operation"))).alias("changed"))
    d = documents.join(readable(documents).where("state = 'supported'").select("doc"), "doc")
    items = d.select("doc", F.explode(F.from_json("text", "paths map<string,variant>")["paths"]).alias("path", "item")).join(changed, ["doc", "path"], "left")
    kept = F.map_filter(_object(F.to_json("item")), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("changed"), k), F.lit(False)))
    whole = F.map_concat(kept, F.coalesce(F.transform_values("changed", lambda _, v: F.parse_json(v)), F.create_map().cast(_MAP)))
    paths = items.select("doc", "path", F.to_json(whole).alias("item")).groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", F.parse_json("item"))))).alias("paths"))
    d = d.join(paths, "doc", "left")
    top = F.map_concat(F.map_filter(_object(F.col("text")), lambda k, _: k != "paths"), F.create_map(F.lit("paths"), F.parse_json(F.coalesce("paths", F.lit("{}")))))
    return d.select("doc", F.to_json(F.parse_json(F.to_json(top))).alias("text"))


def enrichment_summary(ops: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(doc, operations, resolved, ambiguous, unmatched, unresolved, endpoints): endpoints are those without an operation."""
    n = lambda r: F.count_if(F.col("resolution") == r).alias(r)
    left = unmatched.groupBy("doc").agg(F.count("*").alias("endpoints"))
    return ops.groupBy("doc").agg(F.count("*").alias("operations"), *map(n, ("resolved", "ambiguous", "unmatched", "unresolved"))).join(left, "doc", "left").na.fill(0, ["endpoints"])
