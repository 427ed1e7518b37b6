"""Canonical documents, orders of code units, graph documents and OpenAPI documents bound to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import document, integrity, openapi
from factweave.plans.bindings import bound, table
from factweave.sources import catalogue

c = F.col
#: Last characters of names: by code point the fourth comes last, by code unit the third.
_SIGNS = ("a", "é", "", "\U00010000")


@bound(f"""WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{_SIGNS[0]}' WHEN 1 THEN '{_SIGNS[1]}' WHEN 2 THEN '{_SIGNS[2]}' ELSE '{_SIGNS[3]}' END || c_mktsegment AS name, CASE c_custkey % 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE c_custkey % 4 END AS sign, c_mktsegment FROM customer)
SELECT c_custkey, name, row_number() OVER (ORDER BY sign, c_mktsegment, c_custkey) AS position FROM n""")
def code_unit_order(spark, sf):
    sign = F.element_at(F.array(*map(F.lit, _SIGNS)), (c("c_custkey") % 4 + 1).cast("int"))
    # the key first among the columns: it breaks ties
    return document.in_order(table(spark, sf, "customer").select("c_custkey", F.concat(sign, "c_mktsegment").alias("name")), "name")


@bound(f"""WITH o AS (SELECT o_custkey AS k, string_agg('    {{' || chr(10) || '      "id": ' || o_orderkey || ',' || chr(10) || '      "notes": ' || CASE WHEN o_orderstatus = 'F' THEN '[]' ELSE '[' || chr(10) || '        "' || o_orderpriority || '",' || chr(10) || '        "say \\"x\\""' || chr(10) || '      ]' END || ',' || chr(10) || '      "total": ' || CAST(floor(o_totalprice) AS BIGINT) || chr(10) || '    }}', ',' || chr(10) ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1)
SELECT c_custkey, sha256('{{' || chr(10) || '  "Name": "' || c_name || '",' || chr(10) || '  "orders": ' || coalesce('[' || chr(10) || orders || chr(10) || '  ]', '[]') || ',' || chr(10) || '  "owner": null,' || chr(10) || '  "tags": {{' || chr(10) || '    "{_SIGNS[0]}": 1,' || chr(10) || '    "{_SIGNS[1]}": ' || c_nationkey || ',' || chr(10) || '    "{_SIGNS[3]}": 3,' || chr(10) || '    "{_SIGNS[2]}": 4' || chr(10) || '  }}' || chr(10) || '}}') AS hash
FROM customer LEFT JOIN o ON k = c_custkey""")
def canonical_documents(spark, sf):
    """Nested documents: structs, maps and lists, keys in the order of code units."""
    notes = F.when(c("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority", F.lit('say "x"')))
    o = table(spark, sf, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(c("o_orderkey").alias("id"), F.floor("o_totalprice").cast("double").alias("total"), notes.alias("notes")))).alias("orders"))
    tags = F.create_map(F.lit(_SIGNS[2]), F.lit(4), F.lit(_SIGNS[3]), F.lit(3), F.lit(_SIGNS[0]), F.lit(1), F.lit(_SIGNS[1]), c("c_nationkey").cast("int"))
    none = F.array().cast(o.schema["orders"].dataType)
    d = table(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", F.struct(tags.alias("tags"), F.coalesce("orders", none).alias("orders"), c("c_name").alias("Name"), F.lit(None).cast("string").alias("owner")).alias("doc"))
    return d.select("c_custkey", F.sha2(document.canonical_json(c("doc"), d.schema["doc"].dataType), 256).alias("hash"))


_STEPS = """e AS (SELECT 'c' || o_custkey AS root, 'po' || o_orderkey AS edge, 'c' || o_custkey AS source, CASE WHEN o_orderstatus <> 'P' THEN 'o' || o_orderkey END AS target, 'CALLS' AS relation, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'ambiguous' ELSE 'unresolved' END AS status, ['e' || o_orderkey % 9, 'f'] AS evidence FROM orders
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 'pl' || l_orderkey || '.' || l_partkey, 'o' || l_orderkey, 'p' || l_partkey, 'READS', 'resolved', ['l' || l_partkey % 5] FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
i AS (SELECT root, edge, CASE WHEN edge LIKE 'po%7' THEN 'direct' ELSE 'transitive' END AS impact FROM e WHERE edge LIKE '%7'),
x AS (SELECT e.root, e.edge, source, coalesce(target, 'gap:' || e.edge) AS target, target IS NULL AS gap, relation, status, evidence, coalesce(impact, 'none') AS impact FROM e LEFT JOIN i ON i.root = e.root AND i.edge = e.edge)"""


def _graph(spark, sf):
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    o = table(spark, sf, "orders")
    k, who, status = c("o_orderkey"), c("o_custkey"), c("o_orderstatus")
    own = o.select(s("c", who).alias("root"), s("po", k).alias("edge"), s("c", who).alias("source"), F.when(status != "P", s("o", k)).alias("target"), F.lit("CALLS").alias("relation"), F.when(status == "F", "resolved").when(status == "O", "ambiguous").otherwise("unresolved").alias("status"), F.array(s("e", k % 9), F.lit("f")).alias("evidence"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().join(o.where(status != "P"), c("l_orderkey") == k)
    steps = own.unionByName(lines.select(s("c", who).alias("root"), s("pl", c("l_orderkey"), ".", c("l_partkey")).alias("edge"), s("o", c("l_orderkey")).alias("source"), s("p", c("l_partkey")).alias("target"), F.lit("READS").alias("relation"), F.lit("resolved").alias("status"), F.array(s("l", c("l_partkey") % 5)).alias("evidence")))
    impacted = steps.where("edge like '%7'").select("root", "edge", F.when(c("edge").like("po%"), "direct").otherwise("transitive").alias("impact"))
    facts = table(spark, sf, "part").select(s("p", c("p_partkey")).alias("node"), c("p_name").alias("label"), F.lit("part").alias("kind")).unionByName(o.select(s("o", k).alias("node"), c("o_orderpriority").alias("label"), F.lit("order").alias("kind")))
    rules = o.select(s("o", k).alias("node"), F.when(k % 3 == 0, "fail").when(k % 3 == 1, "unknown").otherwise("pass").alias("outcome"))
    return document.graph_elements(steps, facts, impacted, rules)


@bound(f"""WITH {_STEPS}, ends AS (SELECT root, source AS node, false AS gap, status, relation, impact, evidence FROM x UNION ALL SELECT root, target, gap, status, relation, impact, evidence FROM x),
n AS (SELECT root, node, bool_or(gap) AS gap, max(CASE impact WHEN 'direct' THEN 2 WHEN 'transitive' THEN 1 ELSE 0 END) AS impact, any_value(status) FILTER (gap) AS status, any_value(relation) FILTER (gap) AS relation, list_sort(list_distinct(flatten(list(evidence)))) AS evidence FROM ends GROUP BY root, node)
SELECT root, node, CASE WHEN gap THEN n.status || ': ' || relation WHEN node LIKE 'p%' THEN p_name WHEN node LIKE 'o%' THEN o_orderpriority ELSE node END AS label, CASE WHEN gap THEN 'gap' WHEN node LIKE 'p%' THEN 'part' WHEN node LIKE 'o%' THEN 'order' ELSE 'unknown' END AS kind,
CASE WHEN gap THEN n.status ELSE 'resolved' END AS uncertainty, CASE impact WHEN 2 THEN 'direct' WHEN 1 THEN 'transitive' ELSE 'none' END AS impact, array_to_string(evidence, ',') AS evidence, CAST(coalesce(o_orderkey % 3 = 0, false) AS BIGINT) AS failed, CAST(coalesce(o_orderkey % 3 = 1, false) AS BIGINT) AS unknown
FROM n LEFT JOIN part ON node = 'p' || p_partkey LEFT JOIN orders ON node = 'o' || o_orderkey""")
def graph_nodes(spark, sf):
    """Nodes of each customer's graph, gaps among them, with impact and rules laid over."""
    return _graph(spark, sf)[0].withColumn("evidence", F.array_join("evidence", ","))


@bound(f"WITH {_STEPS} SELECT root, edge, source, target, relation, status AS uncertainty, impact, array_to_string(list_sort(list_distinct(evidence)), ',') AS evidence FROM x")
def graph_edges(spark, sf):
    return _graph(spark, sf)[1].withColumn("evidence", F.array_join("evidence", ","))


_SHOWN = """n AS (SELECT 'customer:' || c_custkey AS node, 'nation:' || c_nationkey AS parent, c_custkey % 3 AS rank FROM customer UNION ALL SELECT 'nation:' || n_nationkey, NULL, -1 FROM nation WHERE n_nationkey % 4 <> 0),
top AS (SELECT * FROM n ORDER BY rank, node LIMIT 240), s AS (SELECT * FROM top WHERE parent IS NULL OR parent IN (SELECT node FROM top)),
e AS (SELECT 'e' || a.c_custkey AS edge, 'customer:' || a.c_custkey AS source, 'customer:' || a.c_custkey * 7 % 100 AS target FROM customer a UNION ALL SELECT 'f' || c_custkey, 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer),
k AS (SELECT * FROM e WHERE source IN (SELECT node FROM s) AND target IN (SELECT node FROM s) ORDER BY edge LIMIT 60)"""


def _shown(spark, sf):
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, n = c("c_custkey"), c("c_nationkey")
    people = table(spark, sf, "customer")
    nodes = people.select(s("customer:", k).alias("node"), s("nation:", n).alias("parent"), (k % 3).cast("int").alias("rank"))
    nodes = nodes.unionByName(table(spark, sf, "nation").where("n_nationkey % 4 <> 0").select(s("nation:", c("n_nationkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(-1).alias("rank")))
    links = people.select(s("e", k).alias("edge"), s("customer:", k).alias("source"), s("customer:", k * 7 % 100).alias("target")).unionByName(people.select(s("f", k).alias("edge"), s("nation:", n).alias("source"), s("customer:", k).alias("target")))
    return document.displayed(nodes, links, 240, 60)


@bound(f"WITH {_SHOWN} SELECT edge, source, target FROM k")
def display_edges(spark, sf):
    """The report's edges: both ends are shown, the first by name."""
    return _shown(spark, sf)[1]


@bound(f"WITH {_SHOWN} SELECT (SELECT count(*) FROM n) - (SELECT count(*) FROM s) AS nodes, (SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS edges")
def display_omitted(spark, sf):
    return _shown(spark, sf)[2]


# --- OpenAPI: a document a nation; its suppliers are operations, its customers endpoints ------------

_OPERATION = """'"' || CASE s_suppkey % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'POST' ELSE 'x-note' END || '":{"operationId":"s' || s_suppkey || '","x-api-intel":{"old":true},"n":' || s_suppkey || '}'"""
_PATH = "'/api/' || CASE s_suppkey % 4 WHEN 0 THEN 'v//' ELSE 'v/' END || s_suppkey % 60 || '/{id}' || CASE s_suppkey % 5 WHEN 0 THEN '/' ELSE '' END"
_DOCS = f"""docs AS (SELECT n_nationkey AS doc, CASE WHEN n_nationkey % 11 = 10 THEN '{{"openapi":"2.0","paths":{{}}}}' WHEN n_nationkey % 11 = 9 THEN '{{"openapi":"3.1.0"' WHEN n_nationkey % 11 = 8 THEN '{{"openapi":"3.0.1"}}'
  ELSE '{{"openapi":"3.0.3","info":{{"title":"t' || n_nationkey || '"}},"paths":{{' || coalesce(paths, '') || '}}}}' END AS text
  FROM nation LEFT JOIN (SELECT nat, string_agg('"' || path || '":{{' || ops || ',"summary":"s"}}', ',' ORDER BY path) AS paths FROM (SELECT s_nationkey AS nat, {_PATH} AS path, string_agg({_OPERATION}, ',' ORDER BY s_suppkey) AS ops FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey, {_PATH}, s_suppkey % 3 ORDER BY s_suppkey) = 1) GROUP BY 1, 2) GROUP BY nat) ON nat = n_nationkey)"""
_OPS = f"""ops AS (SELECT s_nationkey AS doc, {_PATH} AS path, CASE s_suppkey % 3 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, '/api/v/' || s_suppkey % 60 || '/{{id}}' AS slot, s_suppkey FROM (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey, {_PATH}, s_suppkey % 3 ORDER BY s_suppkey) = 1) WHERE s_suppkey % 3 < 2 AND s_nationkey % 11 NOT IN (8, 9, 10)),
ends AS (SELECT c_nationkey AS doc, 'ep' || c_custkey AS endpoint, CASE c_custkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, 'v/' || c_custkey % 60 || '/:id' AS path, '/api/v/' || c_custkey % 60 || '/{{id}}' AS slot, c_acctbal > 1000 AS sure FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT o.*, (SELECT count(*) FROM ops p WHERE p.doc = o.doc AND p.verb = o.verb AND p.slot = o.slot) AS times, (SELECT list(endpoint ORDER BY endpoint) FROM ends e WHERE e.doc = o.doc AND e.verb = o.verb AND e.slot = o.slot) AS candidates, (SELECT bool_and(sure) FROM ends e WHERE e.doc = o.doc AND e.verb = o.verb AND e.slot = o.slot) AS sure FROM ops o),
r AS (SELECT *, CASE WHEN times > 1 OR len(candidates) > 1 THEN 'ambiguous' WHEN candidates IS NULL THEN 'unmatched' WHEN sure THEN 'resolved' ELSE 'unresolved' END AS resolution FROM m),
left_out AS (SELECT doc, endpoint, verb, path, slot FROM ends e WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.doc = e.doc AND o.verb = e.verb AND o.slot = e.slot))"""


def _openapi(spark, sf):
    """The documents as text, their operations and the endpoints."""
    s = c("s_suppkey")
    t = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.expr(_PATH).alias("path"), F.expr(_OPERATION).alias("op"))
    one = t.groupBy("s_nationkey", "path", (s % 3).alias("third")).agg(F.min_by("op", s).alias("op"), F.min(s).alias("first"))
    quoted = lambda rows, order, item: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("item")))), lambda x: x["item"]), ",")
    paths = one.groupBy("s_nationkey", "path").agg(quoted(one, c("first"), c("op")).alias("ops"))
    paths = paths.groupBy("s_nationkey").agg(quoted(paths, c("path"), F.concat(F.lit('"'), "path", F.lit('":{'), "ops", F.lit(',"summary":"s"}'))).alias("paths"))
    n = c("n_nationkey")
    whole = F.concat(F.lit('{"openapi":"3.0.3","info":{"title":"t'), n.cast("string"), F.lit('"},"paths":{'), F.coalesce("paths", F.lit("")), F.lit("}}"))
    text = F.when(n % 11 == 10, '{"openapi":"2.0","paths":{}}').when(n % 11 == 9, '{"openapi":"3.1.0"').when(n % 11 == 8, '{"openapi":"3.0.1"}').otherwise(whole)
    docs = table(spark, sf, "nation").join(paths, n == c("s_nationkey"), "left").select(n.alias("doc"), text.alias("text"))
    k = c("c_custkey")
    ends = table(spark, sf, "customer").where(k % 3 == 0).select(c("c_nationkey").alias("doc"), F.concat(F.lit("ep"), k.cast("string")).alias("endpoint"), F.when(k % 2 == 0, "GET").otherwise("POST").alias("verb"), F.concat(F.lit("v/"), (k % 60).cast("string"), F.lit("/:id")).alias("path"), (c("c_acctbal") > 1000).alias("resolved"))
    ops, left = openapi.matched(openapi.operations(docs), ends, "/api")
    return docs, ops, left


@bound(f"WITH {_DOCS} SELECT doc, CASE doc % 11 WHEN 10 THEN 'unsupported_version' WHEN 9 THEN 'malformed' WHEN 8 THEN 'no_paths' ELSE 'supported' END AS state, text FROM docs")
def openapi_documents(spark, sf):
    docs, _, _ = _openapi(spark, sf)
    return openapi.readable(docs).join(docs, "doc")


@bound(f"WITH {_OPS} SELECT doc, path, verb, slot, resolution, coalesce(array_to_string(candidates, ','), '') AS candidates FROM r")
def openapi_operations(spark, sf):
    _, ops, _ = _openapi(spark, sf)
    return ops.select("doc", "path", "verb", "slot", "resolution", F.array_join("candidates", ",").alias("candidates"))


@bound(f"""WITH {_OPS} SELECT doc, count(*) AS operations, count(*) FILTER (resolution = 'resolved') AS resolved, count(*) FILTER (resolution = 'ambiguous') AS ambiguous, count(*) FILTER (resolution = 'unmatched') AS unmatched, count(*) FILTER (resolution = 'unresolved') AS unresolved,
coalesce((SELECT count(*) FROM left_out l WHERE l.doc = r.doc), 0) AS endpoints FROM r GROUP BY doc""")
def openapi_summary(spark, sf):
    _, ops, left = _openapi(spark, sf)
    return openapi.enrichment_summary(ops, left)


@bound(f"""WITH {_OPS} SELECT doc, path, lower(verb) AS verb, 's' || s_suppkey AS operation, s_suppkey AS n, CASE resolution WHEN 'resolved' THEN '{{"dbReads":["t"],"endpointId":"' || candidates[1] || '","resolution":"resolved","schemaVersion":"1"}}'
ELSE '{{"candidateEndpointIds":[' || coalesce('"' || array_to_string(candidates, '","') || '"', '') || '],"resolution":"' || resolution || '","schemaVersion":"1"}}' END AS extension, 's' AS summary FROM r""")
def openapi_enriched(spark, sf):
    """The enriched documents, read again: each operation's own fields and its extension, which replaces the old one."""
    docs, ops, _ = _openapi(spark, sf)
    facts = ops.where("resolution = 'resolved'").select("doc", F.get("candidates", F.lit(0)).alias("endpoint"), F.lit('{"dbReads":["t"]}').alias("fields")).distinct()
    out = openapi.written_back(docs, openapi.extensions(ops, facts, "1"))
    items = out.select("doc", F.explode(F.from_json("text", "paths map<string,variant>")["paths"]).alias("path", "item"))
    each = items.select("doc", "path", F.expr("try_variant_get(item, '$.summary', 'string')").alias("summary"), F.explode(F.from_json(F.to_json("item"), "map<string,variant>")).alias("key", "op")).where(F.lower("key").isin("get", "post"))
    part = lambda p, kind: F.expr(f"try_variant_get(op, '$.{p}', '{kind}')")
    return each.select("doc", "path", F.lower("key").alias("verb"), part("operationId", "string").alias("operation"), part("n", "bigint").alias("n"), F.to_json(F.expr("try_variant_get(op, '$[\"x-api-intel\"]', 'variant')")).alias("extension"), "summary")


# --- the integrity of snapshots: two analyses of methods (customers), classes (suppliers) and assertions (orders) --------

_SNAPSHOT = """
src AS (SELECT 'a' || s_suppkey % 2 AS a, 'source:' || s_suppkey AS id, 'h' || s_suppkey % 7 AS hash FROM supplier),
cls AS (SELECT 'a' || s_suppkey % 2 AS a, 'class:' || s_suppkey AS id, 'source:' || CASE WHEN s_suppkey % 23 = 0 THEN s_suppkey + 100000000 WHEN s_suppkey % 19 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS src, s_suppkey % 4 <> 1 AS guard, 'evidence:' || s_suppkey AS ev FROM supplier),
grd AS (SELECT 'a' || s_suppkey % 2 AS a, 'guard:' || s_suppkey AS id, 'class:' || s_suppkey AS cls FROM supplier WHERE s_suppkey % 3 = 0),
evi AS (SELECT 'a' || s_suppkey % 2 AS a, 'evidence:' || s_suppkey AS id, 'source:' || s_suppkey AS src, 'h' || CASE WHEN s_suppkey % 13 = 0 THEN 99 ELSE s_suppkey % 7 END AS hash, CASE WHEN s_suppkey % 17 = 0 THEN 4 ELSE 5 END AS ends, CASE WHEN s_suppkey % 9 = 0 THEN 'call_site' ELSE 'declaration' END AS role FROM supplier),
one AS (SELECT 'a' || c_custkey % 2 AS a, CASE WHEN c_custkey % 41 = 0 THEN 'methd:' ELSE 'method:' END || c_custkey AS id, CASE WHEN c_custkey % 37 = 0 THEN 'evidence:' ELSE 'class:' END || (c_custkey % 2 + 2 * (c_custkey % 40)) AS cls, 'evidence:' || (c_custkey % 2 + 2 * (c_custkey % 30)) AS ev, 's' AS sig, c_custkey AS k FROM customer),
met AS (SELECT a, id, cls, ev, sig FROM one UNION ALL SELECT a, id, cls, ev, sig FROM one WHERE k % 53 = 0 UNION ALL SELECT a, id, cls, ev, 't' FROM one WHERE k % 59 = 0),
ass AS (SELECT 'a' || o_orderkey % 2 AS a, 'assertion:' || o_orderkey AS id, 'method:' || o_custkey AS s, CASE o_orderkey % 3 WHEN 0 THEN 'METHOD_CALLS_METHOD' WHEN 1 THEN 'ENDPOINT_USES_GUARD' ELSE 'BAD' END AS p, CASE WHEN o_orderkey % 31 > 0 THEN 'method:' || (o_custkey + 2) END AS o,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN o_orderkey % 29 = 0 THEN [] WHEN o_orderkey % 43 = 0 THEN ['evidence:' || o_orderkey % 40, 'evidence:' || o_orderkey % 40] ELSE ['evidence:' || o_orderkey % 40] END AS ev FROM orders),
ids AS (SELECT a, id, 'source' AS kind, hash AS content FROM src UNION ALL SELECT a, id, 'class', src FROM cls UNION ALL SELECT a, id, 'guard', cls FROM grd UNION ALL SELECT a, id, 'evidence', hash FROM evi UNION ALL SELECT a, id, 'method', sig FROM met UNION ALL SELECT a, id, 'assertion', id FROM ass),
refs AS (SELECT a, id, 'sourceFileId' AS path, src AS ref, 'source' AS kind FROM cls UNION ALL SELECT a, id, 'declarationEvidenceId', ev, 'evidence' FROM cls UNION ALL SELECT a, id, 'classId', cls, 'class' FROM grd UNION ALL SELECT a, id, 'fileId', src, 'source' FROM evi
  UNION ALL SELECT a, id, 'classId', cls, 'class' FROM met UNION ALL SELECT a, id, 'declarationEvidenceId', ev, 'evidence' FROM met UNION ALL SELECT a, id, 'evidenceIds', unnest(ev), 'evidence' FROM ass
  UNION ALL SELECT a, id, 'subjectId', s, CASE p WHEN 'METHOD_CALLS_METHOD' THEN 'method' WHEN 'ENDPOINT_USES_GUARD' THEN 'endpoint' END FROM ass UNION ALL SELECT a, id, 'objectId', o, CASE p WHEN 'METHOD_CALLS_METHOD' THEN 'method' WHEN 'ENDPOINT_USES_GUARD' THEN 'guard' END FROM ass WHERE o IS NOT NULL)"""


@bound(f"""WITH {_SNAPSHOT}, i AS (
SELECT a, 'RECORD_ID_KIND_MISMATCH' AS code, id, NULL AS path FROM ids WHERE NOT starts_with(id, kind || ':')
UNION ALL SELECT a, CASE WHEN count(DISTINCT (kind, content)) = 1 THEN 'DUPLICATE_RECORD_ID' ELSE 'STABLE_ID_COLLISION' END, id, NULL FROM ids GROUP BY a, id HAVING count(*) > 1
UNION ALL SELECT r.a, 'MISSING_REFERENCE', r.id, path FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.a = r.a AND ids.id = ref)
UNION ALL SELECT r.a, 'REFERENCE_KIND_MISMATCH', r.id, path FROM refs r JOIN ids ON ids.a = r.a AND ids.id = ref AND ids.kind <> r.kind
UNION ALL SELECT a, 'DUPLICATE_REFERENCE', id, 'evidenceIds' FROM ass WHERE len(ev) > 1
UNION ALL SELECT g.a, 'CLASS_ROLE_MISMATCH', g.id, 'classId' FROM grd g JOIN cls ON cls.a = g.a AND cls.id = g.cls AND NOT guard
UNION ALL SELECT r.a, 'EVIDENCE_ROLE_MISMATCH', r.id, path FROM refs r JOIN evi ON evi.a = r.a AND evi.id = ref AND role <> 'declaration' WHERE path = 'declarationEvidenceId'
UNION ALL SELECT a, 'MISSING_ASSERTION_TARGET', id, 'objectId' FROM ass WHERE o IS NULL AND status <> 'unresolved' UNION ALL SELECT a, 'RESOLVED_ASSERTION_WITHOUT_EVIDENCE', id, 'evidenceIds' FROM ass WHERE status = 'resolved' AND len(ev) = 0
UNION ALL SELECT evi.a, 'EVIDENCE_HASH_MISMATCH', evi.id, 'contentHash' FROM evi JOIN src ON src.a = evi.a AND src.id = evi.src AND src.hash <> evi.hash UNION ALL SELECT a, 'INVALID_EVIDENCE_RANGE', id, NULL FROM evi WHERE ends < 5
UNION ALL SELECT a, 'SCHEMA_INVALID', id, 'predicate' FROM ass WHERE p = 'BAD') SELECT DISTINCT a AS analysis, code, id, path FROM i""")
def snapshot_integrity(spark, sf):
    """Thirteen codes of issues, in two analyses whose records don't see each other."""
    t = lambda n: table(spark, sf, n)
    name = lambda kind, x: F.concat(F.lit(kind), x.cast("string"))
    s, k, o = c("s_suppkey"), c("c_custkey"), c("o_orderkey")
    of = lambda n, df, **columns: catalogue.family(df.select(*[v.alias(x) for x, v in columns.items()]), n)
    sup, a = t("supplier"), name("a", s % 2)
    one = t("customer").select(name("a", k % 2).alias("analysis"), F.concat(F.when(k % 41 == 0, "methd:").otherwise("method:"), k.cast("string")).alias("id"), F.concat(F.when(k % 37 == 0, "evidence:").otherwise("class:"), (k % 2 + 2 * (k % 40)).cast("string")).alias("classId"), name("evidence:", k % 2 + 2 * (k % 30)).alias("declarationEvidenceId"), F.lit("s").alias("signature"), k.alias("k"))
    methods = one.unionByName(one.where("k % 53 = 0")).unionByName(one.where("k % 59 = 0").withColumn("signature", F.lit("t")))
    e = name("evidence:", o % 40)
    status, third = c("o_orderstatus"), o % 3
    families = {
        "sourceFiles": of("sourceFiles", sup, analysis=a, id=name("source:", s), contentHash=name("h", s % 7)),
        "classes": of("classes", sup, analysis=a, id=name("class:", s), sourceFileId=name("source:", F.when(s % 23 == 0, s + 100000000).when(s % 19 == 0, s + 1).otherwise(s)), roles=F.when(s % 4 == 0, F.array(F.lit("guard"))).when(s % 4 == 1, F.array(F.lit("entity"))).otherwise(F.array(F.lit("guard"), F.lit("entity"))), declarationEvidenceId=name("evidence:", s)),
        "guards": of("guards", sup.where(s % 3 == 0), analysis=a, id=name("guard:", s), classId=name("class:", s)),
        "evidence": of("evidence", sup, analysis=a, id=name("evidence:", s), fileId=name("source:", s), contentHash=name("h", F.when(s % 13 == 0, 99).otherwise(s % 7)), startLine=F.lit(5), startColumn=F.lit(1), endLine=F.when(s % 17 == 0, 4).otherwise(5), endColumn=F.lit(2), role=F.when(s % 9 == 0, "call_site").otherwise("declaration")),
        "methods": catalogue.family(methods.drop("k"), "methods"),
        "assertions": of("assertions", t("orders"), analysis=name("a", o % 2), id=name("assertion:", o), subjectId=name("method:", c("o_custkey")), predicate=F.when(third == 0, "METHOD_CALLS_METHOD").when(third == 1, "ENDPOINT_USES_GUARD").otherwise("BAD"), objectId=F.when(o % 31 > 0, name("method:", c("o_custkey") + 2)), status=F.when(status == "F", "resolved").when(status == "O", "ambiguous").otherwise("unresolved"), evidenceIds=F.when(o % 29 == 0, F.array().cast("array<string>")).when(o % 43 == 0, F.array(e, e)).otherwise(F.array(e))),
    }
    return integrity.issues(families)
