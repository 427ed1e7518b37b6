"""Canonical JSON, OpenAPI round trips, patterns, containment, scenes and data flow on hand-made cases."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.operators import document, flow, match, openapi, paths, scenes, stitch


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_canonical_json_is_that_of_sorted_keys(spark):
    kind = "struct<b:array<struct<z:int,a:string>>,Z:double,m:map<string,array<int>>,e:array<int>,n:string,t:boolean>"
    value = {"b": [{"z": 1, "a": 'q"\\\n '}, {"z": None, "a": ""}], "Z": 2.0, "m": {"～": [1], "\U0001f600": [], "a": [3, 4]}, "e": [], "n": None, "t": True}
    df = spark.createDataFrame([(value,)], f"v {kind}")
    order = lambda x: {k: order(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-16-be"))} if isinstance(x, dict) else [order(y) for y in x] if isinstance(x, list) else x
    want = order({**value, "Z": 2})
    for indent in (2, 0):
        got = df.select(document.canonical_json(F.col("v"), df.schema["v"].dataType, indent)).first()[0]
        assert got == json.dumps(want, ensure_ascii=False, indent=indent or None, separators=(",", ": " if indent else ":"))
    assert list(json.loads(got)["m"]) == ["a", "\U0001f600", "～"]


def test_positions_are_those_of_one_sort(spark):
    names = [f"{c}{i % 5}" for i in range(40) for c in ("b", "\U0001f600", "～", "")]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").repartition(5)
    got = {r["i"]: r["position"] for r in document.in_order(df, "name", 7).collect()}
    want = sorted(range(len(names)), key=lambda i: (names[i].encode("utf-16-be"), i))
    assert [got[i] for i in want] == list(range(1, len(names) + 1))


def test_openapi_documents_come_back_with_extensions(spark):
    doc = {"openapi": "3.0.3", "info": {"title": "t", "x": [1, {"y": None}]}, "paths": {"/a/": {"get": {"operationId": "one", "x-api-intel": 1}, "summary": "s", "POST": {}}, "/b/{id}": {"get": {"tags": ["q"]}}, "/c": {"get": {}}, "/c/": {"get": {}}}, "tags": []}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, '{"openapi": "2.0", "paths": {}}'), (4, '{"openapi": "3.1.0", "paths": {"x": {}}}'), (5, '{"openapi": "3.1.0", "paths": {}}')], "doc int, text string")
    assert rows(openapi.readable(docs)) == [(1, "supported"), (2, "malformed"), (3, "unsupported_version"), (4, "invalid_path"), (5, "supported")]
    ends = spark.createDataFrame([(1, "e1", "GET", "a", True), (1, "e2", "GET", "/b/:id", False), (1, "e3", "POST", "/a", True), (1, "e4", "POST", "a/", True), (1, "e5", "GET", "/none", True), (1, "e6", "GET", "c", True)], "doc int, endpoint string, verb string, path string, resolved boolean")
    ops, left = openapi.matched(openapi.operations(docs), ends)
    assert rows(ops.select("path", "verb", "resolution")) == [("/a/", "GET", "resolved"), ("/a/", "POST", "ambiguous"), ("/b/{id}", "GET", "unresolved"), ("/c", "GET", "ambiguous"), ("/c/", "GET", "ambiguous")]
    assert rows(left.select("endpoint")) == [("e5",)]
    facts = spark.createDataFrame([(1, "e1", '{"dbReads":["t"]}')], "doc int, endpoint string, fields string")
    out = {r["doc"]: json.loads(r["text"]) for r in openapi.written_back(docs, openapi.extensions(ops, facts, "1")).collect()}
    assert set(out) == {1, 5} and out[5] == {"openapi": "3.1.0", "paths": {}}
    want = json.loads(json.dumps(doc))
    other = lambda how, *ids: {"schemaVersion": "1", "resolution": how, "candidateEndpointIds": list(ids)}
    want["paths"]["/a/"]["get"]["x-api-intel"] = {"schemaVersion": "1", "resolution": "resolved", "endpointId": "e1", "dbReads": ["t"]}
    want["paths"]["/a/"]["POST"]["x-api-intel"] = other("ambiguous", "e3", "e4")
    want["paths"]["/b/{id}"]["get"]["x-api-intel"] = other("unresolved", "e2")
    want["paths"]["/c"]["get"]["x-api-intel"] = want["paths"]["/c/"]["get"]["x-api-intel"] = other("ambiguous", "e6")
    assert out[1] == want


@pytest.mark.parametrize(
    "name, pattern, delimiter, hit",
    [("order.created", "order.*", ".", True), ("order.item.created", "order.*", ".", False), ("order", "order.**", ".", True), ("order.item.created", "order.**", ".", True), ("order::created", "order::*", "::", True), ("order.created", "order.cre*", ".", False), ("order.created", "order.*", "", False),
     ("a::b:c::d", "**::d", "::", True), ("a::b", "**::x::**", "::", False), ("a::x::b", "**::x::**", "::", True), ("x", "**::x::**", "::", True), ("", "*", "::", True), ("a\x1fb::c", "*::c", "::", True), ("a\\u::c", "a\x1f::*", "::", False), ("a+b::c", "a+b::*", "::", True), ("a.b", "*.*.**", ".", True), ("a", "*.*.**", ".", False)],
)
def test_wildcards(spark, name, pattern, delimiter, hit):
    p, h = spark.createDataFrame([(1, name)], "producer int, name string"), spark.createDataFrame([(2, pattern)], "handler int, pattern string")
    found = match.wildcard_match(p, h, delimiter) if delimiter else h.where(match.valid_pattern(F.col("pattern"), delimiter))
    assert bool(found.count()) == hit


def test_containment_finds_each_pair_once_in_any_width(spark):
    spans = [(0, 5), (3, 3), (255, 257), (0, 70_000), (65_000, 66_000), (-300, 300), (100, 99), (0, 2**33), (2**32, 2**32 + 5)]
    df = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate(spans)], "file string, id int, start long, end long")
    got = match.contained(df.withColumnRenamed("id", "inner_id"), df.withColumnRenamed("id", "outer_id"), ["file"])
    want = [(i, o) for i, (a, b) in enumerate(spans) for o, (x, y) in enumerate(spans) if x <= a and b <= y and x <= y]
    assert rows(got) == sorted(want, key=str)


def test_containment_in_one_file_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(match, "SIDE", 8, raising=False)
    monkeypatch.setattr(match, "FEW", 2, raising=False)
    spans = [(n % 7, n % 7 + n % 50) for n in range(150)] + [(0, 3000), (None, 4), (2, None)] + [(3, 9)] * 5
    df = spark.createDataFrame([("f" if n % 30 else None, n, a, b) for n, (a, b) in enumerate(spans)], "file string, id int, start long, end long")
    got = match.contained(df.withColumnRenamed("id", "inner_id"), df.withColumnRenamed("id", "outer_id"), ["file"]).withColumn("task", F.spark_partition_id()).collect()
    held = [(n, a, b) for n, (a, b) in enumerate(spans) if n % 30 and a is not None and b is not None]
    assert sorted((r["inner_id"], r["outer_id"]) for r in got) == sorted((i, o) for i, a, b in held for o, x, y in held if x <= a and b <= y)
    most = Counter(r["task"] for r in got).most_common(1)[0][1]
    assert most < len(got) / 4  # pairs, of one file and two bins, that no task makes all of


def test_a_scene_keeps_first_evidence_before_any_other(spark):
    nodes = spark.createDataFrame([("r", "r", ["z1", "a1"]), ("r", "x", ["z2", "b1"]), ("r", "y", ["c1"]), ("r", "w", ["d1"])], "root string, node string, evidence array<string>")
    edges = spark.createDataFrame([("r", "1", "r", "x", 0, ["z3", "a2"]), ("r", "2", "y", "w", 1, ["e1"]), ("r", "3", "x", "y", 2, ["z4"])], "root string, edge_id string, subject string, object string, rank int, evidence array<string>")
    e, n, kept, omitted = scenes.scene(nodes, edges, max_nodes=3, max_edges=5, max_evidence=6)
    assert rows(e.select("edge_id", "evidence")) == [("1", ["z3"]), ("3", ["z4"])]
    # first evidence of r, x, y and of edges 1 and 3, then one more, the least of the rest
    assert [r["id"] for r in kept.orderBy("position").collect()] == ["c1", "z1", "z2", "z3", "z4", "a1"]
    assert rows(n.select("node", "evidence")) == [("r", ["a1", "z1"]), ("x", ["z2"]), ("y", ["c1"])]
    assert rows(omitted) == [("r", 1, 1, 2)]


def test_a_consumer_without_a_job_takes_every_job(spark):
    p = spark.createDataFrame([(1, "q", "a", None, True, False), (2, "q", "b", None, True, True), (3, "z", "a", None, True, False)], "producer int, contract string, job string, realm string, eligible boolean, single boolean")
    c = spark.createDataFrame([(7, "q", None, None), (8, "q", "b", None), (9, "q", "c", None)], "consumer int, contract string, job string, realm string")
    assert [(r["producer"], r["state"], r["candidates"]) for r in stitch.correlate(p, c).orderBy("producer").collect()] == [(1, "target_only_candidate", 1), (2, "ambiguous", 2), (3, "unmatched", 0)]
    assert rows(stitch.leftovers(p, c)) == [(9, "consumer_only")]


def test_paths_stop_at_impossible_branches_and_budgets(spark):
    edge = lambda i, p, a, b, s="resolved": (i, p, a, b, s)
    E = [edge("1", paths.IMPLEMENTED, "end", "m"), edge("2", "METHOD_INITIATES_INTERACTION", "m", "i"), edge("3", paths.MATCHES, "i", "h"), edge("4", "HANDLER_IMPLEMENTED_BY", "h", "w"), edge("5", paths.CALLS, "w", "x"), edge("6", paths.CALLS, "w", "y"), edge("7", paths.CALLS, "y", "x", "ambiguous"), edge("8", "CLASS_INJECTS_CLASS", "m", "x")]
    df = spark.createDataFrame
    g = paths.Graph(
        df(E, "id string, predicate string, subject string, object string, status string"), df([("end",)], "endpoint string"), df([("i", "job_queue", None, "mail")], "interaction string, kind string, mode string, job string"), df([("h",)], "node string"),
        df([("5", "b1", "exact_jobs", ["other"]), ("6", "b2", "exact_jobs", ["mail"])], "edge string, branch string, selector string, jobs array<string>"),
    )
    at = df([("x",)], "target string")
    got = paths.endpoint_paths(g, at)
    assert rows(got.select("endpoint", F.array_join("steps", ""), "transitive", "unsure")) == [("end", "123467", True, True)]
    assert paths.endpoint_paths(g, at, calls=1).count() == 0 and paths.endpoint_paths(g, at, hops=0).count() == 0


def test_flow_limits(spark):
    df = spark.createDataFrame
    d = df([("s", "t", 0, "T")], "scope string, method string, parameter int, terminal string")
    e = df([("s", "a", 0, "1", "t", 0), ("s", "b", 0, "2", "a", 0), ("s", "a", 0, "3", "b", 0), ("s", "c", 0, "4", "b", 0), ("s", "z", 0, "5", "t", 0), ("s", "z", 0, "5", "a", 0)], "scope string, method string, parameter int, call string, target string, target_parameter int")
    found, issues = flow.forwarded(d, e, hops=2, candidates=1)
    assert rows(found.select("method", "hops", "proof")) == [("a", 1, "a|0:1>t|0:terminal"), ("b", 2, "b|0:2>a|0:1>t|0:terminal"), ("t", 0, "t|0:terminal")]
    assert rows(issues.select("kind", "method", "call")) == [("candidate_limit", "z", "5"), ("cycle", "a", "3"), ("hop_limit", "c", "4")]
    assert rows(flow.forwarded(d, e, hops=2, candidates=1, states=2)[1].select("kind", "method")) == [("candidate_limit", "z"), ("state_limit", "b")]
    with pytest.raises(ValueError):
        flow.forwarded(d, e, states=0)
