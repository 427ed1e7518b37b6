"""Small hand-made cases of the fact-graph operators."""

from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import diff, graph, match, stitch, validate
from factweave.sources import snapshots


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edge(spark, pairs):
    return spark.createDataFrame([(a, "CALLS", b, s) for a, b, s in pairs], "subject string, predicate string, object string, status string")


def test_reach_stops_at_depth_and_cycles(spark):
    e = edge(spark, [("s", "a", "resolved"), ("a", "b", "ambiguous"), ("b", "c", "resolved"), ("c", "d", "resolved"), ("b", "s", "resolved"), ("s", "x", "unresolved")])
    r = graph.bounded_reach(e, spark.createDataFrame([("s",)], "root string"), 3)
    assert rows(r) == [("s", "a", 1), ("s", "b", 2), ("s", "c", 3), ("s", "s", 0)]
    assert rows(graph.depth_limits(e, r, 3)) == [("s", "c", 1)]


def test_trace_resets_depth_at_a_dispatch_and_cuts_cycles(spark):
    e = edge(spark, [("r", "a", "resolved"), ("a", "b", "resolved"), ("b", "c", "resolved"), ("c", "d", "resolved"), ("w", "r", "resolved")])
    sends = spark.createDataFrame([("c", "w", "queue"), ("w", "v", "event"), ("v", "u", "queue")], "subject string, object string, kind string")
    states, cuts = graph.trace(e, sends, spark.createDataFrame([("r",)], "root string"))
    got = rows(states.select("node", "depth", "hop", "cause"))
    assert ("w", 0, 1, "distributed") in got and ("v", 0, 2, "distributed") in got
    assert not [g for g in got if g[0] in ("d", "u")]
    assert rows(cuts.select("node", "stop", "n")) == [("c", "depth_limit", 1), ("v", "hop_limit", 1), ("w", "cycle", 1)]


def test_patterns(spark):
    names = spark.createDataFrame([(1, "order.created"), (2, "order.item.created"), (3, "order"), (4, "order.")], "producer int, name string")
    patterns = spark.createDataFrame([(1, "order.*"), (2, "order.**"), (3, "order.cre*"), (4, "*")], "handler int, pattern string")
    got = rows(match.wildcard_match(names, patterns).select("producer", "handler"))
    assert got == [(1, 1), (1, 2), (2, 2), (3, 2), (3, 4), (4, 1), (4, 2)]


def test_branch_states(spark):
    d = spark.createDataFrame([("exact_jobs", ["a"], "a"), ("exact_jobs", ["a"], "b"), ("unmatched_jobs", ["a"], "b"), ("unmatched_jobs", ["a"], "a"), ("all_jobs", [], None), ("exact_jobs", ["a"], None)], "s string, j array<string>, job string")
    got = [r[0] for r in d.select(match.branch_state(F.col("s"), F.col("j"), F.col("job"))).collect()]
    assert got == ["matches", "does_not_match", "matches", "does_not_match", "matches", "unknown"]


def test_diff_marks_ambiguous_and_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (3, "x"), (None, "z")], "k int, v string")
    assert rows(diff.keyed_diff(a, b, ["k"], ["v"])) == [(1, "modified", "v"), (2, "ambiguous", None), (3, "added", None)]


def test_correlation_cascade(spark):
    p = spark.createDataFrame([(1, "q", "r", True, True), (2, "q", None, True, True), (3, "z", None, True, True), (4, "q", "r", False, True), (5, "q", "other", True, True)], "producer int, contract string, realm string, eligible boolean, single boolean")
    c = spark.createDataFrame([(9, "q", "r")], "consumer int, contract string, realm string")
    assert [r[1:3] for r in rows(stitch.correlate(p, c))] == [("declared_realm_candidate", None), ("target_only_candidate", None), ("unmatched", "producer_only"), ("unmatched", "unsupported_identity"), ("unmatched", "realm_mismatch")]


def test_order_gaps(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "g string, o int")
    assert rows(validate.order_gaps(d, "g", "o", 0)) == [("b", 1)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normalize_route(F.lit("//a//:id/"))) == "/a/:id"
    assert one(T.route_to_openapi(F.lit("a/:id"), "/api")) == "/api/a/{id}"
    assert one(T.url_target(F.lit("https://u:p@h/x?a=1#f"))) == "https://h/x"
    assert one(T.route_to_openapi(F.lit("a/:1/:b"), "/api")) == "/api/a/:1/{b}"
    for url, want in [("https://u@x:p@h/y", "https://h/y"), ("//u:p@h/y", "//h/y"), ("?a=1", None), ("http://a/b://u@c", "http://a/b://u@c"), ("a/x@y", "a/x@y")]:
        assert one(T.url_target(F.lit(url))) == want
    for text, want in [
        ('token = "abc" password: xyz', 'token = "[REDACTED]" password: xyz'),
        ("secret = 'abc'", "secret = '[REDACTED]'"),
        ("token: `abc`", "token: `[REDACTED]`"),
        ('authorization: "abc"', 'authorization: "[REDACTED]"'),
        ('password == "abc"', 'password == "[REDACTED]"'),
        ("https://u:p@h", "https://u:[REDACTED]@h"),
        ("bearer a.b", "Bearer [REDACTED]"),
        ("-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "[REDACTED PRIVATE KEY]"),
    ]:
        assert one(T.redact(F.lit(text))) == want
    assert one(T.snippet(F.lit("\t secret = 'abcdefghij' \n"), 14)) == "secret = '[RE…" and one(T.snippet(F.lit("ab"), 1)) == "…"
    assert one(T.json_string(F.lit('a"\\\n\x1f'))) == '"a\\"\\\\\\n\\u001f"'
    assert one(T.semantic_key("k", F.lit(1), F.lit("x"), F.lit(True), F.lit(None))) == '["k",1,"x",true,null]'
    for path, want in [("a/./b//c/../d", "a/b/d"), ("..", None), ("a/../..", None), ("/a", None), ("C:\\a", None), ("a/..", "."), ("a\\b", "a/b")]:
        assert one(T.repository_path(F.lit(path))) == want
    assert tuple(one(T.line_and_column(F.lit("ab\r\nc\nd"), F.lit(7)))) == (3, 2) and one(T.line_and_column(F.lit("a"), F.lit(2))) is None
    assert one(T.csv_cell(F.lit('=a,"b"'))) == '"\'=a,""b"""'


def test_snapshots_unavailable_is_not_empty(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"schemaVersion": "1.0.0", "resultState": "completed", "endpoints": [{"id": "e", "httpMethod": "GET", "path": "/"}], "assertions": []}')
    s = snapshots.read_snapshots(spark, str(tmp_path / "s.json"))
    assert rows(snapshots.family(s, "endpoints").select("id", "path")) == [("e", "/")]
    states = dict(rows(snapshots.availability(s).select("family", "state")))
    assert states["assertions"] == "available" and states["evidence"] == "unavailable"


def test_inventory_and_csv(spark, tmp_path):
    (tmp_path / "in" / "dist").mkdir(parents=True)
    for name, data in (("a.ts", b"x"), ("b.md", b"x"), ("c.ts", b"a\0b"), ("dist/d.ts", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r["reason"] for r in snapshots.inventory(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.ts": None, "b.md": "unsupported_extension", "c.ts": "binary", "d.ts": "excluded_directory"}
    snapshots.write_csv(spark.createDataFrame([("=1",)], "c string"), str(tmp_path / "out"))
    assert b"'=1" in b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))


def test_diagnostics_are_new_resolved_or_changed(spark):
    schema = "code string, subject string, location string, severity string, message string"
    a = spark.createDataFrame([("C", "s", "1", "info", "m"), ("C", "s", "2", "info", "m"), ("D", "s", "1", "info", "m")], schema)
    b = spark.createDataFrame([("C", "s", "1", "error", "m"), ("C", None, "3", "info", "m"), ("D", "s", "1", "info", "m")], schema)
    got = {(r["subject"], r["location"], r["change"], r["reasons"]) for r in diff.diagnostic_changes(a, b).collect()}
    assert got == {("s", "1", "changed", "severity"), ("s", "2", "resolved", None), (None, "3", "new", None)}


def test_system_paths_follow_only_candidates(spark):
    p = spark.createDataFrame([(1, "k", "r"), (2, "k", "r"), (3, "k", "z")], "producer int, contract string, realm string").withColumn("eligible", F.lit(True)).withColumn("single", F.lit(False))
    c = spark.createDataFrame([(7, "k", "r")], "consumer int, contract string, realm string")
    reached = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 3)], "root string, producer int")
    effects = spark.createDataFrame([(7, "write"), (7, "write"), (8, "read")], "consumer int, effect string")
    got = [tuple(r) for r in stitch.system_paths(reached, p, stitch.correlate(p, c), c, effects).collect()]
    assert got == [("a", "k", "r", "declared_realm_candidate", 2, 7, "write")]


def test_endpoint_changes_carry_digests_of_long_parts(spark):
    long = "\n".join(f"t{n}" for n in range(40))
    schema = "endpoint int, slot string, key string, identity string, " + ", ".join(f"{p} string" for p in diff.PARTS)
    side = lambda *parts: spark.createDataFrame([(n, f"s{n}", f"k{n}", "resolved", "m", None, "", p, None, None) for n, p in enumerate(parts)], schema)
    got = diff.endpoint_changes(side(long, long, "", None, long[:32]), side(long, long + "x", None, None, long[:33]))
    assert sorted((r["before"], r["after"], r["reasons"]) for r in got.collect()) == [(1, 1, "terminals"), (2, 2, "terminals"), (4, 4, "terminals")]
    assert "sha2" in got._jdf.queryExecution().optimizedPlan().toString()
