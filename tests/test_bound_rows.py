"""Bound queries on rows that the test tables don't have, against their SQL."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from factweave.operators import diff, flow, graph, impact, iterate, metrics, paths, scenes
from factweave.plans import bindings, facts  # noqa: F401


def agrees(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    df = bindings.QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(df.columns)} from ({bindings.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert want and Counter(got) == Counter(want)


def test_evidence_columns_of_short_texts(spark, tmp_path):
    texts = [None, "", "a", "ab", "abc", "a\nb", "\r\n", "\U0001f600"]
    agrees(spark, tmp_path, "evidence_columns", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_reasons_count_endpoints_and_paths_of_either_side(spark):
    rows = [("before", "s", "e1", "p1", False), ("before", "s", "e1", "p1", True), ("before", "s", "e1", "p2", False), ("after", "s", "e1", "p1", False), ("after", "s", "e2", "", False)]
    reasons = spark.createDataFrame([(*r[:3], "c", "k", "x", None, *r[3:]) for r in rows], "side string, slot string, endpoint string, category string, code string, subject string, source string, steps string, incomplete boolean")
    got = impact.gathered(reasons)
    assert sorted(tuple(r) for r in got.select("category", "before", "after", "paths").collect()) == [("c", 1, 2, 4), ("unknown_due_to_incomplete_trace", 1, 0, 1)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()  # no path is shuffled several times


def test_paths_over_edges_of_one_id_are_found_once(spark):
    edge = "id string, predicate string, subject string, object string, status string"
    edges = [("i", paths.IMPLEMENTED, "e", "m", "resolved"), ("c", paths.CALLS, "m", "n", "resolved"), ("c", paths.CALLS, "m", "n", "resolved")]
    df = spark.createDataFrame
    none = df([], "interaction string, kind string, mode string, job string")
    for own, n in ((edges, 1), (edges[:2], 1)):
        g = paths.Graph(df(own, edge), df([("e",)], "endpoint string"), none, df([], "node string"))
        got = [tuple(r) for r in paths.endpoint_paths(g, df([("n",), ("e",)], "target string")).collect()]
        assert sorted(got) == [("e", "e", [], False, False)] + [("n", "e", ["i", "c"], True, False)] * n


def test_a_bucketed_table_is_not_shuffled_again(spark):
    edges = iterate.bucketed(spark.range(100).selectExpr("id % 7 as object", "'s' as side", "id as n"), "object", "side")
    at = spark.range(3).selectExpr("id as node", "'s' as side").hint("merge").alias("a")
    met = at.join(edges.alias("s"), [F.col("a.node") == F.col("s.object"), F.col("a.side") == F.col("s.side")])
    assert met.count() == 44 and met._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # of the other side, once in either plan
    assert sorted(r["n"] for r in edges.collect()) == list(range(100))


def test_a_closure_deals_its_pairs_once(spark):
    before = {t.name for t in spark.catalog.listTables()}
    found = graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 2)], "a int, b int"))
    assert sorted(tuple(r) for r in found.collect()) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    assert len({t.name for t in spark.catalog.listTables()} - before) == 1


def test_influences_group_only_sinks_of_several_places_again(spark):
    frame = "scope string, method string, calls array<string>, depth int, origins array<struct<parameter:string,origin:string>>"
    frames = spark.createDataFrame([("s", "m", ["b", "c"], 2, [("x", "q")]), ("s", "m", ["d"], 1, [("x", "q")]), ("s", "n", ["a"], 1, [("x", "q")]), ("s", "m", [], 0, [("x", "root")])], frame)
    sinks = spark.createDataFrame([("one", "m", "x", "k"), ("one", "m", "x", "k"), ("two", "m", "x", "k"), ("two", "n", "x", "k")], "sink string, method string, parameter string, column string")
    met = flow.influences(frames, sinks)
    assert sorted(tuple(r) for r in met.collect()) == [("s", "one", "k", "q", "d"), ("s", "two", "k", "q", "a")]
    assert met._jdf.queryExecution().optimizedPlan().toString().strip().startswith("Union")  # the met rows of the others are the result


def test_carried_origins_deal_the_calls_once(spark):
    before = {t.name for t in spark.catalog.listTables()}
    roots = spark.createDataFrame([("s", "r", [("p", "q")])], "scope string, method string, origins array<struct<parameter:string,origin:string>>")
    calls = [(f"{a}{b}", a, b, [("p", "p")], "resolved", False, False, False, True) for a, b in ("ra", "rb", "ab", "ba", "rc")]
    calls = spark.createDataFrame(calls, "call string, method string, target string, args array<struct<source:string,target:string>>, status string, spread boolean, callback boolean, rest boolean, body boolean")
    found, notes = flow.carried_origins(roots, calls, frames=3)
    assert sorted(tuple(r) for r in found.select("ord", "method", "calls").collect()) == [(1, "r", []), (2, "a", ["ra"]), (3, "b", ["rb"])]
    assert [tuple(r) for r in notes.collect()] == [("s", "frame_limit", "c", None)]
    assert len({t.name for t in spark.catalog.listTables()} - before) == 1


def test_a_scene_walks_its_edges_once(spark):
    edges = spark.createDataFrame([("r", "1", "r", "a", 0, ["e1", "x"]), ("r", "2", "a", "b", 0, ["e2"]), ("r", "3", "r", "c", 0, ["e3"]), ("r", "4", "a", "r", 1, []), ("q", "5", "y", "z", 0, ["e5"])], "root string, edge_id string, subject string, object string, rank int, evidence array<string>")
    nodes = spark.createDataFrame([("r", "r", ["n"]), ("r", "a", None), ("r", "b", ["m"]), ("p", "p", ["k"]), ("q", "q", [])], "root string, node string, evidence array<string>")
    own, held, kept, omitted = scenes.scene(nodes, edges, 2, 2, 3)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(own) == [("r", "1", 1, ["e1", "x"]), ("r", "4", 2, [])]
    assert rows(held) == [("p", "p", ["k"]), ("q", "q", []), ("r", "a", None), ("r", "r", ["n"])]
    assert rows(kept) == [("p", "k", 1), ("r", "e1", 1), ("r", "n", 2), ("r", "x", 3)]
    assert rows(omitted) == [("p", 0, 0, 0), ("q", 0, 1, 0), ("r", 1, 2, 0)]
    for df in (own, held, kept, omitted):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(iterate, "ROWS", 10)
    assert iterate.parts(spark.range(95), spark.range(1)) == 10 and iterate.parts(spark.range(3)) == 4
    edges = spark.createDataFrame([("r", "P", "o", "resolved"), ("o", "C", "part:1", "ambiguous"), ("o", "C", "part:1", "resolved")], "subject string, predicate string, object string, status string")
    roots = spark.createDataFrame([("r",)], "root string")
    found = graph.terminal_facts(edges, roots, 2, "part:", 9)
    assert [tuple(r) for r in found.collect()] == [("r", "part:1", "resolved", 1)]
    reach = graph.bounded_reach(edges, roots, 2, 9)
    assert sorted(tuple(r) for r in reach.collect()) == [("r", "o", 1), ("r", "part:1", 2), ("r", "r", 0)]
    assert ", 9), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert metrics.degrees(edges, 9).rdd.getNumPartitions() == 9


def test_records_without_a_key_are_spread_by_their_slots(spark):
    side = spark.range(50).selectExpr("id as slot", "cast(null as string) as key")
    out = diff.slot_matching(side, side, ["slot"], "key", n=9)
    assert {(r["outcome"], r["n"]) for r in out.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {("same_slot", 50)}
    assert re.search(r"RepartitionByExpression \[key#\d+, spread#\d+L\], 9", out._jdf.queryExecution().optimizedPlan().toString())
