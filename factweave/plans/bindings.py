"""Operators bound to tables: the queries and the SQL that an independent engine checks them with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import text as T
from factweave.operators import diff, graph, match, metrics, policy, scenes, stitch, validate
from factweave.operators.iterate import dealt, parts
from factweave.sources import snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def bound(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


# --- the fact graph: region -> nation -> customer -> order -> part -----------------------------


def edges(spark: SparkSession, sf: str, orders: bool = True) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    parts = [
        t("nation").select(name("region:", "n_regionkey").alias("subject"), F.lit("HAS_NATION").alias("predicate"), name("nation:", "n_nationkey").alias("object"), F.lit("resolved").alias("status")),
        t("customer").select(name("nation:", "c_nationkey"), F.lit("HAS_CUSTOMER"), name("customer:", "c_custkey"), F.when(F.col("c_acctbal") < 0, "ambiguous").otherwise("resolved")),
        t("orders").select(name("customer:", "o_custkey"), F.lit("PLACES"), name("order:", "o_orderkey"), F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "ambiguous").otherwise("unresolved")),
    ]
    if orders:
        parts.append(t("lineitem").select(name("order:", "l_orderkey"), F.lit("CONTAINS"), name("part:", "l_partkey"), F.lit("resolved")))
    return reduce(DataFrame.union, parts)


def edge_parts(spark: SparkSession, sf: str) -> int:
    """The partitions that all edges take."""
    return parts(*[table(spark, sf, n) for n in ("nation", "customer", "orders", "lineitem")])


EDGES = """edges AS (
  SELECT 'region:' || n_regionkey AS subject, 'HAS_NATION' AS predicate, 'nation:' || n_nationkey AS object, 'resolved' AS status FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'HAS_CUSTOMER', 'customer:' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'ambiguous' ELSE 'resolved' END FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'PLACES', 'order:' || o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'ambiguous' ELSE 'unresolved' END FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'CONTAINS', 'part:' || l_partkey, 'resolved' FROM lineitem),
live AS (SELECT DISTINCT subject, object, status FROM edges WHERE status IN ('resolved', 'ambiguous'))"""
REACH = f"""RECURSIVE {EDGES},
walk(root, node, depth) AS (
  SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 0 FROM region
  UNION SELECT w.root, l.object, w.depth + 1 FROM walk w JOIN live l ON l.subject = w.node WHERE w.depth < 3),
reach AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)"""


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("root"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("root"))


@bound(f"WITH {REACH} SELECT * FROM reach")
def bounded_reach(spark, sf):
    return graph.bounded_reach(edges(spark, sf), regions(spark, sf), 3, edge_parts(spark, sf))


@bound(f"""WITH {REACH} SELECT r.root, r.node, count(DISTINCT l.object) AS hidden FROM reach r JOIN live l ON l.subject = r.node
WHERE r.depth = 3 AND NOT EXISTS (SELECT 1 FROM reach k WHERE k.root = r.root AND k.node = l.object) GROUP BY r.root, r.node""")
def depth_limit_diagnostics(spark, sf):
    e = edges(spark, sf)
    return graph.depth_limits(e, graph.bounded_reach(e, regions(spark, sf), 3, edge_parts(spark, sf)), 3)


@bound(f"""WITH RECURSIVE {EDGES}, sure AS (SELECT DISTINCT subject AS a, object AS b FROM edges WHERE status = 'resolved'),
c(a, b) AS (SELECT a, b FROM sure UNION SELECT c.a, s.b FROM c JOIN sure s ON s.a = c.b) SELECT * FROM c""")
def resolved_closure(spark, sf):
    e = edges(spark, sf).where("status = 'resolved'")
    return graph.closure(e.select(F.col("subject").alias("a"), F.col("object").alias("b")))


@bound(f"""WITH {EDGES}, p AS (
  SELECT a.subject AS root, b.object AS terminal, a.object AS via, greatest(CAST(a.status = 'ambiguous' AS INT), CAST(b.status = 'ambiguous' AS INT)) AS unsure
  FROM edges a JOIN edges b ON b.subject = a.object WHERE a.predicate = 'PLACES' AND a.status <> 'unresolved' AND b.predicate = 'CONTAINS')
SELECT root, terminal, CASE WHEN min(unsure) = 0 THEN 'resolved' ELSE 'ambiguous' END AS status, count(DISTINCT via) AS contributors FROM p GROUP BY root, terminal""")
def terminal_facts(spark, sf):
    return graph.terminal_facts(edges(spark, sf), customers(spark, sf), 2, "part:", edge_parts(spark, sf))


@bound(f"""WITH {EDGES} SELECT DISTINCT c.object AS target, a.subject AS start, a.subject || '>' || b.subject || '>' || c.subject || '>' || c.object AS path
FROM live c JOIN live b ON b.object = c.subject JOIN live a ON a.object = b.subject
WHERE c.object LIKE 'part:%' AND a.subject LIKE 'nation:%'""")
def simple_paths(spark, sf):
    targets = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("target"))
    return graph.simple_paths(edges(spark, sf), targets, 3, "nation:")


@bound(f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE status = 'resolved')
SELECT node, sum(o) AS fan_out, sum(i) AS fan_in FROM (SELECT subject AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT object, 0, 1 FROM e) GROUP BY node""")
def adjacency_degree(spark, sf):
    return metrics.degrees(edges(spark, sf))


REACH_COUNTS = f"""WITH {REACH}, counts AS (SELECT n.node, coalesce(c.roots, 0) AS roots FROM
  (SELECT DISTINCT object AS node FROM edges WHERE predicate <> 'CONTAINS') n LEFT JOIN (SELECT node, count(DISTINCT root) AS roots FROM reach GROUP BY node) c USING (node))"""


def _reach_counts(spark, sf):
    e = edges(spark, sf, orders=False)
    return metrics.reach_counts(e.select(F.col("object").alias("node")).distinct(), graph.bounded_reach(e, regions(spark, sf), 3))


@bound(f"{REACH_COUNTS} SELECT * FROM counts")
def reach_metrics(spark, sf):
    return _reach_counts(spark, sf)


DEGREE = "WITH d AS (SELECT c_custkey AS node, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"


def _orders_each(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("node")).join(o, "node", "left").na.fill(0, ["n"])


@bound(f"{DEGREE} SELECT CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.75) AS BIGINT) AS p75, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90 FROM d")
def metric_legends(spark, sf):
    return metrics.legend(_orders_each(spark, sf), "n")


@bound(f"""{DEGREE}, l AS (SELECT quantile_disc(n, 0.5) AS a, quantile_disc(n, 0.75) AS b, quantile_disc(n, 0.9) AS c FROM d)
SELECT node, n, CASE WHEN n = 0 THEN 'zero' WHEN n <= a THEN 'low' WHEN n <= b THEN 'medium' WHEN n <= c THEN 'high' ELSE 'very_high' END AS band FROM d, l""")
def heat_bands(spark, sf):
    return metrics.heat(_orders_each(spark, sf), "n")


_OWNERSHIP = """WITH o AS (SELECT l_partkey AS subject, count(DISTINCT l_suppkey) AS n, bool_and(l_returnflag <> 'R' OR l_quantity < 40) AS certain FROM lineitem WHERE l_partkey % 3 > 0 AND l_suppkey % 20 = 0 GROUP BY 1)
SELECT p_partkey AS subject, CASE WHEN NOT coalesce(certain, true) THEN 'ownership_unknown' WHEN n = 1 THEN 'uniquely_owned' WHEN n > 1 THEN 'multiple_owners' ELSE '{none}' END AS state,
coalesce(n, 0) AS n_owners FROM part LEFT JOIN o ON subject = p_partkey"""


def _owned(spark, sf, modules):
    lines = table(spark, sf, "lineitem").where("l_partkey % 3 > 0 and l_suppkey % 20 = 0")
    owners = lines.select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("owner"), ((F.col("l_returnflag") != "R") | (F.col("l_quantity") < 40)).alias("certain"))
    return metrics.ownership(table(spark, sf, "part").select(F.col("p_partkey").alias("subject")), owners, modules)


@bound(_OWNERSHIP.format(none="not_declared_by_supported_modules"))
def ownership_state(spark, sf):
    """Parts owned by every twentieth supplier; all modules (nations) are complete."""
    return _owned(spark, sf, table(spark, sf, "nation").select(F.col("n_nationkey").alias("module"), F.lit(True).alias("complete")))


@bound(_OWNERSHIP.format(none="ownership_unknown"))
def ownership_with_gaps(spark, sf):
    """One incomplete module makes it unknown whether parts without an owner have one."""
    return _owned(spark, sf, table(spark, sf, "nation").select(F.col("n_nationkey").alias("module"), (F.col("n_nationkey") != 7).alias("complete")))


IMPORTS = """imports AS (SELECT a.n_nationkey AS module, b.n_nationkey AS imported FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey // 2 WHERE a.n_nationkey > 0 AND a.n_nationkey % 3 <> 0),
reexports AS (SELECT module, imported AS exported FROM imports WHERE module % 2 = 0)"""


def _imports(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey > 0 and n_nationkey % 3 <> 0")
    return n.select(F.col("n_nationkey").alias("module"), F.expr("n_nationkey div 2").cast("int").alias("imported"))


@bound(f"WITH RECURSIVE {IMPORTS}, c(a, b) AS (SELECT module, exported FROM reexports UNION SELECT c.a, r.exported FROM c JOIN reexports r ON r.module = c.b) SELECT * FROM c")
def export_closure(spark, sf):
    return graph.closure(_imports(spark, sf).where("module % 2 = 0").select(F.col("module").alias("a"), F.col("imported").alias("b")))


@bound(f"""WITH RECURSIVE {IMPORTS}, c(a, b) AS (SELECT module, exported FROM reexports UNION SELECT c.a, r.exported FROM c JOIN reexports r ON r.module = c.b),
owns AS (SELECT DISTINCT c_nationkey AS module, c_mktsegment AS item FROM customer WHERE c_acctbal < 0),
gives AS (SELECT * FROM owns UNION SELECT c.a, o.item FROM c JOIN owns o ON o.module = c.b),
v AS (SELECT module, item, 0 AS o FROM owns UNION ALL SELECT i.module, g.item, 1 FROM imports i JOIN gives g ON g.module = i.imported
  UNION ALL SELECT m.module, g.item, 2 FROM (SELECT DISTINCT module FROM owns) m, (SELECT DISTINCT item FROM gives WHERE module = 0) g)
SELECT module, item, CASE min(o) WHEN 0 THEN 'own' WHEN 1 THEN 'imported' ELSE 'global' END AS origin FROM v GROUP BY module, item""")
def visibility(spark, sf):
    imports = _imports(spark, sf)
    owns = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("module"), F.col("c_mktsegment").alias("item")).distinct()
    everywhere = values(spark, [(0,)], "module int")
    return graph.visibility(owns, imports, imports.where("module % 2 = 0").select("module", F.col("imported").alias("exported")), everywhere)


@bound(f"""WITH RECURSIVE {IMPORTS}, c(a, b) AS (SELECT module, imported FROM imports UNION SELECT c.a, i.imported FROM c JOIN imports i ON i.module = c.b),
m AS (SELECT n_nationkey AS module, n_nationkey % 7 <> 2 AS complete FROM nation)
SELECT module, bool_and(complete) AS complete FROM (SELECT * FROM m UNION ALL SELECT c.a, m.complete FROM c JOIN m ON m.module = c.b) GROUP BY module""")
def completeness_closure(spark, sf):
    modules = table(spark, sf, "nation").select(F.col("n_nationkey").alias("module"), (F.col("n_nationkey") % 7 != 2).alias("complete"))
    return graph.completeness(modules, _imports(spark, sf))


def _traced(spark, sf):
    """Customers call their orders; orders send events, or queue jobs, on to their lines' suppliers."""
    calls = edges(spark, sf, orders=False).where("predicate = 'PLACES'").select("subject", "predicate", "object", "status")
    lines = table(spark, sf, "lineitem")
    sends = lines.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("subject"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("object"), F.when(F.col("l_returnflag") == "R", "queue").otherwise("event").alias("kind"))
    return graph.trace(calls, sends.distinct(), customers(spark, sf), max_depth=3, max_hops=2)


_TRACE_SQL = f"""WITH {EDGES}, r AS (SELECT 'customer:' || c_custkey AS root FROM customer),
c AS (SELECT DISTINCT r.root, l.object AS node FROM r JOIN live l ON l.subject = r.root),
s AS (SELECT DISTINCT c.root, 'supplier:' || l_suppkey AS node, CASE WHEN l_returnflag = 'R' THEN 'distributed' ELSE 'asynchronous' END AS cause FROM c JOIN lineitem ON c.node = 'order:' || l_orderkey),
a AS (SELECT root, root AS node, 0 AS depth, 0 AS hop, 'synchronous' AS cause FROM r UNION ALL SELECT root, node, 1, 0, 'synchronous' FROM c UNION ALL SELECT root, node, 0, 1, cause FROM s)"""


@bound(f"{_TRACE_SQL} SELECT * FROM a")
def trace_states(spark, sf):
    return _traced(spark, sf)[0].select("root", "node", "depth", "hop", "cause")


@bound(f"{_TRACE_SQL} SELECT root, cause, count(DISTINCT node) AS nodes, max(hop) AS hops FROM a GROUP BY root, cause")
def trace_causal_summary(spark, sf):
    return _traced(spark, sf)[0].groupBy("root", "cause").agg(F.countDistinct("node").alias("nodes"), F.max("hop").alias("hops"))


@bound(f"{_TRACE_SQL} SELECT root, node AS terminal, cause, min(hop) AS hop FROM a WHERE node LIKE 'supplier:%' GROUP BY ALL")
def trace_terminals(spark, sf):
    return _traced(spark, sf)[0].where("node like 'supplier:%'").groupBy("root", F.col("node").alias("terminal"), "cause").agg(F.min("hop").alias("hop"))


# --- matching ----------------------------------------------------------------------------------

PATTERNS = [(1, "click.*"), (2, "*.1"), (3, "**"), (4, "purchase.**"), (5, "error.2"), (6, "view.cre*"), (7, "*"), (8, "**.3")]


def _named(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("producer"), F.concat_ws(".", "event_type", (F.col("user_id") % 4).cast("string")).alias("name"), "event_type", (F.col("user_id") % 7).alias("k"))


@bound(f"""SELECT event_id AS producer, h.handler, event_type || '.' || (user_id % 4) AS target_key FROM events
JOIN ({_sql_values([(1, "click.1"), (2, "error.2"), (3, "view.0"), (4, "view.0")])}) h(handler, target_key) ON h.target_key = event_type || '.' || (user_id % 4) WHERE user_id % 7 <> 0""")
def exact_match(spark, sf):
    p = _named(spark, sf).select("producer", F.col("name").alias("target_key"), (F.col("k") == 0).alias("dynamic"))
    h = values(spark, [(1, "click.1", False), (2, "error.2", False), (3, "view.0", False), (4, "view.0", False), (5, "view.0", True)], "handler int, target_key string, dynamic boolean")
    return match.exact_match(p, h)


@bound(f"""WITH n AS (SELECT event_id AS producer, event_type || '.' || (user_id % 4) AS name FROM events),
r(handler, pattern, regex) AS ({_sql_values([(1, "click.*", r"^click\.[^.]*$"), (2, "*.1", r"^[^.]*\.1$"), (3, "**", ".*"), (4, "purchase.**", r"^purchase(\..*)?$"), (7, "*", r"^[^.]*$"), (8, "**.3", r"^(.*\.)?3$")])})
SELECT producer, handler, name, pattern FROM n JOIN r ON regexp_matches(name, regex)""")
def wildcard_match(spark, sf):
    return match.wildcard_match(_named(spark, sf), values(spark, PATTERNS, "handler int, pattern string"))


QUEUES = [(1, "bull", "q0", None), (2, "bull", "q1", "click"), (3, "sqs", "q1", None), (4, "bull", "q2", "view"), (5, "bull", "q0", "error")]


@bound(f"""SELECT event_id AS producer, h.handler FROM events JOIN ({_sql_values(QUEUES)}) h(handler, technology, queue, job)
ON h.technology = 'bull' AND h.queue = 'q' || (user_id % 3) AND (h.job IS NULL OR h.job = event_type)""")
def queue_match(spark, sf):
    p = table(spark, sf, "events").select(F.col("event_id").alias("producer"), F.lit("bull").alias("technology"), F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("queue"), F.col("event_type").alias("job"))
    return match.queue_match(p, values(spark, QUEUES, "handler int, technology string, queue string, job string"))


MESSAGES = [(1, "request", "click", "tcp"), (2, "request", "click", "tcp"), (3, "event", "view", "tcp"), (4, "event", "view", "redis"), (5, "request", "error", None), (6, "request", "purchase", "nats"), (7, "event", "view", "tcp")]
_SENT = "p AS (SELECT event_id AS producer, CASE WHEN event_type = 'view' THEN 'event' ELSE 'request' END AS mode, event_type AS pattern, CASE user_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'redis' END AS transport FROM events)"
_HANDLED = f"h(handler, mode, pattern, transport) AS ({_sql_values(MESSAGES)})"
_MATCHED = "m AS (SELECT producer, handler, p.mode FROM p JOIN h USING (mode, pattern, transport))"


def _messages(spark, sf):
    e = table(spark, sf, "events")
    p = e.select(F.col("event_id").alias("producer"), F.when(F.col("event_type") == "view", "event").otherwise("request").alias("mode"), F.col("event_type").alias("pattern"), F.when(F.col("user_id") % 3 == 0, "tcp").when(F.col("user_id") % 3 == 1, "redis").alias("transport"))
    return p, values(spark, MESSAGES, "handler int, mode string, pattern string, transport string")


@bound(f"WITH {_SENT}, {_HANDLED}, {_MATCHED} SELECT * FROM m")
def message_match(spark, sf):
    return match.message_match(*_messages(spark, sf))


@bound(f"WITH {_SENT}, {_HANDLED}, {_MATCHED} SELECT *, CASE WHEN mode = 'request' AND count(*) OVER (PARTITION BY producer) > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM m")
def ambiguous_match(spark, sf):
    return match.marked_ambiguous(match.message_match(*_messages(spark, sf)))


@bound(f"""WITH {_SENT}, {_HANDLED}, {_MATCHED} SELECT producer FROM p WHERE producer NOT IN (SELECT producer FROM m)
AND EXISTS (SELECT 1 FROM h WHERE h.mode = p.mode AND h.pattern = p.pattern AND h.transport IS DISTINCT FROM p.transport)""")
def transport_mismatch(spark, sf):
    p, h = _messages(spark, sf)
    return match.transport_mismatch(p, h, match.message_match(p, h))


SELECTORS = [("a", "exact_jobs", "click,view"), ("b", "all_jobs", ""), ("c", "unmatched_jobs", "click,error"), ("d", "unknown", "")]


@bound(f"""WITH s(branch, selector, jobs) AS ({_sql_values(SELECTORS)}), e AS (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN event_type END AS job FROM events)
SELECT event_id, branch, CASE WHEN selector = 'all_jobs' THEN 'matches' WHEN selector = 'unknown' OR job IS NULL THEN 'unknown'
WHEN list_contains(string_split(jobs, ','), job) = (selector = 'exact_jobs') THEN 'matches' ELSE 'does_not_match' END AS state FROM e, s""")
def branch_selection(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 5 > 0, F.col("event_type")).alias("job"))
    s = values(spark, SELECTORS, "branch string, selector string, jobs string")
    return e.crossJoin(F.broadcast(s)).select("event_id", "branch", match.branch_state(F.col("selector"), F.split("jobs", ","), F.col("job")).alias("state"))


def _by_user(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("producer"), F.col("event_id").alias("handler"))


@bound("SELECT * FROM (SELECT user_id AS producer, event_id AS handler, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS matches FROM events) WHERE nth <= 5")
def capped_fanout(spark, sf):
    return match.capped(_by_user(spark, sf), 5)


@bound("SELECT user_id AS producer, count(*) AS matches, count(*) - 5 AS dropped FROM events GROUP BY user_id HAVING count(*) > 5")
def fanout_overflow(spark, sf):
    return match.overflow(_by_user(spark, sf), 5)


@bound("""SELECT i.l_linenumber AS inner_id, o.l_linenumber AS outer_id, i.l_orderkey AS o FROM lineitem i JOIN lineitem o ON i.l_orderkey = o.l_orderkey
AND (i.l_linenumber, i.l_quantity) >= (o.l_linenumber, 0.0) AND (i.l_linenumber, i.l_quantity + 1) <= (o.l_linenumber + 1, o.l_quantity)""")
def interval_containment(spark, sf):
    pair = lambda a, b: F.struct(a.cast("int").alias("line"), b.cast("double").alias("col"))
    li = table(spark, sf, "lineitem")
    inner = li.select("l_orderkey", F.struct("l_linenumber", "l_orderkey").alias("inner_id"), pair(F.col("l_linenumber"), F.col("l_quantity")).alias("start"), pair(F.col("l_linenumber"), F.col("l_quantity") + 1).alias("end"))
    outer = li.select("l_orderkey", F.col("l_linenumber").alias("outer_id"), pair(F.col("l_linenumber"), F.lit(0.0)).alias("start"), pair(F.col("l_linenumber") + 1, F.col("l_quantity")).alias("end"))
    return match.contained(inner, outer, ["l_orderkey"]).select("inner_id.l_linenumber", "outer_id", F.col("inner_id.l_orderkey").alias("o")).withColumnRenamed("l_linenumber", "inner_id")


GUARDS = [("global", None, 2, "throttle"), ("global", None, 1, "auth"), ("class", "Brand#11", 0, "roles"), ("class", "Brand#11", 0, "audit"), ("own", "7", 0, "owner"), ("own", "8", 0, "auth2")]


@bound(f"""WITH g(scope, k, ord, guard) AS ({_sql_values(GUARDS)}), s AS (SELECT p_partkey AS subject, p_brand, CAST(p_size AS VARCHAR) AS own FROM part),
a AS (SELECT subject, guard, scope, ord, 0 AS o FROM s, g WHERE scope = 'global' UNION ALL SELECT subject, guard, scope, ord, 1 FROM s JOIN g ON scope = 'class' AND k = p_brand
UNION ALL SELECT subject, guard, scope, ord, 2 FROM s JOIN g ON scope = 'own' AND k = own)
SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY o, ord, guard) AS position, guard, scope FROM a""")
def guard_precedence(spark, sf):
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("subject"), F.col("p_brand").alias("class_key"), F.col("p_size").cast("string").alias("own_key"))
    return match.guards_in_order(s, values(spark, GUARDS, "scope string, key string, ord int, guard string"))


@bound("""SELECT n_name AS origin, c_mktsegment AS segment, p_brand AS column_name, o_orderpriority AS sink, count(*) AS influences, count(DISTINCT o_orderkey) AS paths
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
GROUP BY ALL""")
def provenance_star(spark, sf):
    t = lambda n: table(spark, sf, n)
    n, line = parts(t("lineitem"), t("orders")), ["l_orderkey", "p_brand"]
    brands = t("part").select("p_partkey", "p_brand")
    lines = dealt(t("lineitem").select("l_orderkey", "l_partkey"), n, "l_partkey").join(dealt(brands, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select(*line)
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "c_mktsegment")
    orders = dealt(t("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), n, "o_custkey").join(dealt(people, n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    # lines and orders meet last, so an order's paths are counted where its lines are
    star = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = [F.col("n_name").alias("origin"), F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("column_name"), F.col("o_orderpriority").alias("sink")]
    each = star.groupBy("o_orderkey", "n_name", "c_mktsegment", "p_brand", "o_orderpriority").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("influences"), F.count("*").alias("paths"))


POLICY_SETS = [("p1", 3), ("p1", 5), ("p1", 8), ("p2", 8), ("p2", 13), ("p3", 21)]


@bound(f"SELECT DISTINCT l_orderkey AS subject, policy FROM lineitem JOIN ({_sql_values(POLICY_SETS)}) p(policy, member) ON l_partkey = member")
def array_overlap_attribution(spark, sf):
    sets = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("subject")).agg(F.collect_set("l_partkey").alias("members"))
    p = values(spark, POLICY_SETS, "policy string, member long").groupBy("policy").agg(F.collect_set("member").alias("members"))
    return match.overlap_attribution(sets, p)


SLOTS = [("1-URGENT", "F"), ("1-URGENT", "F"), ("2-HIGH", "O"), ("9-NONE", "F"), ("5-LOW", "P")]


@bound(f"""WITH a AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS lefts FROM orders GROUP BY 1, 2),
b AS (SELECT priority, status, count(*) AS rights FROM ({_sql_values(SLOTS)}) v(priority, status) GROUP BY 1, 2)
SELECT priority, status, coalesce(lefts, 0) AS lefts, coalesce(rights, 0) AS rights, CASE WHEN rights IS NULL THEN 'unmatched_left' WHEN lefts IS NULL THEN 'unmatched_right'
WHEN lefts = 1 AND rights = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM a FULL JOIN b USING (priority, status)""")
def slot_outer_match(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return match.slot_match(left, values(spark, SLOTS, "priority string, status string"), ["priority", "status"])


# --- two snapshots -----------------------------------------------------------------------------

SNAPSHOTS = """a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 21 = 0 THEN 'none' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 10 <> 1)"""


def _snapshots(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    b = o.where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 21 == 0, "none").otherwise(F.col("o_orderpriority")).alias("priority"))
    return a, b


@bound(f"""WITH {SNAPSHOTS}, d AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS change,
concat_ws(',', CASE WHEN a.status <> b.status THEN 'status' END, CASE WHEN a.priority <> b.priority THEN 'priority' END) AS reasons FROM a FULL JOIN b ON a.k = b.k)
SELECT k, change, CASE WHEN change = 'modified' THEN reasons END AS reasons FROM d WHERE change <> 'modified' OR reasons <> ''""")
def keyed_diff(spark, sf):
    return diff.keyed_diff(*_snapshots(spark, sf), ["k"], ["status", "priority"])


@bound(f"WITH {SNAPSHOTS}, d AS (SELECT concat_ws(',', CASE WHEN a.status <> b.status THEN 'status' END, CASE WHEN a.priority <> b.priority THEN 'priority' END) AS reasons FROM a JOIN b ON a.k = b.k) SELECT reasons, count(*) AS n FROM d WHERE reasons <> '' GROUP BY reasons")
def modification_reasons(spark, sf):
    return keyed_diff(spark, sf).where("change = 'modified'").groupBy("reasons").agg(F.count("*").alias("n"))


@bound(f"WITH {SNAPSHOTS} SELECT a.k, a.status AS before_status, b.status AS after_status FROM a JOIN b ON a.k = b.k WHERE a.status <> b.status")
def status_changes(spark, sf):
    return diff.status_changes(*_snapshots(spark, sf), "k", "status")


_SLOTTED = """a AS (SELECT c_mktsegment AS segment, c_nationkey + 100 * (c_custkey // 40) AS nation, c_name AS name FROM customer),
b AS (SELECT c_mktsegment AS segment, c_nationkey + 100 * (c_custkey // 40) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS nation, CASE WHEN c_custkey % 4 = 0 THEN c_name || '!' ELSE c_name END AS name FROM customer),
blocked AS (SELECT segment, nation FROM a GROUP BY 1, 2 HAVING count(*) > 1 UNION SELECT segment, nation FROM b GROUP BY 1, 2 HAVING count(*) > 1),
fa AS (SELECT * FROM a WHERE (segment, nation) NOT IN (FROM blocked)), fb AS (SELECT * FROM b WHERE (segment, nation) NOT IN (FROM blocked)),
k AS (SELECT fb.* FROM fa JOIN fb ON fa.name = fb.name), la AS (SELECT * FROM fa WHERE name NOT IN (SELECT name FROM k)), lb AS (SELECT * FROM fb WHERE name NOT IN (SELECT name FROM k)),
s AS (SELECT lb.* FROM la JOIN lb USING (segment, nation))"""


_DIAGNOSTICS = """q AS (SELECT CASE status WHEN 'O' THEN 'AMBIGUOUS_ORDER' WHEN 'P' THEN 'UNRESOLVED_ORDER' ELSE 'UNKNOWN_ORDER' END AS code, 'order:' || k AS subject, 'line:1' AS location, priority AS severity, status AS message, side FROM (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b) WHERE status <> 'F')"""


@bound(f"""WITH {SNAPSHOTS}, {_DIAGNOSTICS}, x AS (SELECT * FROM q WHERE side = 0), y AS (SELECT * FROM q WHERE side = 1)
SELECT code, subject, location, CASE WHEN x.side IS NULL THEN 'new' WHEN y.side IS NULL THEN 'resolved' ELSE 'changed' END AS change, CASE WHEN x.side IS NOT NULL AND y.side IS NOT NULL THEN 'severity' END AS reasons
FROM x FULL JOIN y USING (code, subject, location) WHERE x.severity IS DISTINCT FROM y.severity""")
def diagnostic_changes(spark, sf):
    def diagnostics(df):
        code = F.when(F.col("status") == "O", "AMBIGUOUS_ORDER").when(F.col("status") == "P", "UNRESOLVED_ORDER").otherwise("UNKNOWN_ORDER")
        return df.where("status <> 'F'").select(code.alias("code"), F.concat(F.lit("order:"), F.col("k").cast("string")).alias("subject"), F.lit("line:1").alias("location"), F.col("priority").alias("severity"), F.col("status").alias("message"))

    return diff.diagnostic_changes(*map(diagnostics, _snapshots(spark, sf)))


@bound(f"""WITH {_SLOTTED} SELECT *, 'same_key' AS outcome FROM k UNION ALL SELECT *, 'same_slot' FROM s
UNION ALL SELECT *, 'removed' FROM la WHERE (segment, nation) NOT IN (SELECT segment, nation FROM s) UNION ALL SELECT *, 'removed' FROM a WHERE (segment, nation) IN (FROM blocked)
UNION ALL SELECT *, 'added' FROM lb WHERE (segment, nation) NOT IN (SELECT segment, nation FROM s) UNION ALL SELECT *, 'added' FROM b WHERE (segment, nation) IN (FROM blocked)
UNION ALL SELECT segment, nation, NULL, 'ambiguous' FROM blocked""")
def endpoint_matching(spark, sf):
    c = table(spark, sf, "customer")
    nation = F.col("c_nationkey") + 100 * F.floor(F.col("c_custkey") / 40)
    a = c.select(F.col("c_mktsegment").alias("segment"), nation.alias("nation"), F.col("c_name").alias("name"))
    b = c.select(F.col("c_mktsegment").alias("segment"), (nation + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).alias("nation"), F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return diff.slot_matching(a, b, ["segment", "nation"], "name")


# Keys repeat within a side, in slots of their own; some aren't known, and some identities are ambiguous.
_REPEATED = """a AS (SELECT o_orderkey AS slot, CASE WHEN o_orderkey % 11 > 0 THEN 'k' || o_orderkey // CASE WHEN o_orderkey % 100 < 30 THEN 2 ELSE 1 END END AS key, o_orderkey % 17 = 0 AS unsure FROM orders WHERE o_orderkey % 13 > 0
  UNION ALL SELECT o_orderkey, 'twin' || o_orderkey, false FROM orders WHERE o_orderkey % 29 = 0),
b AS (SELECT o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 100000000 ELSE 0 END AS slot, CASE WHEN o_orderkey % 7 > 0 THEN 'k' || o_orderkey // CASE WHEN o_orderkey % 100 < 20 THEN 2 ELSE 1 END ELSE 'new' || o_orderkey END AS key, o_orderkey % 19 = 0 AS unsure FROM orders WHERE o_orderkey % 23 > 0)"""


@bound(f"""WITH {_REPEATED}, u AS (SELECT *, 0 AS later FROM a UNION ALL SELECT *, 1 FROM b), r AS (SELECT *, row_number() OVER () AS id FROM u),
blocked AS (SELECT slot FROM a GROUP BY slot HAVING count(*) > 1 UNION SELECT slot FROM b GROUP BY slot HAVING count(*) > 1),
open AS (SELECT * FROM r WHERE slot NOT IN (FROM blocked) AND NOT unsure), several AS (SELECT DISTINCT key FROM open WHERE key IS NOT NULL GROUP BY key, later HAVING count(*) > 1),
exact AS (SELECT x.id AS x, y.id AS y FROM open x JOIN open y ON x.key = y.key AND x.later = 0 AND y.later = 1 WHERE x.key NOT IN (FROM several)),
rest AS (SELECT * FROM open WHERE id NOT IN (SELECT x FROM exact) AND id NOT IN (SELECT y FROM exact) AND (key IS NULL OR key NOT IN (FROM several))),
slotted AS (SELECT x.id AS x, y.id AS y FROM rest x JOIN rest y ON x.slot = y.slot AND x.later = 0 AND y.later = 1)
SELECT slot, key, CASE WHEN id IN (SELECT y FROM exact) THEN 'same_key' WHEN id IN (SELECT y FROM slotted) THEN 'same_slot' WHEN later = 1 THEN 'added' ELSE 'removed' END AS outcome FROM r WHERE id NOT IN (SELECT x FROM exact) AND id NOT IN (SELECT x FROM slotted)
UNION ALL SELECT slot, NULL, 'ambiguous' FROM blocked UNION ALL SELECT slot, key, 'ambiguous_identity' FROM r WHERE unsure AND slot NOT IN (FROM blocked) UNION ALL SELECT NULL, key, 'ambiguous_key' FROM several""")
def endpoint_matching_repeated(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    s = lambda x: x.cast("string")
    keyed = lambda bound: F.concat(F.lit("k"), s(F.floor(k / F.when(k % 100 < bound, 2).otherwise(1))))
    a = o.where(k % 13 > 0).select(k.alias("slot"), F.when(k % 11 > 0, keyed(30)).alias("key"), (k % 17 == 0).alias("unsure"))
    a = a.unionByName(o.where(k % 29 == 0).select(k.alias("slot"), F.concat(F.lit("twin"), s(k)).alias("key"), F.lit(False).alias("unsure")))
    b = o.where(k % 23 > 0).select((k + F.when(k % 5 == 0, 100000000).otherwise(0)).alias("slot"), F.when(k % 7 > 0, keyed(20)).otherwise(F.concat(F.lit("new"), s(k))).alias("key"), (k % 19 == 0).alias("unsure"))
    return diff.slot_matching(a, b, ["slot"], "key", F.col("unsure"), parts(o, o))


@bound("SELECT c_mktsegment AS kind, c_nationkey AS key, count(*) AS records, string_agg(DISTINCT CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS members FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def ambiguity_groups(spark, sf):
    return diff.collisions(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("key"), "c_custkey"), "kind", "key", "c_custkey")


@bound("""WITH a AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 6 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change,
CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'hash' END AS reasons FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.hash IS DISTINCT FROM b.hash""")
def source_changes(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    b = d.where("doc_id % 10 <> 1").select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("hash"))
    return diff.keyed_diff(a, b, ["doc_id"], ["hash"])


CHANGED = "changed AS (SELECT 'part:' || p_partkey AS item FROM part UNION ALL SELECT 'part:none')"


def _impact(spark, sf):
    changed = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("target")).union(values(spark, [("part:none",)], "target string"))
    return changed, graph.simple_paths(edges(spark, sf), changed, 2, "customer:")


@bound(f"""WITH {EDGES}, {CHANGED} SELECT b.subject AS endpoint, item AS source, 'reached_through_calls' AS code, count(DISTINCT a.subject) AS paths
FROM changed JOIN live a ON a.object = item JOIN live b ON b.object = a.subject WHERE b.subject LIKE 'customer:%' GROUP BY 1, 2""")
def impact_reasons(spark, sf):
    return _impact(spark, sf)[1].groupBy(F.col("start").alias("endpoint"), F.col("target").alias("source")).agg(F.countDistinct("path").alias("paths")).withColumn("code", F.lit("reached_through_calls"))


@bound(f"""WITH {EDGES}, {CHANGED} SELECT item AS source, 'no_endpoint_path' AS code FROM changed WHERE item NOT IN
(SELECT a.object FROM live a JOIN live b ON b.object = a.subject WHERE b.subject LIKE 'customer:%' AND a.object LIKE 'part:%')""")
def unreachable_changes(spark, sf):
    changed, paths = _impact(spark, sf)
    return changed.join(paths, "target", "left_anti").select(F.col("target").alias("source"), F.lit("no_endpoint_path").alias("code"))


# --- policies ----------------------------------------------------------------------------------

FEATURES = """f AS (SELECT c_custkey AS subject, count(*) FILTER (o_orderstatus = 'F') AS writes, count(*) FILTER (o_orderstatus = 'O') AS unsure, count(*) FILTER (o_orderpriority = '1-URGENT') AS guards,
count(*) FILTER (o_orderpriority = '2-HIGH') AS unsure_guards, count(*) FILTER (o_orderstatus = 'P') AS gaps, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"""
_GUARD = "CASE WHEN writes = 0 AND unsure = 0 THEN 'not_applicable' WHEN writes = 0 THEN 'unknown' WHEN guards > 0 THEN 'pass' WHEN unsure_guards > 0 THEN 'unknown' ELSE 'fail' END"
_TRACED = "CASE WHEN writes > 0 AND gaps > 0 THEN 'fail' WHEN writes > 0 THEN 'pass' WHEN unsure > 0 OR gaps > 0 THEN 'unknown' ELSE 'not_applicable' END"
_REPOSITORY = "CASE WHEN n > 20 THEN 'unknown' WHEN guards > 5 THEN 'fail' WHEN unsure_guards > 5 THEN 'unknown' ELSE 'pass' END"
_AUTHORIZED = "CASE WHEN n = 0 THEN 'not_applicable' WHEN writes = n THEN 'pass' ELSE 'unknown' END"
_RULES = {"guard_on_write": _GUARD, "complete_trace": _TRACED, "repository_access": _REPOSITORY, "authorization": _AUTHORIZED}


def _features(spark, sf):
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    o = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy(F.col("c_custkey").alias("subject")).agg(
        is_("o_orderstatus", "F").alias("writes"), is_("o_orderstatus", "O").alias("unsure"), is_("o_orderpriority", "1-URGENT").alias("guards"), is_("o_orderpriority", "2-HIGH").alias("unsure_guards"), is_("o_orderstatus", "P").alias("gaps"), F.count("o_orderkey").alias("n")
    )


def _rule_sql(rule: str, outcome: str, source: str = "f") -> str:
    return f"""SELECT '{rule}' AS rule, subject, o AS outcome, CASE WHEN o = 'unknown' THEN 'warning' ELSE 'error' END AS severity, o = 'fail' AS blocking FROM (SELECT subject, {outcome} AS o FROM {source})"""


def _outcomes():
    c = F.col
    return {
        "guard_on_write": policy.guard_on_write(c("writes"), c("unsure"), c("guards"), c("unsure_guards")),
        "complete_trace": policy.complete_write_trace(c("writes"), c("unsure"), c("gaps")),
        "repository_access": policy.repository_access(F.when(c("n") > 20, 2).otherwise(1), F.when(c("guards") > 5, 1).otherwise(0), F.when(c("unsure_guards") > 5, 1).otherwise(0)),
        "authorization": policy.authorization(c("n"), c("writes")),
    }


@bound(f"WITH {FEATURES} {_rule_sql('guard_on_write', _GUARD)}")
def policy_guard_on_write(spark, sf):
    return policy.evaluated(_features(spark, sf), "guard_on_write", _outcomes()["guard_on_write"])


@bound(f"WITH {FEATURES} {_rule_sql('complete_trace', _TRACED)}")
def policy_complete_trace(spark, sf):
    return policy.evaluated(_features(spark, sf), "complete_trace", _outcomes()["complete_trace"])


@bound(f"WITH {FEATURES} {_rule_sql('repository_access', _REPOSITORY)}")
def policy_repository_access(spark, sf):
    return policy.evaluated(_features(spark, sf), "repository_access", _outcomes()["repository_access"])


@bound(f"WITH {FEATURES} {_rule_sql('authorization', _AUTHORIZED)}")
def policy_authorization(spark, sf):
    return policy.evaluated(_features(spark, sf), "authorization", _outcomes()["authorization"])


@bound(f"""WITH {FEATURES}, r AS ({" UNION ALL ".join(_rule_sql(k, v) for k, v in _RULES.items())})
SELECT rule, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) FILTER (outcome = 'not_applicable') AS not_applicable, count(*) FILTER (blocking) AS blocking FROM r GROUP BY rule""")
def policy_summary(spark, sf):
    f = _features(spark, sf)
    return policy.summary(reduce(DataFrame.unionByName, [policy.evaluated(f, k, v) for k, v in _outcomes().items()]))


_EVENT = "g AS (SELECT event_id AS subject, event_type AS t, user_id % 4 AS m, user_id % 3 = 0 AS dynamic FROM events)"
_ACTIVE = "CASE WHEN t IN ('click', 'view') THEN 'pass' WHEN t = 'error' THEN 'fail' ELSE 'unknown' END"


def _event_features(spark, sf):
    t = F.col("event_type")
    return table(spark, sf, "events").select(F.col("event_id").alias("subject"), F.when(t == "click", "eager").when(t == "view", "proven").when(t == "error", "cold").otherwise("unknown").alias("activation"), F.when(F.col("user_id") % 3 == 0, "dynamic").otherwise("static").alias("target"), (F.col("user_id") % 4).alias("m"), (F.col("user_id") % 3 == 0).alias("dynamic"))


@bound(f"WITH {_EVENT} {_rule_sql('activation', _ACTIVE, 'g')}")
def policy_activation(spark, sf):
    return policy.evaluated(_event_features(spark, sf), "activation", policy.activation(F.col("activation")))


@bound(f"WITH {_EVENT} {_rule_sql('dynamic_target', 'CASE WHEN dynamic THEN ' + chr(39) + 'fail' + chr(39) + ' ELSE ' + chr(39) + 'pass' + chr(39) + ' END', 'g')}")
def policy_dynamic_target(spark, sf):
    return policy.evaluated(_event_features(spark, sf), "dynamic_target", policy.dynamic_target(F.col("target")))


@bound(f"WITH {_EVENT} {_rule_sql('local_handler', 'CASE WHEN m > 1 THEN ' + chr(39) + 'pass' + chr(39) + ' WHEN dynamic OR m = 1 THEN ' + chr(39) + 'unknown' + chr(39) + ' ELSE ' + chr(39) + 'fail' + chr(39) + ' END', 'g')}")
def policy_local_handler(spark, sf):
    return policy.evaluated(_event_features(spark, sf), "local_handler", policy.local_handler(F.when(F.col("m") > 1, 1).otherwise(0), F.when(F.col("m") == 1, 1).otherwise(0), F.col("dynamic")))


@bound(f"""WITH {SNAPSHOTS}, d AS (SELECT b.k AS subject, CASE WHEN a.k IS NULL AND b.status = 'F' THEN 'fail' WHEN a.k IS NULL THEN 'pass' WHEN a.status <> b.status THEN 'unknown' ELSE 'pass' END AS o FROM b LEFT JOIN a ON a.k = b.k)
SELECT 'new_diagnostics' AS rule, subject, o AS outcome, CASE WHEN o = 'unknown' THEN 'warning' ELSE 'error' END AS severity, o = 'fail' AS blocking FROM d""")
def policy_new_diagnostics(spark, sf):
    a, b = _snapshots(spark, sf)
    f = b.alias("b").join(a.alias("a"), F.col("a.k") == F.col("b.k"), "left").select(F.col("b.k").alias("subject"), F.col("a.k").isNull().alias("new"), F.col("b.status").alias("now"), (F.col("a.status") != F.col("b.status")).alias("changed"))
    new, changed = (F.col("new") & (F.col("now") == "F")).cast("int"), (~F.col("new") & F.col("changed")).cast("int")
    return policy.evaluated(f, "new_diagnostics", policy.new_diagnostics(F.lit(True), new, F.coalesce(changed, F.lit(0))))


# --- several services --------------------------------------------------------------------------

_SERVICES = """p AS (SELECT c_custkey AS producer, c_nationkey AS contract, CASE WHEN c_custkey % 3 > 0 THEN 'realm' || c_nationkey % 2 END AS realm, c_acctbal >= 0 AS eligible, c_custkey % 2 = 0 AS single FROM customer),
c AS (SELECT s_suppkey AS consumer, s_nationkey AS contract, CASE WHEN s_suppkey % 4 > 0 THEN 'realm' || s_nationkey % 2 END AS realm FROM supplier)"""
_CORRELATED = f"""WITH {_SERVICES}, g AS (SELECT producer, any_value(p.realm) AS realm, any_value(eligible) AS eligible, any_value(single) AS single, count(c.consumer) AS candidates, count(DISTINCT c.realm) AS realms,
count(c.consumer) FILTER (NOT coalesce(c.realm = p.realm, false)) AS elsewhere FROM p LEFT JOIN c ON p.contract = c.contract AND eligible GROUP BY producer),
h AS (SELECT *, CASE WHEN NOT eligible THEN 'unsupported_identity' WHEN candidates = 0 THEN 'producer_only' WHEN realms > 1 OR (realms = 1 AND realm IS NOT NULL AND elsewhere = candidates) THEN 'realm_mismatch'
WHEN candidates > 1 AND single THEN 'multiple_consumers' END AS reason FROM g),
r AS (SELECT producer, CASE WHEN reason = 'multiple_consumers' THEN 'ambiguous' WHEN reason IS NOT NULL THEN 'unmatched' WHEN elsewhere = 0 THEN 'declared_realm_candidate' ELSE 'target_only_candidate' END AS state, reason, candidates FROM h)"""


def _services(spark, sf):
    realm = lambda k, n, m: F.when(F.col(k) % m > 0, F.concat(F.lit("realm"), (F.col(n) % 2).cast("string"))).alias("realm")
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("producer"), F.col("c_nationkey").alias("contract"), realm("c_custkey", "c_nationkey", 3), (F.col("c_acctbal") >= 0).alias("eligible"), (F.col("c_custkey") % 2 == 0).alias("single"))
    return p, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("consumer"), F.col("s_nationkey").alias("contract"), realm("s_suppkey", "s_nationkey", 4))


@bound(f"{_CORRELATED} SELECT * FROM r")
def system_correlation(spark, sf):
    return stitch.correlate(*_services(spark, sf))


@bound(f"WITH {_SERVICES} SELECT consumer, 'consumer_only' AS reason FROM c WHERE contract NOT IN (SELECT contract FROM p WHERE eligible)")
def system_leftovers(spark, sf):
    return stitch.leftovers(*_services(spark, sf))


@bound(f"""{_CORRELATED} SELECT producer, CASE state WHEN 'declared_realm_candidate' THEN 'pass' WHEN 'ambiguous' THEN 'unknown' ELSE CASE WHEN reason = 'unsupported_identity' THEN 'unknown' ELSE 'fail' END END AS declared_realm,
CASE state WHEN 'ambiguous' THEN 'fail' ELSE 'pass' END AS unambiguous FROM r""")
def system_policies(spark, sf):
    r = stitch.correlate(*_services(spark, sf))
    p, state = F.col("producer"), F.col("state")
    return r.select("producer", policy.declared_realm(p, state, F.col("reason")).alias("declared_realm"), policy.unambiguous(p, state).alias("unambiguous"))


@bound(f"""{_CORRELATED}, h2 AS (SELECT 'region:' || n_regionkey AS root, p.contract, p.realm, r.state, count(*) AS producers FROM r JOIN p USING (producer) JOIN nation ON n_nationkey = p.contract
WHERE state IN ('declared_realm_candidate', 'target_only_candidate') GROUP BY ALL), f AS (SELECT DISTINCT l_suppkey AS consumer, l_returnflag || l_linestatus AS effect FROM lineitem)
SELECT root, h2.contract, h2.realm, state, producers, c.consumer, effect FROM h2 JOIN c ON c.contract = h2.contract JOIN f ON f.consumer = c.consumer""")
def system_paths(spark, sf):
    p, c = _services(spark, sf)
    to_customers = edges(spark, sf, orders=False).where("predicate in ('HAS_NATION', 'HAS_CUSTOMER')")
    reach = graph.bounded_reach(to_customers, regions(spark, sf), 2).where("depth = 2")
    reached = reach.select("root", F.split("node", ":")[1].cast(dict(p.dtypes)["producer"]).alias("producer"))
    effects = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("consumer"), F.concat("l_returnflag", "l_linestatus").alias("effect"))
    return stitch.system_paths(reached, p, stitch.correlate(p, c), c, effects)


@bound()
def inventory_filter(spark, sf):
    """The tables' own files; SQL lists no files."""
    return snapshots.inventory(spark, sf, suffixes=(".parquet",)).withColumn("path", F.element_at(F.split("path", "/"), -1))


@bound("""WITH n AS (SELECT 'customer:' || c_custkey AS node, 'nation:' || c_nationkey AS parent, 1 AS rank FROM customer UNION ALL SELECT 'nation:' || n_nationkey, NULL, 0 FROM nation WHERE n_nationkey % 3 <> 0),
t AS (SELECT * FROM n ORDER BY rank, node LIMIT 240) SELECT * FROM t WHERE parent IS NULL OR parent IN (SELECT node FROM t)""")
def display_topn(spark, sf):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    c = table(spark, sf, "customer").select(name("customer:", "c_custkey").alias("node"), name("nation:", "c_nationkey").alias("parent"), F.lit(1).alias("rank"))
    n = table(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(name("nation:", "n_nationkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("rank"))
    return stitch.display_selection(c.union(n), 240)


@bound()
def greedy_scene(spark, sf):
    e = edges(spark, sf, orders=False).where("predicate = 'PLACES'").select(F.col("subject").alias("root"), F.concat_ws("|", "subject", "object").alias("edge_id"), "subject", "object", F.when(F.col("status") == "resolved", 0).otherwise(1).alias("rank"))
    return scenes.greedy_scene(e, max_nodes=6, max_edges=4)


# --- validation and merging --------------------------------------------------------------------


@bound("SELECT c_nationkey * 100 + c_custkey % 7 AS ref, count(*) AS n FROM customer WHERE c_nationkey * 100 + c_custkey % 7 NOT IN (SELECT n_nationkey * 100 FROM nation) GROUP BY 1")
def fk_integrity(spark, sf):
    child = table(spark, sf, "customer").select((F.col("c_nationkey") * 100 + F.col("c_custkey") % 7).alias("ref"))
    return validate.missing_references(child, "ref", table(spark, sf, "nation").select((F.col("n_nationkey") * 100).cast("long").alias("id")), "id")


@bound("SELECT l_orderkey, sum(CAST(l_linenumber <> nth AS INT)) AS misplaced FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem WHERE l_quantity > 5) GROUP BY 1 HAVING misplaced > 0")
def order_contiguity(spark, sf):
    return validate.order_gaps(table(spark, sf, "lineitem").where("l_quantity > 5"), "l_orderkey", "l_linenumber", 1)


@bound("""SELECT * FROM (SELECT conv_id, turn, lag(length(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS expected, length(role) % 5 AS found FROM conversations) WHERE expected IS NOT NULL AND expected IS DISTINCT FROM found""")
def path_continuity(spark, sf):
    steps = table(spark, sf, "conversations").select("conv_id", "turn", (F.length("role") % 5).alias("s"), F.length("role").alias("e"))
    return validate.path_breaks(steps, "conv_id", "turn", "s", "e")


@bound("""SELECT l_orderkey, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS l_partkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag,
count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY l_orderkey""")
def record_merge(spark, sf):
    return validate.merge_records(table(spark, sf, "lineitem"), "l_orderkey", ["l_partkey", "l_returnflag"], ["l_linestatus"])


@bound("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'canceled' WHEN o_orderkey % 50 = 0 THEN 'failed' WHEN found IS NULL AND o_orderpriority = '1-URGENT' THEN 'failed'
WHEN o_orderpriority <> '1-URGENT' AND coalesce(returned, 0) = 0 THEN 'completed' ELSE 'completed_with_gaps' END AS state
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS found, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def result_state(spark, sf):
    """Lines are facts, an urgent order has an error, returned lines are diagnostics, and each fiftieth order failed."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    error = (F.col("o_orderpriority") == "1-URGENT").cast("int")
    state = policy.result_state(F.col("o_orderstatus") == "P", F.col("o_orderkey") % 50 == 0, F.coalesce("n", F.lit(0)), error, error + F.coalesce("returned", F.lit(0)))
    return table(spark, sf, "orders").join(g, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", state.alias("state"))


@bound("SELECT l_orderkey AS subject, CASE WHEN bool_or(l_returnflag = 'A') THEN 'write' WHEN bool_or(l_returnflag = 'R') THEN 'unknown' ELSE 'non_write' END AS class FROM lineitem GROUP BY 1")
def mutation_class(spark, sf):
    has = lambda f: F.count_if(F.col("l_returnflag") == f)
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("subject")).agg(policy.mutation_class(has("A"), has("R")).alias("class"))


# --- text --------------------------------------------------------------------------------------

_PATH = "regexp_replace(url, '^[a-z]+://[^/]*', '')"


@bound(f"SELECT page_id, '/' || array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s <> ''), '/') AS route FROM pages")
def route_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_route(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("route"))


@bound(f"SELECT page_id, '/api' || regexp_replace('/' || array_to_string(list_filter(string_split({_PATH} || '/:id/:1', '/'), lambda s: s <> ''), '/'), ':([A-Za-z_][A-Za-z0-9_]*)', '{{\\1}}', 'g') AS route FROM pages")
def route_to_openapi(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.route_to_openapi(F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), F.lit("/:id/:1")), "/api").alias("route"))


_URL = """CASE page_id % 7 WHEN 0 THEN replace(url, '://', '://u@x:p@') WHEN 1 THEN '//u:p@h/y' || page_id WHEN 2 THEN '?a=' || page_id WHEN 3 THEN replace(url, '://', '://me:pw@') || '/a://b@c'
WHEN 4 THEN url || '/x@y' WHEN 5 THEN url || repeat('/long', 500) ELSE url END || '?b=2&a=1&a=3&{x}=1&=5#top'"""


@bound(f"""WITH p AS (SELECT page_id, {_URL} AS u FROM pages), h AS (SELECT page_id, u, regexp_extract(u, '^[^#?]*') AS h FROM p),
c AS (SELECT page_id, u, h, CASE WHEN position('://' IN h) > 0 THEN position('://' IN h) + 2 WHEN h LIKE '//%' THEN 2 ELSE NULL END AS begins FROM h),
r AS (SELECT page_id, u, h, begins, regexp_extract(substr(h, begins + 1), '^[^/]*') AS authority FROM c)
SELECT page_id, CASE WHEN length(u) > 2048 OR h = '' THEN NULL WHEN begins IS NULL OR position('@' IN authority) = 0 THEN h
ELSE substr(h, 1, begins) || regexp_extract(authority, '[^@]*$') || substr(h, begins + 1 + length(authority)) END AS target FROM r""")
def url_sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_target(F.expr(_URL)).alias("target"))


@bound(f"""SELECT page_id, CASE WHEN length(u) > 2048 THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(u, '^[^#?]*\\?([^#]*)', 1), '&'), lambda s: regexp_extract(s, '^[^=]*')), lambda k: k <> '' AND NOT regexp_matches(k, '[{{}}]')))), ',') END AS keys FROM (SELECT page_id, {_URL} AS u FROM pages)""")
def url_query_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_query_keys(F.expr(_URL)).alias("keys"))


_SECRETS = """text || CASE doc_id % 10 WHEN 0 THEN ' secret = ''abc''' WHEN 1 THEN ' token: `abc`' WHEN 2 THEN ' authorization: "abc"' WHEN 3 THEN ' password == "abc"' WHEN 4 THEN ' Api-Key !== "x" ' WHEN 5 THEN ' https://u:p@h/y '
WHEN 6 THEN ' bearer  ab.c-d ' WHEN 7 THEN ' -----BEGIN RSA PRIVATE KEY-----x-----END RSA PRIVATE KEY-----' WHEN 8 THEN ' passwd="a" token = "b"' ELSE ' mytoken = "kept" tokens: "kept"' END"""


def _redacted_sql(column: str) -> str:
    """By hand: this dialect has no references back to a quote, so each quote has its own rule."""
    names = "(api_key|api-key|apikey|secret|password|passwd|token|authorization)"
    column = f"regexp_replace({column}, '-----BEGIN [A-Z ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED PRIVATE KEY]', 'g')"
    column = f"regexp_replace({column}, '(\\b[a-z][a-z0-9+.-]*://[^\\s/:@]+:)[^\\s@/]+@', '\\1[REDACTED]@', 'gi')"
    column = f"regexp_replace({column}, '\\bbearer\\s+[a-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi')"
    for operator in ("(===|==|!==|!=)", "[:=]"):
        for quote in ('"', "''", "`"):
            column = f"regexp_replace({column}, '(\\b{names}\\b\\s*{operator}\\s*){quote}[^\\r\\n]*?{quote}', '\\1{quote}[REDACTED]{quote}', 'gi')"
    return column


@bound(f"SELECT doc_id, sha256({_redacted_sql('(' + _SECRETS + ')')}) AS hash FROM documents")
def redact_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.redact(F.expr(_SECRETS)), 256).alias("hash"))


_TAIL = "chr(10) || chr(9) || right(text, 60) || CASE doc_id % 3 WHEN 0 THEN ' token: \"abc\"' WHEN 1 THEN ' secret = ''x'' ' ELSE chr(10) END"


@bound(f"SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS snippet FROM (SELECT doc_id, {_redacted_sql('trim(' + _TAIL + ', chr(9) || chr(10) || chr(13) || chr(32))')} AS t FROM documents)")
def bounded_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.expr(_TAIL), 80).alias("snippet"))


@bound("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS hash FROM documents")
def signature_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.signature(F.col("text")), 256).alias("hash"))


@bound("""SELECT n_nationkey, 'nation:' || substr(sha256('["' || n_name || '",' || n_regionkey || ']'), 1, 32) AS id FROM nation""")
def stable_ids(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.stable_id("nation", F.col("n_name"), F.col("n_regionkey")).alias("id"))


@bound("""SELECT c_custkey, '["customer","' || c_name || '","' || c_mktsegment || '"]' AS key FROM customer""")
def semantic_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.semantic_key("customer", F.col("c_name"), F.col("c_mktsegment")).alias("key"))


_CELL = "CASE p_partkey % 4 WHEN 0 THEN '=' || p_name WHEN 1 THEN p_name || ',\"x\"' WHEN 2 THEN '-' || p_name ELSE p_name END"


@bound(f"""SELECT p_partkey, CASE WHEN regexp_matches(s, '[",\\r\\n]') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell FROM (SELECT p_partkey, CASE WHEN regexp_matches(c, '^[=+@-]') THEN '''' || c ELSE c END AS s FROM (SELECT p_partkey, {_CELL} AS c FROM part))""")
def csv_cells(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.csv_cell(F.expr(_CELL)).alias("cell"))
