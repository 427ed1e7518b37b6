"""Graph operators over an edge relation (subject, predicate, object, status)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import bucketed, cut, dealt

TRAVERSABLE = ("resolved", "ambiguous")


def traversable(edges: DataFrame) -> DataFrame:
    """Edges with a target whose status can be followed."""
    return edges.where(F.col("object").isNotNull() & F.col("status").isin(*TRAVERSABLE))


def bounded_reach(edges: DataFrame, roots: DataFrame, max_depth: int, n: int | None = None) -> DataFrame:
    """(root, node, depth): every node within max_depth edges of each root at its least depth; the
    root is at depth 0. All roots advance together; a node is expanded once for each root. Edges and nodes are dealt over
    n partitions (iterate.parts), if that is more than the session's number."""
    if not 1 <= max_depth <= 8:
        raise ValueError("max_depth is 1 to 8")
    step = dealt(traversable(edges).select("subject", "object").repartition("subject"), n, "subject").distinct()  # one shuffle for both the distinct and the joins
    frontier = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"))
    seen = frontier
    for depth in range(1, max_depth + 1):
        new = dealt(frontier.join(step, frontier["node"] == step["subject"]).select("root", F.col("object").alias("node")), n, "root", "node").distinct()
        # written once: the next round and the result read it, and plan nothing again
        frontier = cut(new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def depth_limits(edges: DataFrame, reach: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, hidden): nodes at the depth limit with targets that the root doesn't reach."""
    step = traversable(edges).select("subject", "object").repartition("subject").distinct()
    onward = reach.where(F.col("depth") == max_depth).join(step, F.col("node") == F.col("subject")).select("root", "node", F.col("object").alias("target"))
    known = reach.select("root", F.col("node").alias("target"))
    return onward.join(known, ["root", "target"], "left_anti").groupBy("root", "node").agg(F.countDistinct("target").alias("hidden"))


def closure(pairs: DataFrame) -> DataFrame:
    """(a, b): the transitive closure of pairs, semi-naively: only what the last round found is
    joined again; each round's finds are written once, and the pairs are dealt once."""
    step = bucketed(pairs.select("a", "b").distinct(), "a")
    delta = known = step
    while not delta.isEmpty():
        new = delta.alias("d").join(step.alias("s"), F.col("d.b") == F.col("s.a")).select(F.col("d.a").alias("a"), F.col("s.b").alias("b")).distinct()
        delta = cut(new.join(known, ["a", "b"], "left_anti"))
        known = known.union(delta)
    return known


def terminal_facts(edges: DataFrame, roots: DataFrame, max_depth: int, terminals: str, n: int | None = None) -> DataFrame:
    """(root, terminal, status, contributors): terminals within max_depth edges; resolved if any path
    is, otherwise ambiguous. A path is ambiguous from its first ambiguous edge on. Rows are dealt over n partitions
    (iterate.parts), if that is more than the session's number."""
    step = dealt(traversable(edges).select("subject", "object", (F.col("status") == "ambiguous").cast("int").alias("unsure")), n, "subject")
    at = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("unsure"))
    found = None
    for _ in range(max_depth):
        reached = (
            at.alias("a")
            .join(step.alias("s"), F.col("a.node") == F.col("s.subject"))
            .select("a.root", F.col("a.node").alias("via"), F.col("s.object").alias("node"), F.greatest("a.unsure", "s.unsure").alias("unsure"))
        )
        here = reached.where(F.col("node").startswith(terminals))
        found = here if found is None else found.unionByName(here)
        at = dealt(reached, n, "root", "node").groupBy("root", "node").agg(F.min("unsure").alias("unsure"))
    return dealt(found, n, "root", "node").groupBy("root", F.col("node").alias("terminal")).agg(F.when(F.min("unsure") == 0, "resolved").otherwise("ambiguous").alias("status"), F.countDistinct("via").alias("contributors"))


def simple_paths(edges: DataFrame, targets: DataFrame, max_edges: int, stop: str) -> DataFrame:
    """(target, start, path): all simple paths of at most max_edges edges that end at a target and
    begin at a node named ``stop...``, found backwards; a path never visits a node twice."""
    back = traversable(edges).select("subject", "object").distinct()
    at = targets.select("target", F.col("target").alias("node"), F.array("target").alias("path"))
    found = None
    for _ in range(max_edges):
        at = at.join(back, F.col("node") == F.col("object")).where(~F.array_contains("path", F.col("subject"))).select("target", F.col("subject").alias("node"), F.concat(F.array("subject"), "path").alias("path"))
        here = at.where(F.col("node").startswith(stop))
        found = here if found is None else found.unionByName(here)
    return found.select("target", F.col("node").alias("start"), F.array_join("path", ">").alias("path")).distinct()


def visibility(owns: DataFrame, imports: DataFrame, reexports: DataFrame, global_modules: DataFrame) -> DataFrame:
    """(module, item, origin): what each module sees: its own items, items exported (also through
    re-exports, transitively) by modules it imports, and those of global modules."""
    through = closure(reexports.select(F.col("module").alias("a"), F.col("exported").alias("b")))
    gives = owns.select("module", "item").union(through.alias("t").join(owns.alias("o"), F.col("t.b") == F.col("o.module")).select(F.col("t.a").alias("module"), "o.item")).distinct()
    own = owns.select("module", "item", F.lit("own").alias("origin"))
    imported = imports.alias("i").join(gives.alias("g"), F.col("i.imported") == F.col("g.module")).select("i.module", "g.item", F.lit("imported").alias("origin"))
    everywhere = gives.join(global_modules, "module", "left_semi").select("item").distinct()
    shared = owns.select("module").distinct().crossJoin(everywhere).select("module", "item", F.lit("global").alias("origin"))
    rank = F.when(F.col("origin") == "own", 0).when(F.col("origin") == "imported", 1).otherwise(2)
    return own.union(imported).union(shared).groupBy("module", "item").agg(F.min_by("origin", rank).alias("origin"))


def completeness(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, complete): a module is complete if it and all that it imports, transitively, are. A
    cycle changes nothing; an unknown module is incomplete."""
    reach = closure(imports.select(F.col("module").alias("a"), F.col("imported").alias("b")))
    below = reach.alias("r").join(modules.alias("m"), F.col("r.b") == F.col("m.module"), "left").select(F.col("r.a").alias("module"), F.coalesce("m.complete", F.lit(False)).alias("complete"))
    return modules.select("module", "complete").union(below).groupBy("module").agg(F.every("complete").alias("complete"))


def trace(edges: DataFrame, dispatch: DataFrame, roots: DataFrame, max_depth: int = 3, max_hops: int = 2, fan_out: int = 50, max_states: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The causal trace over plain edges: (states, truncations); tracing.py has the whole one.

    A state is (root, node, depth, hop, cause). Calls (``edges``) go one deeper and keep the cause;
    dispatches (``dispatch``: subject, object, kind) go one hop on, begin again at depth 0 and turn
    the cause into ``distributed`` (kind queue or message, and for good) or ``asynchronous`` (event).
    A node on the way to a state is not entered again from it. The first arrival at a (node, depth,
    hop, cause) holds. ``max_states`` counts a root's states; each cap, and each cycle, reports what it cut."""
    from . import tracing

    c, flag = F.col, F.lit
    calls = traversable(edges).select("subject", "object").distinct()
    steps = tracing.as_steps(calls, method=c("subject"), category=flag(2), a=c("object"), target=c("object"), edge=c("object"), scoped=flag(False), subject=c("subject"), over=flag(False))
    nth = F.row_number().over(Window.partitionBy("subject").orderBy("object", "kind"))
    sends = dispatch.select("subject", "object", "kind", nth.alias("nth"))
    steps = steps.unionByName(tracing.as_steps(sends, method=c("subject"), category=flag(1), a=c("object"), b=c("kind"), target=c("object"), edge=c("object"), scoped=flag(False), distributed=c("kind").isin("queue", "message"), hint=flag("async"), subject=c("object"), over=c("nth") > fan_out))
    seeds = roots.select("root", F.col("root").alias("method"), F.lit(tracing.SYNCHRONOUS).alias("cause"), F.lit(1).alias("ord"))
    found = tracing.run(seeds, steps, tracing.Limits(max_depth, max_hops, fan_out, max_states))
    named = F.when(c("cause") == tracing.DISTRIBUTED, "distributed").when(c("cause") == tracing.LOCAL_ASYNC, "asynchronous").otherwise("synchronous")
    states = found.states.select("root", c("method").alias("node"), "depth", "hop", named.alias("cause"), "path", "ord")
    cuts = tracing.truncations(found).select("root", F.when(c("stop") == "state_limit", c("root")).otherwise(c("parent")).alias("node"), F.when(c("stop") == "call_cycle", "cycle").otherwise(c("stop")).alias("stop"), "n")
    return states, cuts.groupBy("root", "node", "stop").agg(F.sum("n").alias("n"))


def resolved_constants(names: DataFrame, max_hops: int = 8) -> DataFrame:
    """(name, value, reason): names (name, value, alias) that hold a value or stand for another name.
    Aliases are followed max_hops times at most; reason says why a name has no value: cycle, hop_limit,
    undeclared or ambiguous (a name that is declared twice)."""
    n = names.groupBy("name").agg(F.count("*").alias("n"), F.first("value").alias("value"), F.first("alias").alias("alias"))
    one = cut(n.select("name", F.when(F.col("n") == 1, F.col("value")).alias("value"), F.when(F.col("n") == 1, F.col("alias")).alias("alias"), (F.col("n") > 1).alias("several")))
    target = one.select(F.col("name").alias("alias"), F.col("value").alias("t_value"), F.col("alias").alias("t_alias"), F.col("several").alias("t_several"))
    open_ = one.select("name", "value", "alias", F.array("name").alias("seen"), F.when(F.col("several"), "ambiguous").alias("reason"))
    done = open_.where("value is not null or reason is not null or alias is null")
    open_ = open_.where("value is null and reason is null and alias is not null")
    for _ in range(max_hops):
        j = open_.join(target, "alias", "left")
        reason = F.when(F.array_contains("seen", F.col("alias")), "cycle").when(F.col("t_several").isNull(), "undeclared").when(F.col("t_several"), "ambiguous")
        j = cut(j.select("name", F.col("t_value").alias("value"), F.col("t_alias").alias("alias"), F.concat("seen", F.array("alias")).alias("seen"), reason.alias("reason")))
        done = done.unionByName(j.where("value is not null or reason is not null or alias is null"))
        open_ = j.where("value is null and reason is null and alias is not null")
    left = open_.withColumn("reason", F.when(F.array_contains("seen", F.col("alias")), "cycle").otherwise("hop_limit"))
    reason = F.coalesce("reason", F.when(F.col("value").isNull(), "undeclared"))
    return done.unionByName(left).select("name", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))
