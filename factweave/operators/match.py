"""Matching producers to consumers: exact, pattern, queue and message joins, caps and ambiguity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .iterate import cut, session_parts

#: Most segments of a pattern, and what stands between segments once names and patterns are written alike.
MOST_SEGMENTS, UNIT = 100, "\x1f"


def _segments(text: Column, delimiter: str) -> Column:
    return F.split(text, _quoted(delimiter))


def valid_pattern(pattern: Column, delimiter: str) -> Column:
    """At most MOST_SEGMENTS segments, at least one * or **, and no star within a longer segment. A delimiter that is
    empty or has a star makes no pattern valid."""
    if not delimiter or "*" in delimiter:
        return F.lit(False)
    segments = _segments(pattern, delimiter)
    star = lambda s: s.isin("*", "**")
    return (F.size(segments) <= MOST_SEGMENTS) & F.exists(segments, star) & F.forall(segments, lambda s: star(s) | ~F.contains(s, F.lit("*")))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def _in_units(text: Column, delimiter: str) -> Column:
    """The text with UNIT after each segment; segments that have one, or a backslash, are escaped."""
    return F.array_join(F.transform(_segments(text, delimiter), lambda s: F.concat(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit(UNIT), F.lit("\\u")), F.lit(UNIT))), "")


def pattern_to_regex(pattern: Column, delimiter: str) -> Column:
    """An anchored expression over names in units: * is one segment, ** none or more."""
    segments = F.filter(F.split(_in_units(pattern, delimiter), UNIT), lambda s, i: i < F.size(_segments(pattern, delimiter)))
    escaped = lambda s: F.regexp_replace(s, r"([^A-Za-z0-9_])", r"\\$1")
    one = f"[^{UNIT}]*{UNIT}"
    body = F.array_join(F.transform(segments, lambda s: F.when(s == "**", F.lit(f"(?:{one})*")).when(s == "*", F.lit(one)).otherwise(F.concat(escaped(s), F.lit(UNIT)))), "")
    return F.concat(F.lit("^"), body, F.lit("$"))


def exact_match(producers: DataFrame, handlers: DataFrame, key: str = "target_key") -> DataFrame:
    """Pairs with the same key, neither dynamic."""
    p, h = producers.where("not dynamic"), handlers.where("not dynamic")
    return p.join(h.select("handler", key), key).select("producer", "handler", key)


def wildcard_match(producers: DataFrame, patterns: DataFrame, delimiter: str = ".") -> DataFrame:
    """(producer, handler): events whose name a handler's pattern matches, with a delimiter of one or more characters.
    Distinct patterns meet distinct names, then both sides fan out.

    Every meeting is by a key, so no pattern meets all names and no table has to be broadcast: a pattern that begins
    with a plain segment meets the names that begin with it; of the others one without ``**`` those of as many
    segments, one with a plain segment anywhere those that have it (the longest of them), and one of stars alone
    those of enough segments."""
    parts = _segments(F.col("pattern"), delimiter)
    plain = F.filter(parts, lambda s: ~s.isin("*", "**"))
    first = F.get(parts, F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(plain, lambda s: F.struct(F.length(s), s.alias("s")))), -1)["s"]
    open_ = F.array_contains(parts, "**")
    compiled = patterns.where(valid_pattern(F.col("pattern"), delimiter)).select("pattern").distinct()
    compiled = compiled.withColumn("regex", pattern_to_regex(F.col("pattern"), delimiter)).select(
        "pattern", "regex", F.when(~first.isin("*", "**"), first).alias("p_first"), F.when(~open_, F.size(parts)).alias("p_size"), F.when(F.size(plain) > 0, longest).alias("p_has"), F.size(F.filter(parts, lambda s: s == "*")).alias("p_least")
    )
    names = producers.select("name").distinct().withColumn("parts", _segments(F.col("name"), delimiter)).withColumn("units", _in_units(F.col("name"), delimiter))
    fits = F.regexp_like(F.col("units"), F.col("regex"))
    begin, sized = F.col("p_first").isNotNull(), F.col("p_first").isNull() & F.col("p_size").isNotNull()
    rest = F.col("p_first").isNull() & F.col("p_size").isNull()
    enough = compiled.where(rest & F.col("p_has").isNull()).withColumn("at", F.explode(F.sequence(F.col("p_least"), F.lit(MOST_SEGMENTS))))
    arms = [
        names.withColumn("at", F.get("parts", F.lit(0))).join(compiled.where(begin).withColumnRenamed("p_first", "at"), "at").where(fits),
        names.withColumn("at", F.size("parts")).join(compiled.where(sized).withColumnRenamed("p_size", "at"), "at").where(fits),
        names.withColumn("at", F.explode(F.array_distinct("parts"))).join(compiled.where(rest & F.col("p_has").isNotNull()).withColumnRenamed("p_has", "at"), "at").where(fits),
        names.withColumn("at", F.least(F.size("parts"), F.lit(MOST_SEGMENTS))).join(enough, "at"),  # stars take any segment
    ]
    hits = reduce(DataFrame.unionByName, [arm.select("name", "pattern") for arm in arms])
    return producers.join(hits, "name").join(patterns, "pattern").select("producer", "handler", "name", "pattern")


def queue_match(producers: DataFrame, handlers: DataFrame) -> DataFrame:
    """Same technology and queue; a handler without a job takes every job of its queue."""
    on = (F.col("p.technology") == F.col("h.technology")) & (F.col("p.queue") == F.col("h.queue")) & (F.col("h.job").isNull() | (F.col("h.job") == F.col("p.job")))
    return producers.alias("p").join(handlers.alias("h"), on).select("p.producer", "h.handler")


def message_match(producers: DataFrame, handlers: DataFrame) -> DataFrame:
    """Same mode, pattern and transport; an unknown transport matches nothing."""
    return producers.join(handlers, ["mode", "pattern", "transport"]).select("producer", "handler", "mode")


def client_message_match(producers: DataFrame, handlers: DataFrame) -> DataFrame:
    """message_match within an application: a producer of a known application through an exactly known client, a handler of the
    same application. producers and handlers have ``application`` besides, producers ``exact_client``; dynamic patterns are null."""
    p = producers.where("exact_client and application is not null")
    return p.join(handlers, ["application", "mode", "pattern", "transport"]).select("producer", "handler", "mode")


def transport_mismatch(producers: DataFrame, handlers: DataFrame, matched: DataFrame) -> DataFrame:
    """Producers without a match for which a handler differs in transport alone."""
    same = producers.join(matched, "producer", "left_anti").alias("p")
    on = (F.col("p.mode") == F.col("h.mode")) & (F.col("p.pattern") == F.col("h.pattern")) & ~F.col("p.transport").eqNullSafe(F.col("h.transport"))
    return same.join(handlers.alias("h"), on, "left_semi").select("producer")


def marked_ambiguous(matches: DataFrame) -> DataFrame:
    """Request matches of a producer with several handlers are ambiguous; events stay resolved."""
    n = F.count("*").over(Window.partitionBy("producer"))
    return matches.withColumn("status", F.when((F.col("mode") == "request") & (n > 1), "ambiguous").otherwise("resolved"))


def capped(matches: DataFrame, limit: int, key: str = "producer", order: str = "handler") -> DataFrame:
    """The first ``limit`` matches of each key, with the key's number of matches. The plan keeps the
    top rows of a task before they are shuffled."""
    w = Window.partitionBy(key)
    n = matches.groupBy(key).agg(F.count("*").alias("matches"))
    top = matches.withColumn("nth", F.row_number().over(w.orderBy(order))).where(F.col("nth") <= limit)
    return top.join(n, key)


def overflow(matches: DataFrame, limit: int, key: str = "producer") -> DataFrame:
    return matches.groupBy(key).agg(F.count("*").alias("matches")).where(F.col("matches") > limit).withColumn("dropped", F.col("matches") - limit)


def branch_state(selector: Column, jobs: Column, job: Column) -> Column:
    """matches, does_not_match or unknown: exact_jobs names its jobs, all_jobs takes any, also an
    unknown one, unmatched_jobs takes those that it doesn't name."""
    return (
        F.when(selector == "all_jobs", "matches")
        .when((selector == "unknown") | job.isNull(), "unknown")
        .when(selector == "exact_jobs", F.when(F.array_contains(jobs, job), "matches").otherwise("does_not_match"))
        .when(selector == "unmatched_jobs", F.when(F.array_contains(jobs, job), "does_not_match").otherwise("matches"))
        .otherwise("unknown")
    )


#: A range of up to BIN ** n lines lies in one or two bins of level n.
BIN, LEVELS = 256, 5
#: Ranges on a side of a block of pairs; outer ranges of a bin that is never cut into blocks.
SIDE, FEW = 2048, 64


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(inner_id, outer_id): ranges within ranges of the same keys, both ends included. Ends are numbers, or
    structs that begin with one, compared in order of their fields.

    An outer range goes to the bins that it covers, of a width that makes them one or two; an inner one to the bin
    of its start, once for each width that is in use. So a pair meets once, and a large file is many keys.

    A bin that makes over SIDE ** 2 pairs of them is a grid of blocks of about SIDE inner and SIDE outer ranges, dealt over
    partitions: so no task makes or holds more than a few blocks' pairs, however many the ranges of a bin are. (A bin of
    FEW outer ranges or less is linear in its inner ones and stays whole.)"""
    def line(df: DataFrame, of: str) -> Column:
        kind = df.schema[of].dataType
        return F.floor(F.col(of)[kind.fields[0].name] if isinstance(kind, StructType) else F.col(of)).cast("long")

    width = lambda level: F.pow(F.lit(float(BIN)), level).cast("long")
    o = outer.withColumn("first_line", line(outer, start)).withColumn("last_line", line(outer, end)).where("first_line <= last_line")
    size = F.col("last_line") - F.col("first_line") + 1
    level = F.lit(LEVELS)
    for n in reversed(range(LEVELS)):
        level = F.when(size <= BIN**n, n).otherwise(level)
    o = o.withColumn("level", level)
    bins = F.sequence(F.floor(F.col("first_line") / width(F.col("level"))), F.floor(F.col("last_line") / width(F.col("level"))))
    o = o.withColumn("bin", F.explode(bins)).drop("first_line", "last_line")
    levels = outer.sparkSession.range(LEVELS + 1).select(F.col("id").cast("int").alias("level"))
    used = levels.join(o.select("level").distinct(), "level", "left_semi")
    i = inner.withColumn("first_line", line(inner, start)).crossJoin(F.broadcast(used))  # LEVELS + 1 rows at most
    i = i.withColumn("bin", F.floor(F.col("first_line") / width(F.col("level"))))

    def pairs(i: DataFrame, o: DataFrame, on: list[str]) -> DataFrame:
        equal = [F.col(f"i.{k}") == F.col(f"o.{k}") for k in on]
        return i.alias("i").join(o.alias("o"), [*equal, F.col(f"i.{start}") >= F.col(f"o.{start}"), F.col(f"i.{end}") <= F.col(f"o.{end}")]).select("i.inner_id", "o.outer_id")

    on = [*keys, "level", "bin"]
    many = cut(o.groupBy(*on).agg(F.count("*").alias("outers")).where(F.col("outers") > FEW))
    grid = i.join(many, on).groupBy(*on, "outers").agg(F.count("*").alias("inners")).where(F.col("outers") * F.col("inners") > SIDE**2)
    grid = cut(grid.select(*on, *[F.ceil(F.col(f"{of}s") / SIDE).alias(f"{of}_blocks") for of in ("inner", "outer")]))
    n = grid.agg(F.sum(F.col("inner_blocks") * F.col("outer_blocks"))).first()[0]
    if not n:
        return pairs(i, o, on)
    whole = pairs(i.join(grid, on, "left_anti"), o.join(grid, on, "left_anti"), on)
    n, blocks = max(n, session_parts(o)), ["inner_block", "outer_block"]

    def dealt_in_blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        """In a block of its own by a hash, once for each block of the other side."""
        df = df.join(grid, on).withColumn(f"{own}_block", F.pmod(F.xxhash64(f"{own}_id", start, end), F.col(f"{own}_blocks")))
        df = df.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)))
        # by number: blocks are few bytes that make many pairs, so small partitions must not be merged
        return df.repartition(n, *on, *blocks)

    cells = pairs(dealt_in_blocks(i, "inner", "outer"), dealt_in_blocks(o, "outer", "inner").hint("shuffle_hash"), [*on, *blocks])
    return whole.unionByName(cells)


def guards_in_order(subjects: DataFrame, guards: DataFrame) -> DataFrame:
    """(subject, position, guard, scope): a subject's guards in effect: global ones by their order,
    then its class's, then its own; by name within a scope. guards: (scope, key, ord, guard);
    subjects: (subject, class_key, own_key)."""
    rank = F.when(F.col("scope") == "global", 0).when(F.col("scope") == "class", 1).otherwise(2)
    everywhere = subjects.select("subject").crossJoin(F.broadcast(guards.where("scope = 'global'").select("guard", "scope", "ord")))
    of_class = subjects.join(guards.where("scope = 'class'"), F.col("class_key") == F.col("key")).select("subject", "guard", "scope", "ord")
    own = subjects.join(guards.where("scope = 'own'"), F.col("own_key") == F.col("key")).select("subject", "guard", "scope", "ord")
    order = Window.partitionBy("subject").orderBy(rank, "ord", "guard")
    return everywhere.unionByName(of_class).unionByName(own).select("subject", F.row_number().over(order).alias("position"), "guard", "scope")


def guard_states(subjects: DataFrame, own: DataFrame, everywhere: DataFrame, analyses: DataFrame) -> DataFrame:
    """(subject, direct_state, global_state, effective_state, direct, globals): what is known of each subject's guards. subjects: analysis,
    subject; own: subject, guard; everywhere: analysis, guard; analyses: analysis, state (declared, none_proven or unknown; an
    analysis that isn't there is unknown). Global guards are counted for their analysis and joined by it."""
    d = own.groupBy("subject").agg(F.count("*").alias("direct"))
    g = everywhere.groupBy("analysis").agg(F.count("*").alias("globals"))
    s = subjects.join(d, "subject", "left").join(g, "analysis", "left").join(analyses.select("analysis", "state"), "analysis", "left").na.fill(0, ["direct", "globals"]).na.fill("unknown", ["state"])
    effective = F.when(F.col("direct") + F.col("globals") > 0, "guard_declared").when(F.col("state") == "none_proven", "no_supported_guard_proven").otherwise("unknown")
    return s.select("subject", F.when(F.col("direct") > 0, "declared").otherwise("none_declared").alias("direct_state"), F.col("state").alias("global_state"), effective.alias("effective_state"), "direct", "globals")


def overlap_attribution(sets: DataFrame, policies: DataFrame) -> DataFrame:
    """(subject, policy): a policy applies to a subject if their id sets share a member. Members are
    exploded and joined, so that no pair without one is looked at."""
    a = sets.select("subject", F.explode(F.array_distinct("members")).alias("member"))
    b = policies.select("policy", F.explode(F.array_distinct("members")).alias("member"))
    return a.join(b, "member").select("subject", "policy").distinct()


def slot_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of slots with multiplicity: resolved (one on each side), ambiguous (several on
    either), unmatched_left or unmatched_right."""
    a = left.groupBy(*keys).agg(F.count("*").alias("lefts"))
    b = right.groupBy(*keys).agg(F.count("*").alias("rights"))
    both = a.join(b, keys, "full").na.fill(0, ["lefts", "rights"])
    return both.withColumn("state", F.when(F.col("rights") == 0, "unmatched_left").when(F.col("lefts") == 0, "unmatched_right").when((F.col("lefts") == 1) & (F.col("rights") == 1), "resolved").otherwise("ambiguous"))


def same_application(a: Column, b: Column) -> Column:
    """Applications agree if either is unknown or both are the same."""
    return a.isNull() | b.isNull() | (a == b)


def event_match(producers: DataFrame, handlers: DataFrame) -> DataFrame:
    """(producer, handler): the same event in applications that agree."""
    p, h = producers.alias("p"), handlers.alias("h")
    return p.join(h, (F.col("p.event") == F.col("h.event")) & same_application(F.col("p.application"), F.col("h.application"))).select("p.producer", "h.handler")


def selected_branches(producers: DataFrame, dispatches: DataFrame) -> DataFrame:
    """(producer, handler, restricted, branches): producers (producer, handler, job, exact) against
    dispatches (handler, branch, selector, jobs), one row a branch.

    Only an exact job restricts, and only a handler with a dispatch; its branches are then those whose
    selector matches (an unknown one doesn't), sorted and maybe none. Without a restriction, null."""
    p = producers.alias("p").join(dispatches.alias("d"), "handler", "left")
    takes = branch_state(F.col("d.selector"), F.col("d.jobs"), F.col("p.job")) == "matches"
    found = p.groupBy("producer", "handler", "job", "exact").agg(F.count("d.branch").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(takes, F.col("d.branch")))), ",").alias("branches"))
    restricted = F.col("exact") & F.col("job").isNotNull() & (F.col("n") > 0)
    return found.select("producer", "handler", restricted.alias("restricted"), F.when(restricted, F.col("branches")).alias("branches"))


def endpoint_authorization(metadata: DataFrame, enforcements: DataFrame, guards: DataFrame) -> DataFrame:
    """One row a requirement: metadata (metadata, endpoint, name, evidence) enforced at its own endpoint
    (enforcement, metadata, endpoint, state, guard, evidence), the guard's name if it is known, and the
    sorted union of both's evidence."""
    m, e = metadata.alias("m"), enforcements.alias("e")
    joined = m.join(e, (F.col("m.metadata") == F.col("e.metadata")) & (F.col("m.endpoint") == F.col("e.endpoint"))).join(guards.alias("g"), F.col("e.guard") == F.col("g.guard"), "left")
    evidence = F.array_join(F.array_sort(F.array_union("m.evidence", "e.evidence")), ",")
    return joined.select("m.endpoint", "m.metadata", "e.enforcement", "m.name", "e.state", F.col("g.name").alias("guard_name"), evidence.alias("evidence"))


def provenance(influences: DataFrame, origins: DataFrame, columns: DataFrame) -> DataFrame:
    """(endpoint, origin, column, entity, evidence): request parts that reach table columns. influences
    (origin, column, evidence) joined to their origins (origin, endpoint) and columns (column, entity),
    evidence united."""
    star = influences.join(origins, "origin").join(columns, "column")
    return star.groupBy("endpoint", "origin", "column", "entity").agg(F.array_join(F.array_sort(F.collect_set(F.col("evidence").cast("string"))), ",").alias("evidence"))


def at_locations(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """(path, line, column, evidence): the sorted ids of the evidence that begins at each wanted place,
    empty where there is none."""
    place = ["path", "line", "column"]
    found = evidence.groupBy(*place).agg(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",").alias("evidence"))
    return wanted.select(*place).distinct().join(found, place, "left").na.fill("", ["evidence"])


def select_endpoints(selectors: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(verb, path, state, candidates): resolved, not_found or ambiguous, with the candidates' sorted ids."""
    found = endpoints.groupBy("verb", "path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), ",").alias("candidates"))
    s = selectors.select("verb", "path").distinct().join(found, ["verb", "path"], "left")
    return s.select("verb", "path", F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("state"), F.coalesce("candidates", F.lit("")).alias("candidates"))


def catalogue_view(endpoints: DataFrame, wanted: Column) -> DataFrame:
    """The endpoints that are wanted, each with the number of all (which the filter doesn't change)."""
    return endpoints.crossJoin(F.broadcast(endpoints.agg(F.count("*").alias("total")))).where(wanted)  # one row
