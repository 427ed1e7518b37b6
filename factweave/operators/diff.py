"""Comparing two snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import dealt


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change, reasons): added, removed, modified (with the names of the values that differ)
    or ambiguous (a key held by several records on a side). Equal records give no row. Null keys
    agree with each other."""
    def side(df: DataFrame, name: str) -> DataFrame:
        held = [F.when(F.count("*") == 1, F.first(F.struct(*values))).alias(f"{name}_values"), F.count("*").alias(f"{name}_n")]
        return df.groupBy(*keys).agg(*held)

    a, b = side(before, "before").alias("a"), side(after, "after").alias("b")
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(b, on, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "before_values", "after_values", F.coalesce("before_n", F.lit(0)).alias("before_n"), F.coalesce("after_n", F.lit(0)).alias("after_n"))
    reasons = F.array_compact(F.array(*[F.when(~F.col(f"before_values.{v}").eqNullSafe(F.col(f"after_values.{v}")), F.lit(v)) for v in values]))
    change = F.when((F.col("before_n") > 1) | (F.col("after_n") > 1), "ambiguous").when(F.col("before_n") == 0, "added").when(F.col("after_n") == 0, "removed").when(F.size(reasons) > 0, "modified")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", F.when(F.col("change") == "modified", F.array_join(reasons, ",")).alias("reasons"))


def slot_matching(before: DataFrame, after: DataFrame, slot: list[str], key: str, unsure: Column | None = None, n: int | None = None) -> DataFrame:
    """(slot, key, outcome) of records with a slot and an exact key (null if it isn't known).

    Slots that several records of a side hold are ``ambiguous``; so is, as ``ambiguous_identity``, each other record that is
    ``unsure``; of what is left keys that several records of a side hold are ``ambiguous_key`` (with no slot). All of these are
    blocked, on both sides. The others pair by exact key first (same_key), then by slot if one of each side
    is left (same_slot); a pair has the later record's slot and key. What isn't paired, the blocked included, is
    removed or added. Sides are counted together, so each count is one aggregation and one join. Records are dealt over
    n partitions (iterate.parts), if that is more than the session's number."""
    u, slots, keys = _matched(before, after, slot, key, unsure, n=n)
    later = F.col("later")
    outcome = F.when(F.col("by_key"), F.when(later, "same_key")).when(F.col("by_slot"), F.when(later, "same_slot")).when(later, "added").otherwise("removed")
    kinds = dict(before.dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    out = [
        u.select(*slot, key, outcome.alias("outcome")).where("outcome is not null"),
        slots.where(_several("slot")).select(*slot, none(key), F.lit("ambiguous").alias("outcome")),
        u.where(~_several("slot") & F.col("doubt")).select(*slot, key, F.lit("ambiguous_identity").alias("outcome")),
        keys.where(_several("key")).select(*map(none, slot), key, F.lit("ambiguous_key").alias("outcome")),
    ]
    return reduce(DataFrame.unionByName, out)


def _several(name: str) -> Column:
    return (F.col(f"{name}_before") > 1) | (F.col(f"{name}_after") > 1)


def _matched(before: DataFrame, after: DataFrame, slot: list[str], key: str, unsure: Column | None, carry: tuple[str, ...] = (), n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides' records with ``later``, by_key and by_slot (how they are paired), and the counts by slot and by key."""
    later, doubt = F.col("later"), F.lit(False) if unsure is None else F.coalesce(unsure, F.lit(False))
    u = reduce(DataFrame.unionByName, [df.select(*slot, key, *carry, doubt.alias("doubt"), F.lit(x).alias("later")) for df, x in ((before, False), (after, True))])

    def counted(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        return dealt(rows, n, *by).groupBy(*by).agg(F.count_if(~later).alias(f"{name}_before"), F.count_if(later).alias(f"{name}_after"))

    one = lambda name: F.coalesce((F.col(f"{name}_before") == 1) & (F.col(f"{name}_after") == 1), F.lit(False))
    slots = counted(u, slot, "slot")
    u = dealt(u, n, *slot).join(slots, slot).withColumn("free", ~_several("slot") & ~F.col("doubt"))
    # records without a key meet none: they are spread by their slots instead of lying in one partition
    u = u.withColumn("spread", F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*slot)))
    keys = counted(u.where(F.col("free") & F.col(key).isNotNull()), [key, "spread"], "key")
    u = dealt(u, n, key, "spread").join(keys, [key, "spread"], "left").withColumn("by_key", F.col("free") & one("key")).withColumn("rest", F.col("free") & ~F.col("by_key") & ~F.coalesce(_several("key"), F.lit(False)))
    return dealt(u, n, *slot).join(counted(u.where("rest"), slot, "left"), slot, "left").withColumn("by_slot", F.col("rest") & one("left")), slots, keys


#: Fixed names and order of what an endpoint consists of; each that differs is a reason.
PARTS = ("handler", "direct_guards", "effective_guards", "terminals", "authorization", "resource_accesses")


def endpoint_snapshots(endpoints: DataFrame, parts: dict[str, DataFrame | None]) -> DataFrame:
    """endpoints (endpoint, slot, key, identity) with a column for each of PARTS: its items (endpoint, item) as one sorted text,
    and null where the part is unavailable, which is not the same as empty. All parts are gathered in one pass."""
    given = {p: df for p, df in parts.items() if df is not None}
    rows = reduce(DataFrame.unionByName, [df.select("endpoint", F.lit(p).alias("part"), F.col("item").cast("string").alias("item")) for p, df in given.items()])
    items = rows.groupBy("endpoint").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == p, F.col("item")))), "\n").alias(p) for p in given])
    e = endpoints.join(items, "endpoint", "left").na.fill("", list(given))
    return e.select("endpoint", "slot", "key", "identity", *[(F.col(p) if p in given else F.lit(None).cast("string")).alias(p) for p in PARTS])


def _for_comparison(part: Column) -> Column:
    """A part as it is carried to be compared: a long text is its SHA-256 (behind a mark that tells it from a short text)."""
    return F.when(F.octet_length(part) > 32, F.concat(F.lit(b"\x01"), F.unhex(F.sha2(part, 256)))).otherwise(F.concat(F.lit(b"\x00"), part.cast("binary")))


def endpoint_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(slot, change, before, after, reasons) of two tables of snapshots: endpoints are matched by exact key, then by slot; a pair
    is modified for each part that differs, or is available on one side only (an identity that differs counts as its
    handler), and gives no row if none does. What isn't paired is removed or added."""
    before, after = (df.withColumns({p: _for_comparison(F.col(p)) for p in PARTS}) for df in (before, after))
    u, _, _ = _matched(before, after, ["slot"], "key", F.col("identity") == "ambiguous", ("endpoint", "identity", *PARTS))
    fields = [F.col("endpoint"), F.col("slot"), F.col("identity"), *map(F.col, PARTS)]

    def pairs(how: str, on: str) -> DataFrame:
        b, a = (u.where(F.col(how) & (F.col("later") == x)).select(F.col(on).alias("on"), F.struct(*fields).alias(n)) for x, n in ((False, "b"), (True, "a")))
        return b.join(a, "on").select("b", "a")

    differs = lambda p: ~F.col(f"b.{p}").eqNullSafe(F.col(f"a.{p}"))
    reasons = F.array_compact(F.array(*[F.when(differs(p) | (F.col("b.identity") != F.col("a.identity")) if p == "handler" else differs(p), F.lit(p)) for p in PARTS]))
    paired = pairs("by_key", "key").unionByName(pairs("by_slot", "slot")).withColumn("reasons", F.array_join(reasons, ",")).where("reasons <> ''")
    alone = u.where("not by_key and not by_slot")
    none = F.lit(None).cast(dict(before.dtypes)["endpoint"])
    change = F.when(F.col("later"), "added").otherwise("removed")
    single = alone.select("slot", change.alias("change"), F.when(~F.col("later"), F.col("endpoint")).otherwise(none).alias("before"), F.when(F.col("later"), F.col("endpoint")).otherwise(none).alias("after"), F.concat(F.lit("endpoint_"), change).alias("reasons"))
    return paired.select("b.slot", F.lit("modified").alias("change"), F.col("b.endpoint").alias("before"), F.col("a.endpoint").alias("after"), "reasons").unionByName(single)


def status_changes(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """Keys unique on both sides whose status differs; nothing else."""
    def unique(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count("*").alias("n"), F.first(status).alias(name)).where("n = 1").drop("n")

    return unique(before, "before_status").join(unique(after, "after_status"), key).where(~F.col("before_status").eqNullSafe(F.col("after_status")))


def diagnostic_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(code, subject, location, change, reasons) of diagnostics with a severity and a message: new,
    resolved or changed; a key held by several diagnostics on a side is ambiguous."""
    change = F.col("change")
    named = F.when(change == "added", "new").when(change == "removed", "resolved").when(change == "modified", "changed").otherwise(change)
    return keyed_diff(before, after, ["code", "subject", "location"], ["severity", "message"]).withColumn("change", named)


def collisions(records: DataFrame, kind: str, key: str, member: str) -> DataFrame:
    """Keys that more than one record of a kind holds, with their sorted members."""
    return records.groupBy(kind, key).agg(F.count("*").alias("records"), F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias("members")).where("records > 1")


def projection(records: DataFrame, kind: str, key: list[str], certain: Column) -> DataFrame:
    """The records with ``key`` (their semantic key) and ``identity``: unresolved if they aren't
    certain, ambiguous if several certain ones have the key, else resolved."""
    from factweave.functions.text import semantic_key

    p = records.withColumn("certain", certain).withColumn("key", semantic_key(kind, *map(F.col, key)))
    n = p.where("certain").groupBy("key").agg(F.count("*").alias("n"))
    return p.join(n, "key", "left").withColumn("identity", F.when(~F.col("certain"), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")).drop("certain", "n")


def family_changes(before: DataFrame, after: DataFrame, family: str, values: dict[str, str]) -> DataFrame:
    """(family, key, change, reasons) of records with a column ``key``; values: column to the reason that its
    difference gives. Interactions and handlers are compared so: what isn't in their key is a reason."""
    a, b = (df.select("key", *[F.col(c).alias(r) for c, r in values.items()]) for df in (before, after))
    d = keyed_diff(a, b, ["key"], list(values.values()))
    reasons = F.when(F.col("change").isin("added", "removed"), F.concat(F.lit(f"{family}_"), F.col("change"))).otherwise(F.col("reasons"))
    return d.select(F.lit(family).alias("family"), "key", "change", reasons.alias("reasons"))


def merged_ambiguities(rows: DataFrame) -> DataFrame:
    """(kind, record_kind, key, side, before, after): ambiguities of one identity made one: sides before
    and after become both, candidates are united. rows: kind, record_kind, key, side, candidate, of."""
    side = lambda s: F.bool_or(F.col("side").isin(s, "both"))
    members = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("of") == s, F.col("candidate").cast("string")))), ",").alias(s)
    return rows.groupBy("kind", "record_kind", "key").agg(F.when(side("before") & side("after"), "both").when(side("before"), "before").otherwise("after").alias("side"), members("before"), members("after"))


def ambiguities(before: DataFrame, after: DataFrame, record_kind: str) -> DataFrame:
    """The candidates of keys that several records of a side hold, of both sides, as rows for
    merged_ambiguities. Records: key, id."""
    def of(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy("key").agg(F.count("*").alias(side))

    n = of(before, "b").join(of(after, "a"), "key", "full").na.fill(0).where("a > 1 or b > 1")
    n = n.select("key", F.when((F.col("a") > 1) & (F.col("b") > 1), "both").when(F.col("b") > 1, "before").otherwise("after").alias("side"))
    rows = [df.join(n, "key").select(F.lit("semantic_key").alias("kind"), F.lit(record_kind).alias("record_kind"), "key", "side", F.col("id").alias("candidate"), F.lit(s).alias("of")) for df, s in ((before, "before"), (after, "after"))]
    return rows[0].unionByName(rows[1])


def whole_diff(families: dict[str, tuple[DataFrame, DataFrame, dict[str, str]]]) -> DataFrame:
    """All families' changes in one table: (family, key, change, reasons)."""
    return reduce(DataFrame.unionByName, [family_changes(a, b, name, values) for name, (a, b, values) in families.items()])


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("family").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "ambiguous")])
