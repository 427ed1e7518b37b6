"""Personal data by fixed patterns, and by contexts that bootstrap from what those find.

1. Scan. Four fixed patterns with checks give the base spans, the *seeds*. Candidates are other tokens of
   the same make: an address with an @, or six to MOST_DIGITS digits with little between them. Each
   occurrence of either has its *contexts*: the word before it, and the two words before it, lower-cased
   and with all digits alike. A *pattern* is a context, the make of what fills it and what is attached
   to the filler's left; an *instance* is the filler without punctuation.
2. Graph. Occurrences become edges (pattern, instance) with counts, added up before they are shuffled.
   Patterns of fewer than SUPPORT different instances go.
3. Evidence against. A context that words fill as often as identifiers says nothing. Every place of every
   text whose context is in the graph counts: texts are read again, contexts that can't be in the
   graph are dropped by a bitmap of fixed size, and the rest is counted and joined exactly.
4. Rounds. A seed belongs to its kind with confidence 1. A pattern's confidence for a kind is what its
   instances' confidence adds up to over its occurrences, divided by all that fills its context, where
   a candidate of no kind yet counts UNKNOWN; it needs SUPPORT different instances of confidence 1/2.
   An instance is of a kind with the confidence that not all of its accepted patterns are wrong.
   Newly found instances lift the confidence of the other patterns that they fill, and so on.
5. Candidates of an accepted instance are personal data of that kind wherever they stand.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.iterate import cut

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"context_{k}" for k in BASE))
ROUNDS, SUPPORT, MOST_DIGITS = 3, 3, 20
#: Least confidence of a pattern and of an instance, and what a candidate of no kind counts against a pattern.
ACCEPT, UNKNOWN = 0.6, 0.25
#: Bits of the bitmap that sieves contexts, and contexts counted in a task before they are handed on.
SIEVE_BITS, HELD = 1 << 22, 200_000
#: Longer words are no context.
MOST_BYTES = 64

# Possessive repeats and the lookbehind change no match; they keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().+/-]{0,3}[0-9]){5,}+")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_BOUNDARY, _WORD = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
#: Of lower-cased words: all digits alike.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches, from each @ to both sides; a search for it from every character of
    every word takes several times as long."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all four patterns' matches that pass their checks, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of identifiers that no span of ``taken`` (sorted) overlaps and none of the others."""
    found = [m.span() for m in _NUMBER.finditer(text) if sum(map(str.isdigit, m[0])) <= MOST_DIGITS]
    at = text.find("@")
    while at >= 0:
        start = max(text.rfind(c, 0, at) for c in _SPACE) + 1
        last = _BOUNDARY.search(text, at)
        end = last.start() if last else len(text)
        while start < at and not text[start].isalnum():
            start += 1
        stop = end
        while stop > at + 1 and not text[stop - 1].isalnum():
            stop -= 1
        if start < at and stop > at + 1:
            found.append((start, stop))
        at = text.find("@", end)
    out, k, reach, before = [], 0, -1, -1
    for s, e in sorted(found):
        while k < len(taken) and taken[k][0] < e:
            reach, k = max(reach, taken[k][2]), k + 1
        if s >= reach and s >= before:
            out.append((s, e))
            before = e
    return out


_MASK = (1 << 64) - 1


def word_hash(folded: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(folded, digest_size=8).digest(), "little")


def context_hash(one, two=None):
    """Of one word's hash, or of two words' in their order: Python numbers below 2**64, or arrays."""
    x = (one * 0x9E3779B97F4A7C15 if two is None else one * 0xBF58476D1CE4E5B9 + two * 0x94D049BB133111EB + 1) & _MASK
    x = (x ^ x >> 29) * 0xD6E8FEB86659FD93 & _MASK
    return x ^ x >> 32


def _folded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def _before(text: str, start: int) -> tuple[list[bytes], bytes | None]:
    """The two words before the one that has ``start`` in it, nearest first, and that word's part before
    it (null if that is longer than MOST_BYTES; longer words aren't among those before)."""
    end = start
    while end > 0 and text[end - 1] not in _SPACE:
        end -= 1
        if start - end > MOST_BYTES:
            return [], None
    attached, words = _folded(text[end:start]), []
    while len(words) < 2:
        while end > 0 and text[end - 1] in _SPACE:
            end -= 1
        stop = end
        while end > 0 and text[end - 1] not in _SPACE and stop - end <= MOST_BYTES:
            end -= 1
        word = _folded(text[end:stop])
        if not word or len(word) > MOST_BYTES:
            break
        words.append(word)
    return words, attached if len(attached) <= MOST_BYTES else None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def contexts_of(text: str, start: int, filler: str) -> list[tuple[int, int]]:
    """(context, pattern) of one and of two words before a filler; none where the text begins."""
    words, attached = _before(text, start)
    if attached is None:
        return []
    hashed = [word_hash(w) for w in words]
    made = word_hash((b"@" if "@" in filler else b"0") + attached)
    contexts = [context_hash(*hashed[:n][::-1]) for n in range(1, len(words) + 1)]
    return [(_signed(c), _signed(context_hash(c, made))) for c in contexts]


def instance_of(filler: str) -> int:
    return _signed(word_hash(filler.lower().encode("utf-8", "surrogatepass").translate(None, b" ()+/-")))


_PLACE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64())), ("patterns", pa.list_(pa.int64()))])
_SCANNED = pa.schema([("doc_id", pa.int64()), ("places", pa.list_(_PLACE))])


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places = []
        for t in b["text"].to_pylist():
            base = base_spans(t)
            own = [(s, e, k) for s, k, e in base] + [(s, e, -1) for s, e in candidates(t, base)]
            rows = []
            for s, e, k in own:
                found = contexts_of(t, s, t[s:e])
                rows.append({"start": s, "end": e, "kind": k, "instance": instance_of(t[s:e]), "contexts": [c for c, _ in found], "patterns": [p for _, p in found]})
            places.append(rows)
        yield common.batch(_SCANNED, doc_id=b["doc_id"], places=places)


def context_counts(texts: Iterable[str], sieve: np.ndarray) -> Counter:
    """How often each context that the sieve may hold stands before a word."""
    counts: Counter = Counter()
    known: dict[bytes, int] = {}
    with np.errstate(over="ignore"):
        for t in texts:
            words = _folded(t).split()
            for w in words:
                if w not in known:
                    known[w] = word_hash(w) if len(w) <= MOST_BYTES else 0  # 0: no context
            h = np.fromiter([known[w] for w in words], np.uint64, len(words))
            usable = h != 0
            for n in (1, 2):
                if len(words) <= n:
                    break
                context = context_hash(h[:-1][usable[:-1]]) if n == 1 else context_hash(*(x[usable[:-2] & usable[1:-1]] for x in (h[:-2], h[1:-1])))
                bit = (context & np.uint64(SIEVE_BITS - 1)).astype(np.int64)
                held = (sieve[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                for c, often in zip(*(x.tolist() for x in np.unique(context[held].view(np.int64), return_counts=True)), strict=True):
                    counts[c] += often
    return counts


def _counted(docs: DataFrame, graph: DataFrame) -> DataFrame:
    """(context, total): how many words stand in each of the graph's contexts, in all texts."""
    bits = graph.select(F.col("context").bitwiseAND(F.lit(SIEVE_BITS - 1)).alias("bit")).distinct()
    words = bits.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("set"))
    sieve = np.zeros(SIEVE_BITS // 64, np.int64)
    for r in words.collect():  # SIEVE_BITS / 64 rows at most
        sieve[r["at"]] = r["set"]
    sieve = sieve.astype("<i8").view(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(sieve)

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            held.update(context_counts(b["text"].to_pylist(), shared.value))
            if len(held) > HELD:
                yield _count_rows(held)
                held = Counter()
        yield _count_rows(held)

    counted = docs.select("text").mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("total"))
    return counted.join(graph.select("context").distinct(), "context", "left_semi")


def _count_rows(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.int64()), pa.array(list(held.values()), pa.int64())], ["context", "n"])


def pattern_graph(scanned: DataFrame) -> DataFrame:
    """(context, pattern, instance, kind, n): how often an instance, a seed of a kind or a candidate (-1),
    fills a pattern; patterns of at least SUPPORT different instances."""
    p = scanned.select(F.explode("places").alias("p")).select("p.kind", "p.instance", F.explode(F.arrays_zip("p.contexts", "p.patterns")).alias("c"))
    edges = cut(p.groupBy(F.col("c.contexts").alias("context"), F.col("c.patterns").alias("pattern"), "instance", "kind").agg(F.count("*").alias("n")))
    wide = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.max("kind").alias("most")).where(F.col("instances") >= SUPPORT)
    return edges.join(wide.select("pattern"), "pattern")


def _pattern_scores(edges: DataFrame, found: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of accepted patterns; found: (instance, kind, confidence)."""
    sums = edges.groupBy("context", "pattern").agg(F.sum(F.when(F.col("kind") < 0, F.col("n")).otherwise(0)).alias("open"))
    known = edges.select("pattern", "instance", "kind", "n").join(found.withColumnRenamed("kind", "of"), "instance")
    # a seed speaks for its own kind only; a candidate for each kind that it was found to be
    known = known.where("kind < 0 or kind = of").groupBy("pattern", F.col("of").alias("kind")).agg(
        F.sum(F.col("n") * F.col("confidence")).alias("right"), F.sum(F.when(F.col("kind") < 0, F.col("n") * F.col("confidence")).otherwise(0.0)).alias("was_open"), F.count_if(F.col("confidence") >= 0.5).alias("support")
    )
    scored = known.join(sums, "pattern").join(totals, "context")
    # candidates that are still open count little, those found by now count as found
    against = F.greatest(F.col("total") - F.col("open"), F.lit(0)) + F.col("was_open") + UNKNOWN * (F.col("open") - F.col("was_open"))
    confidence = F.col("right") / (F.greatest(against, F.col("right")) + 1)
    return scored.where(F.col("support") >= SUPPORT).select("pattern", "kind", confidence.alias("confidence")).where(F.col("confidence") >= ACCEPT)


def _instance_scores(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(instance, kind, confidence) of candidates that accepted patterns have."""
    met = edges.where("kind < 0").select("instance", "pattern").distinct().join(patterns, "pattern")
    wrong = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
    return met.groupBy("instance", "kind").agg((1 - F.exp(wrong)).alias("confidence")).where(F.col("confidence") >= ACCEPT)


def bootstrapped(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, confidence): the candidates that the rounds accept, each of its likeliest kind."""
    edges, totals = cut(edges), cut(totals)
    seeds = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("confidence")).distinct()
    found = seeds.limit(0)
    for _ in range(rounds):
        # a candidate that looks like a seed elsewhere is a seed by its own right
        patterns = _pattern_scores(edges, seeds.unionByName(found.join(seeds.select("instance", "kind"), ["instance", "kind"], "left_anti")), totals)
        found = cut(_instance_scores(edges, patterns))
    return found.groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("first"))).alias("best")).select("instance", (-F.col("best.first")).alias("kind"), "best.confidence")


_SPAN = "array<struct<start:long,kind:int,end:long>>"


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document doc_id and spans, an array<struct<start, kind, end>>: places of personal data in code
    points, end exclusive, kind as a number in KINDS, sorted by start, then kind.

    The fixed patterns' matches are always there; what contexts add overlaps none of them. Null text
    counts as empty and has no spans; null ids are ordinary values, repeated rows are documents of their
    own (their contexts count each, their instances once), other columns are ignored, and an
    empty table gives no rows. Texts are scanned whole, whatever their length."""
    common.arrow_rows(docs.sparkSession, 1000)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_column(text).alias("text"))
    scanned = cut(rows.mapInArrow(_scanned, "doc_id long, places array<struct<start:long,end:long,kind:int,instance:long,contexts:array<long>,patterns:array<long>>>").withColumn("row", F.monotonically_increasing_id()))
    edges = cut(pattern_graph(scanned))
    accepted = bootstrapped(edges, _counted(rows, edges), rounds)
    places = scanned.select("row", F.explode(F.filter("places", lambda p: p["kind"] < 0)).alias("p")).select("row", "p.start", "p.end", "p.instance")
    more = places.join(accepted, "instance").groupBy("row").agg(F.collect_list(F.struct("start", (F.col("kind") + len(BASE)).cast("int").alias("kind"), "end")).alias("more"))
    base = F.transform(F.filter("places", lambda p: p["kind"] >= 0), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))).cast(_SPAN)
    return scanned.select("row", "doc_id", base.alias("base")).join(more, "row", "left").select("doc_id", F.array_sort(F.concat("base", F.coalesce(F.col("more").cast(_SPAN), F.array().cast(_SPAN)))).alias("spans"))


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, the number of each fixed pattern's spans and of those that contexts add,
    base_sha256 and spans, as find says."""
    s = find(docs, doc_id, text)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return s.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(written(F.filter("spans", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["kind"] >= len(BASE))).cast("long").alias("n_context"))
