"""Secret scans in DataFrame functions only: three fixed patterns, and a randomness test battery with
length-aware false-discovery control for tokens that no pattern names.

Battery. A candidate is a run of 20 or more token characters with a letter and a digit. Its encoding
is inferred (hexadecimal, base 32, letters and digits, base 64) and its symbols are tested for
  * uniformity: the chi-squared statistic over the encoding's alphabet, one-sided, standardised by
    its exact mean and variance under uniform symbols (cells are sparse at these lengths);
  * runs: the Wald-Wolfowitz count of runs above and below the alphabet's middle, two-sided;
  * serial correlation: the lag-one correlation of symbol values, two-sided.
The three are combined as if independent, p = 1 - (1 - least)**3. Shorter tokens are not tested.

False-discovery control. What p random tokens have is not taken from theory (counts are coarse at these
lengths and the tests depend on each other): for each stratum (encoding, length class) random tokens
are drawn once, with a fixed seed, and give the share S(t) of random tokens with p >= t. Words and
identifiers gather near 0. With N(t) tokens of the whole table at p >= t, about N(h) / S(h) of the
stratum's tokens are random if all others lie below h. R is the least of that at h = 1/10, less a
standard error, of that at each h from there to 6/10, and two standard errors, and of the stratum's size.
Then about 1 - R * S(t) / N(t) of the tokens accepted at t are false, and each stratum takes the least t
that holds this below ``fdr``. A stratum of under some 45 random tokens can't hold it and adds none.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pattern, group whose length counts (0: all of it), least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
KINDS = (*BASE, "random")
#: A whole run of token characters, long enough for the tests to tell words from random text.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: encoding: what its tokens match, its symbols in order, whether it takes letters in either case
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", True),
    "base32": (r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", True),
    "alnum_one_case": (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", "abcdefghijklmnopqrstuvwxyz0123456789", True),
    "alnum": (r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", False),
    # - and _ of the address-safe form stand for + and /
    "base64": (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False),
}
STEPS = 200
#: Length classes are of eight lengths, from that of the shortest candidate to one that is open above.
SHORTEST, PER_CLASS, LAST_CLASS = 20, 8, 16
#: Random tokens drawn for each length of each encoding, and the seed.
DRAWS, SEED = 500, 20240611


def _found(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, kind, end, token>> of the leftmost non-overlapping matches that pass keep.

    What lies between matches and the matches themselves alternate, so running lengths place them."""
    parts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("token")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["token"])).alias("at"),
            F.when(
                keep(s["token"]),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + s["gap"] + F.length(s["token"])).alias("end"), s["token"].alias("token")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), walk).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a logistic approximation (within 2e-4)."""
    c = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * c + 0.07056 * c * c * c))


def _battery(token: Column) -> Column:
    """struct<encoding, length, p>: p of the hypothesis that the token is random in its encoding."""
    bare = F.rtrim(token, F.lit("="))
    encoding = F.lit("base64")
    for name, (pattern, _, _) in reversed(list(ENCODINGS.items())[:-1]):
        encoding = F.when(F.regexp_like(token, F.lit(pattern)), F.lit(name)).otherwise(encoding)
    symbols = F.element_at(F.create_map(*[F.lit(x) for k, v in ENCODINGS.items() for x in (k, v[1])]), encoding)
    either = encoding.isin([k for k, v in ENCODINGS.items() if v[2]])
    plain = F.when(either, F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    values = F.transform(F.regexp_extract_all(plain, F.lit("."), F.lit(0)), lambda c: F.instr(symbols, c).cast("double"))

    def tests(v: Column, a: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, s: acc + F.pow(F.size(F.filter(v, lambda x: x == s)).cast("double"), F.lit(2.0)))
        chi = (squares * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        middle = (a + 1) / 2
        nexts = F.slice(v, 2, F.size(v) - 1)
        firsts = F.slice(v, 1, F.size(v) - 1)
        above = F.size(F.filter(v, lambda x: x > middle)).cast("double")
        below = n - above
        runs = 1 + F.size(F.filter(F.zip_with(firsts, nexts, lambda x, y: (x > middle) != (y > middle)), lambda x: x)).cast("double")
        expected = 1 + 2 * above * below / n
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
        power = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        lagged = F.aggregate(F.zip_with(firsts, nexts, lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda acc, x: acc + x)
        serial = (lagged / F.greatest(power, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        least = F.least(_upper_tail(chi), 2 * _upper_tail(F.abs(runs - expected) / spread), 2 * _upper_tail(F.abs(serial)))
        return 1 - F.pow(1 - F.least(F.lit(1.0), least), F.lit(3.0))

    # one-element arrays bind values and alphabet size, so that each is evaluated once
    bound = F.transform(F.array(F.struct(values.alias("v"), F.length(symbols).cast("double").alias("a"))), lambda x: tests(x["v"], x["a"]))
    return F.struct(encoding.alias("encoding"), F.least(F.floor(F.length(bare) / PER_CLASS), F.lit(LAST_CLASS)).cast("int").alias("length"), F.element_at(bound, 1).alias("p"))


def _candidates(text: Column) -> Column:
    found = _found(text, CANDIDATE, len(BASE), lambda t: F.regexp_like(t, F.lit("[0-9]")) & F.regexp_like(t, F.lit("[A-Za-z]")))
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), _battery(c["token"]).alias("test")))


@cache
def null_law() -> str:
    """Of each stratum the shares S of drawn random tokens with p of at least 0, 1, 2, ... STEPS-ths,
    as JSON. The formulas are those of the battery."""
    rng = np.random.default_rng(SEED)

    def tail(z):
        z = np.clip(z, -8, 8)
        return 1 / (1 + np.exp(1.5976 * z + 0.07056 * z**3))

    out = []
    for encoding, (_, symbols, _) in ENCODINGS.items():
        a = len(symbols)
        digit, letter = (np.array([f(c) for c in symbols]) for f in (str.isdigit, str.isalpha))
        upper, special = np.array([c.isupper() for c in symbols]), np.array([not c.isalnum() for c in symbols])
        for length in range(SHORTEST // PER_CLASS, LAST_CLASS + 1):
            found = []
            for n in range(max(SHORTEST, length * PER_CLASS), (length + 1) * PER_CLASS):
                v = rng.integers(0, a, (DRAWS, n))
                ok = digit[v].any(1) & letter[v].any(1)  # what makes a candidate of this encoding
                if encoding == "alnum":
                    ok &= upper[v].any(1) & (letter & ~upper)[v].any(1)
                if encoding == "base64":
                    ok &= special[v].any(1)
                v = v[ok]
                rows = len(v)
                counts = np.bincount((np.arange(rows)[:, None] * a + v).ravel(), minlength=rows * a).reshape(rows, a)
                chi = ((counts**2).sum(1) * a / n - n - (a - 1)) / np.sqrt(2 * (a - 1) * (n - 1) / n)
                x = v + 1.0
                high = x > (a + 1) / 2
                above = high.sum(1).astype(float)
                runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
                expected = 1 + 2 * above * (n - above) / n
                spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / (n - 1), 1e-9))
                d = x - x.mean(1, keepdims=True)
                serial = ((d[:, 1:] * d[:, :-1]).sum(1) / np.maximum((d * d).sum(1), 1e-9) + 1 / n) * np.sqrt(n)
                least = np.minimum(1.0, np.minimum(tail(chi), np.minimum(2 * tail(np.abs(runs - expected) / spread), 2 * tail(np.abs(serial)))))
                found.append(1 - (1 - least) ** 3)
            p = np.minimum(np.floor(np.concatenate(found) * STEPS), STEPS - 1).astype(int)
            at_least = np.bincount(p, minlength=STEPS)[::-1].cumsum()[::-1] / len(p)
            out.append({"encoding": encoding, "length": length, "share": at_least.round(6).tolist()})
    return json.dumps(out)


def thresholds(candidates: DataFrame, fdr: float = 0.05) -> DataFrame:
    """(encoding, length, t) of the strata in which some threshold holds the false-discovery rate.

    ``candidates`` has a column ``test``. The histogram has at most encodings x length classes x
    STEPS rows, whatever the table."""
    binned = candidates.select("test.encoding", "test.length", F.least(F.floor(F.col("test.p") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")).groupBy("encoding", "length", "step").agg(F.count("*").alias("n"))
    law = candidates.sparkSession.range(1).select(F.explode(F.from_json(F.lit(null_law()), "array<struct<encoding:string,length:int,share:array<double>>>")).alias("s"))
    law = law.select("s.encoding", "s.length", F.posexplode("s.share").alias("step", "share"))
    stratum = Window.partitionBy("encoding", "length")
    b = law.join(F.broadcast(binned), ["encoding", "length", "step"], "left").withColumn("above", F.sum(F.coalesce("n", F.lit(0))).over(stratum.orderBy(F.col("step").desc())))
    share, step = F.col("share"), F.col("step")
    guess, error = F.col("above") / share, F.sqrt(F.col("above") * (1 - share)) / share
    bound = F.when(step == 0, F.col("above")).when(step == STEPS // 10, guess - error).when((step > STEPS // 10) & (step <= STEPS * 6 // 10) & (share > 0), guess + 2 * error)
    b = b.withColumn("random", F.min(bound).over(stratum))
    ok = (F.col("above") > 0) & (1 - F.col("random") * F.col("share") / F.col("above") <= fdr)
    return b.where(ok).groupBy("encoding", "length").agg((F.min("step") / STEPS).alias("t"))


def scan(docs: DataFrame, text: str = "text", fdr: float = 0.05, out: str = "spans") -> DataFrame:
    """The rows of docs with ``out``, an array<struct<start, kind, end>>: places of secrets in code
    points, end exclusive, kind as a number in KINDS, sorted by start, then kind.

    The patterns' matches are always there. A random token is added if its stratum's threshold
    accepts it and no pattern's match overlaps it. Null and empty texts have no spans; other columns
    stay as they are (an own column of that name is replaced), repeated rows are scanned alike. No row is shuffled: the histogram of p-values is the only
    thing gathered, and its thresholds (at most encodings x length classes rows) are broadcast."""
    t = common.text_column(text)
    limits = thresholds(docs.select(F.explode(F.transform(_candidates(t), lambda c: c["test"])).alias("test")), fdr)
    table = F.broadcast(limits.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "encoding", F.col("length").cast("string")), "t"))).alias("__limits")))

    base = [
        _found(t, pattern if kind != "hex" else r"(?<![0-9a-f])[0-9a-f]{16,}+", i, (lambda m, g=group, p=pattern, n=least: F.length(F.regexp_extract(m, p, g) if g else m) >= n))
        for i, (kind, (pattern, group, least)) in enumerate(BASE.items())
    ]
    place = "array<struct<start:int,kind:int,end:int>>"
    d = docs.withColumn("__base", F.transform(F.concat(*base), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(place))
    d = d.withColumn("__more", _candidates(t)).join(table)
    accepted = F.filter(
        F.col("__more"),
        lambda c: (c["test"]["p"] >= F.coalesce(F.element_at(F.col("__limits"), F.concat_ws("/", c["test"]["encoding"], c["test"]["length"].cast("string"))), F.lit(2.0)))
        & ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    accepted = F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return d.withColumn(out, F.array_sort(F.concat("__base", accepted)).cast(place)).drop("__base", "__more", "__limits")


def _written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, the counts of each pattern's secrets and of random tokens, base_sha256 and
    spans. Null text counts as empty and has none; null ids are ordinary values, repeated rows (and
    equal spans of rows) stay as they are, other columns are ignored, an empty table gives no rows."""
    s = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", *map(count, BASE), F.sha2(_written(F.filter("spans", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), count("random"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, the same columns, with every secret's place in the text overwritten by
    ``mark``; overlapping places become one mark. A null text stays null."""
    s = scan(docs, text, out="__spans")
    end = F.aggregate(
        "__spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
            F.struct(
                x["end"].alias("at"),
                F.when(x["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], F.array(F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))).alias("parts"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return s.withColumn(text, F.when(F.size("__spans") > 0, end).otherwise(F.col(text))).select(docs.columns)
