"""Integer k-means, fill-in-the-middle and personal data against brute force, and on nulls, empty tables,
ties, repeated rows, long texts and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import centroids, infill, personal

ODD = [None, "", "   \n", "one", "one two three", "tie tie", "tie tie", "é" * 50, "a" * 5000, "\0x\x7f", "🎉a🎉bc"]
TEXTS = "doc_id long, text string, n long, h string, row long, places string, spans string, output string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", "z", "o") for i, t in zip(ids or range(len(texts)), texts, strict=True)], TEXTS)


# --- centroids ---------------------------------------------------------------------------------


def brute_clusters(rows):
    kept = [(i, [min(max(math.floor(64 * x), -centroids.MOST), centroids.MOST) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:16]
    c = [v for _, v in seeds]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(3):
        a = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, k) in zip(kept, a, strict=True) if k == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    a = assign()
    inertia = Counter()
    for d, j in a:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, a, strict=True))


@pytest.mark.parametrize("n", [5, 160])
def test_clusters_are_brute_force(spark, n):
    rng = np.random.default_rng(n)
    middles = rng.normal(0, 0.4, (6, 64))
    rows = [(int(i), [float(x) for x in middles[i % 6] + rng.normal(0, 0.05, 64)]) for i in range(n)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (2, rows[3][1]), (None, rows[4][1]), (900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [float("nan")] + [0.0] * 63), (906, [float("-inf")] * 64), (907, [0.0] * 64), (908, [0.0] * 64), (909, [1e30] * 64)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("cluster", F.lit(2))
    got = Counter(tuple(r) for r in centroids.cluster(d.repartition(3)).collect())
    assert got == brute_clusters(rows)
    assert centroids.cluster(d.where("vec_id > 9999")).count() == 0 == centroids.cluster(d.where("vec_id = 900")).count()


def test_bounds_never_exceed_distances_and_rule_out_most():
    rng = np.random.default_rng(3)
    for scale in (1, 40, centroids.MOST):
        v, c = (np.clip(np.round(rng.normal(0, scale, (n, 64))), -centroids.MOST, centroids.MOST).astype(np.int64) for n in (300, 16))
        v[:16] = c  # ties and distance 0
        s, f = centroids.compressed(v)
        cs, cf = centroids.compressed(c)
        exact = ((v[:, None] - c[None]) ** 2).sum(2)
        for j in range(16):
            assert (centroids.lower_bounds(s, f, cs[j], cf[j]) <= exact[:, j]).all()
        cluster, best, _ = centroids.nearest(v, s, f, c)
        assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
    c = np.round(rng.normal(0, 30, (16, 64))).astype(np.int64)
    v = c[rng.integers(0, 16, 500)] + np.round(rng.normal(0, 4, (500, 64))).astype(np.int64)
    assert centroids.nearest(v, *centroids.compressed(v), c)[2] < 2 * len(v)


# --- fill in the middle ------------------------------------------------------------------------


def brute_infill(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(u)
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_infill_is_brute_force(spark):
    rng = random.Random(1)
    bits = ["a", "Zx", "PSM", "P", "S", "M", "<", ">", "<P", "P>", " ", "\n", "é", "漢", "🎉", "7", "_", "?", "\r\n", "@["]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)] + [*ODD, "<P>", "a<M>b", "<P<P>", "x" * 300_000 + " é" * 50_000]
    ids = [None, None, *range(2, len(texts) - 1), 5]
    d = docs(spark, texts, ids)
    want = Counter((i, *brute_infill(i, t)) for i, t in zip(ids, texts, strict=True))
    assert Counter(tuple(r) for r in infill.fill_in_middle(d).collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = Counter(tuple(r) for r in infill.digest(d).select("doc_id", "n", "form", "output_sha256", "restored_sha256").collect())
    assert got == Counter((i, n, f, sha(o), sha(t or "")) for i, t in zip(ids, texts, strict=True) for n, f, _, _, o in [brute_infill(i, t)])
    assert infill.digest(d.where("doc_id = -1")).count() == 0


# --- personal data -----------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(t):
    def ok(kind, m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if ok(kind, m[0]))


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    body[0] = 4
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(body[::-1]))
    return "".join(map(str, body)) + str(-total % 10)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(7)
    bits = ["a", "b.c", "@", ".", "-", "_", "+", "1", "22", "255", "256", "0", "007", ".1", " ", "(", ")", "é", "x@y.z", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "٣", "\n", "5"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        base = personal.base_spans(t)
        assert base == brute_base(t), t
        found = personal.candidates(t, base)
        assert all(e <= s2 for (_, e), (s2, _) in zip(found, found[1:], strict=False)) and not any(s < be and bs < e for s, e in found for bs, _, be in base)
    for t in ("1" * 200_000, "1." * 100_000, "+1" * 50_000, "a@" * 50_000, "+(" * 50_000 + "1", "123456 " * 30_000, "x" * 100_000 + "123456" * 5, "x12345678-" * 5_000):
        for s, e in personal.candidates(t, personal.base_spans(t)):
            assert personal.contexts_of(t, s, t[s:e]) is not None


def planted(rng):
    """Texts with known phones, with numbers that only their contexts tell, and with numbers in contexts
    that words fill as often."""
    word = lambda: f"w{rng.choice('abcdefgh')}{rng.choice('xyz')}"
    fill = lambda n: " ".join(word() for _ in range(n))
    texts, hidden, clean = [], [], []
    for i in range(12):
        texts.append(f"{fill(9)} Hotline number: +1 (310) 555-{1000 + i} {fill(5)}")
        texts.append(f"{fill(4)} card no. {card(rng)} {fill(5)} of the {fill(3)}")
    for i in range(3):
        hidden.append(f"{fill(3)} hotline NUMBER: 0171 555 {200 + i}0 {fill(3)}")
    # only what the first round finds tells of these
    for i in range(3):
        hidden.append(f"{fill(3)} rufnummer lautet 0171 555 {200 + i}0 {fill(3)}")
    hidden.append(f"{fill(3)} rufnummer lautet 0202 777 111 {fill(3)}")
    for i in range(6):
        clean.append(f"{fill(3)} of the {10000000 + i} {fill(3)}")
        clean.append(f"{fill(3)} of the {card(rng)} {fill(3)}")
    clean += [f"{fill(3)} of the {fill(6)}" for _ in range(40)]
    return texts, hidden, clean


def brute_bootstrap(texts):
    edges, totals, where = Counter(), Counter(), defaultdict(list)
    for d, t in enumerate(texts):
        t = t or ""
        base = personal.base_spans(t)
        for s, e, k in [(s, e, k) for s, k, e in base] + [(s, e, -1) for s, e in personal.candidates(t, base)]:
            name = personal.instance_of(t[s:e])
            for c, p in personal.contexts_of(t, s, t[s:e]):
                edges[c, p, name, k] += 1
            if k < 0:
                where[name].append((d, s, e))
        words = [personal._folded(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        for n in (1, 2):
            for i in range(len(words) - n):
                if all(len(w) <= personal.MOST_BYTES for w in words[i : i + n]):
                    totals[personal._signed(personal.context_hash(*[personal.word_hash(w) for w in words[i : i + n]]))] += 1
    wide = Counter(p for _, p, _, _ in edges)
    edges = {k: n for k, n in edges.items() if wide[k[1]] >= personal.SUPPORT}
    seeds = {(i, k): 1.0 for _, _, i, k in edges if k >= 0}
    found = {}
    for _ in range(personal.ROUNDS):
        known = found | seeds
        right, was_open, support, opened, context = Counter(), Counter(), Counter(), Counter(), {}
        for (c, p, i, k), n in edges.items():
            context[p] = c
            opened[p] += n * (k < 0)
            for (j, of), conf in known.items():
                if j == i and (k < 0 or k == of):
                    right[p, of] += n * conf
                    was_open[p, of] += n * conf * (k < 0)
                    support[p, of] += conf >= 0.5
        patterns = {}
        for (p, of), r in right.items():
            against = max(totals[context[p]] - opened[p], 0) + was_open[p, of] + personal.UNKNOWN * (opened[p] - was_open[p, of])
            conf = r / (max(against, r) + 1)
            if support[p, of] >= personal.SUPPORT and conf >= personal.ACCEPT:
                patterns[p, of] = conf
        wrong = {}
        for i, p in {(i, p) for _, p, i, k in edges if k < 0}:
            for (q, of), conf in patterns.items():
                if q == p:
                    wrong[i, of] = wrong.get((i, of), 1.0) * (1 - min(conf, 0.999))
        found = {k: 1 - w for k, w in wrong.items() if 1 - w >= personal.ACCEPT}
    best = {}
    for (i, of), conf in sorted(found.items(), key=lambda x: (x[1], -x[0][1])):
        best[i] = of
    return {(d, s, e, of) for i, of in best.items() for d, s, e in where[i]}


def test_contexts_find_what_patterns_miss(spark):
    texts, hidden, clean = planted(random.Random(2))
    every = texts + hidden + clean + ODD
    got = {r["doc_id"]: r["spans"] for r in personal.find(docs(spark, every)).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        assert [tuple(s) for s in got[i] if s["kind"] < 4] == brute_base(t or "")
    more = {(i, s["start"], s["end"], s["kind"] - 4) for i, spans in got.items() for s in spans if s["kind"] >= 4}
    assert more == brute_bootstrap(every)
    found = {i for i, _, _, _ in more}
    a, b = len(texts), len(texts) + len(hidden)
    assert set(range(a, b)) <= found and not found & set(range(b, len(every))), found
    assert {k for _, _, _, k in more} == {3}
    # one round doesn't reach those that only found numbers tell of
    once = personal.find(docs(spark, every), rounds=1).where(F.exists("spans", lambda s: s["kind"] >= 4)).select("doc_id").collect()
    assert {r[0] for r in once} < found and b - 1 not in {r[0] for r in once}


def test_personal_digest_of_odd_tables(spark):
    text = "call +1 (310) 555-4510 or a.b@c.de from 10.0.0.1, card 4111111111111111"
    rows = docs(spark, [text, text, None, *[text] * 3], [None, None, 3, 4, 4, 5])
    got = personal.digest(rows).collect()
    written = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in brute_base(text))
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"], r["n_context"]) for r in got) == Counter({(None, 1, 1, 1, 1, written, 0): 2, (3, 0, 0, 0, 0, "", 0): 1, (4, 1, 1, 1, 1, written, 0): 2, (5, 1, 1, 1, 1, written, 0): 1})
    assert {r["base_sha256"] for r in got if r["doc_id"] == 5} == {hashlib.sha256(written.encode()).hexdigest()}
    assert personal.digest(rows.where("doc_id = -1")).count() == 0
