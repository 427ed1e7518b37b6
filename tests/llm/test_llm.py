"""The training-data operators against brute force, exact round trips and held-out accuracy, and on
nulls, empty tables, repeated rows, long texts and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import bpe, chat, language, minhash, mixing, order_minhash, quality, secrets, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, spans string"


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, f"s{i % 3}" if i % 4 else None, len(t or ""), 1.0, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "   \n", "one", "one two three", "tie tie", "tie tie", "é" * 50, "a" * 5000]


def test_secrets_spans_agree_with_brute_force(spark):
    rng = random.Random(3)
    bits = ["password: ", "Token=", "abcdefghijkl", "AKIA", "ABCDEFGHIJKLMN01", "0123456789abcdef0", "secret: token: x", ' api_key="', "ü ", "\n", "🎉", "Zm9vYmFyYmF6cXV4MTIz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(150)] + ODD
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)]
    got = {r["doc_id"]: r for r in secrets.digest(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end()) for k, (_, rx, g, least) in enumerate(kinds) for m in rx.finditer(t or "") if len(m[g]) >= least)
        written = ",".join(f"{kinds[k][0]}:{a}:{e}" for a, k, e in found)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[i]["spans"].split(","))


def test_random_tokens_are_added_and_words_are_not(spark):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(400)]
    plain = [f"maximum_number_of_partitions_{i % 10}_to_read" for i in range(60)]
    got = secrets.digest(docs(spark, [f"x {t} y" for t in tokens + plain])).orderBy("doc_id").collect()
    assert sum(r["n_random"] for r in got[:400]) >= 360 and sum(r["n_random"] for r in got[400:]) == 0
    cut = secrets.redact(docs(spark, [None, "token=abcdefghijkl12 ok", *[f"a {t}" for t in tokens]])).orderBy("doc_id").collect()
    assert cut[0]["text"] is None and cut[1]["text"] == "[SECRET] ok" and cut[1]["spans"] == "y"
    assert sum(r["text"] == "a [SECRET]" for r in cut[2:]) >= 360


MIXES = {"hex": "0123456789abcdef", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


@pytest.mark.parametrize("share", [0.25, 0.6, 0.82])
def test_false_share_of_known_mixtures(spark, share):
    """Three encodings in three length classes; false tokens are of repetitive symbols, alike the random ones in encoding."""
    rng = random.Random(int(100 * share))
    texts, kind = [], []
    for name, alphabet in MIXES.items():
        for n in (24, 40, 66):
            for i in range(700):
                real = i < 700 * share
                few = "".join(rng.sample(alphabet, 6)) + "a1" + ("+" if name == "base64" else "Z" if name == "alnum" else "")
                texts.append("x " + "".join(rng.choice(alphabet if real else few) for _ in range(n)) + " y")
                kind.append((name, n, real))
    found = secrets.scan(docs(spark, texts), out="found").withColumn("more", F.exists("found", lambda x: x["kind"] == 3)).select("doc_id", "more")
    test = secrets.thresholds(docs(spark, texts).select(F.explode(F.transform(secrets._candidates(F.col("text")), lambda c: c["test"])).alias("test")))
    assert test.where("encoding in ('alnum', 'base64', 'hex')").count() >= 6
    got = {r["doc_id"]: r["more"] for r in found.collect()}
    for name in ("alnum", "base64"):  # whole hex tokens are the pattern's own
        for n in (24, 40, 66):
            right, wrong = (sum(got[i] for i, k in enumerate(kind) if k == (name, n, real)) for real in (True, False))
            assert wrong <= 0.05 * (right + wrong) + 3, (name, n, right, wrong)
            assert right >= 0.6 * 700 * share, (name, n, right, wrong)


def test_drawn_law_is_that_of_the_battery(spark):
    rng = random.Random(40)
    import json

    law = {(x["encoding"], x["length"]): x["share"] for x in json.loads(secrets.null_law())}
    for name, alphabet in MIXES.items():
        rows = [("".join(rng.choice(alphabet) for _ in range(43)),) for _ in range(1500)]
        t = spark.createDataFrame(rows, "text string").select(F.explode(secrets._candidates(F.col("text"))).alias("c")).where(F.col("c.test.encoding") == name).select("c.test.*").toPandas()
        assert set(t.length) == {5}
        for step in (20, 60, 100, 160):
            assert abs((t.p >= step / secrets.STEPS).mean() - law[name, 5][step]) < 0.06, (name, step)


def test_repeats_agree_with_brute_force(spark):
    rng = random.Random(1)
    shared = [words(rng, 60) for _ in range(4)]
    texts = [" ".join([words(rng, rng.randrange(40)), rng.choice(shared), words(rng, rng.randrange(40)), rng.choice(shared)[: rng.randrange(300)]]) for _ in range(40)]
    texts += [texts[0], texts[1], "é" * 300, *ODD]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in raw for i in range(len(d) - 199))
    for hot in (substrings.HOT_CONTEXTS, 2):
        kept, substrings.HOT_CONTEXTS = substrings.HOT_CONTEXTS, hot
        got = {r["doc_id"]: r for r in substrings.remove_repeats(docs(spark, texts)).collect()}
        substrings.HOT_CONTEXTS = kept
        for i, d in enumerate(raw):
            cover = np.zeros(len(d) + 1, bool)
            for j in range(len(d) - 199):
                if seen[d[j : j + 200]] > 1:
                    cover[j : j + 200] = True
            assert bytes(got[i]["kept"]) == bytes(b for b, c in zip(d, cover, strict=False) if not c)
            assert got[i]["n_spans"] == int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())


def test_near_duplicates_agree_with_brute_force(spark):
    rng = random.Random(2)
    base = [words(rng, 80, 5000).split() for _ in range(6)]
    texts = list(ODD)
    for _ in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split() if (t or "").isascii() else (t or "").encode().split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    for block, pivots in ((minhash.BLOCK_SHINGLES, minhash.PIVOT_SETS), (900, 2)):
        kept, (minhash.BLOCK_SHINGLES, minhash.PIVOT_SETS) = (minhash.BLOCK_SHINGLES, minhash.PIVOT_SETS), (block, pivots)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), words=4).collect()}
        minhash.BLOCK_SHINGLES, minhash.PIVOT_SETS = kept
        assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("many", [0, 16])
def test_links_between_components_are_brute_force(many, monkeypatch):
    monkeypatch.setattr(minhash, "MANY", many)
    rng = random.Random(21)
    base = [[rng.randrange(2**60) for _ in range(60)] for _ in range(3)]
    sets, component = [], []
    for i in range(120):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(14)):
            own[rng.randrange(60)] = rng.randrange(2**60)
        sets.append(np.array(sorted(set(own)), np.uint64))
        component.append(rng.choice(["large", "large", f"c{i % 40}"]))
    sides = [rng.random() < 0.5 for _ in sets]
    for first in (None, sides):
        def joined(pairs):
            of = {c: c for c in component}
            for x, y in pairs:
                a, b = of[component[x]], of[component[y]]
                of = {c: (a if r == b else r) for c, r in of.items()}
            return {frozenset(c for c in of if of[c] == r) for r in of.values()}

        every = [(x, y) for x in range(120) for y in range(x) if (first is None or first[x] != first[y]) and 5 * len(set(sets[x].tolist()) & set(sets[y].tolist())) >= 4 * len(set(sets[x].tolist()) | set(sets[y].tolist()))]
        got = minhash.confirmed(sets, first, component)
        assert joined(got) == joined(every) and len(got) <= len(set(component)) - 1


def test_near_duplicates_of_null_and_repeated_ids(spark):
    t = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(None, t[0]), (None, t[0]), (None, t[0] + " more"), (5, t[1]), (5, t[2]), (5, t[1]), (9, t[0]), (-(2**63), t[2] + " x"), (3, None), (None, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, words=4).collect()), key=str)
    want = [(None, 37, 9)] * 2 + [(None, 38, 9), (5, 37, 5), (5, 37, -(2**63)), (5, 37, 5), (9, 37, 9), (-(2**63), 38, -(2**63)), (3, 0, 3), (None, 0, None)]
    assert got == sorted(want, key=str)


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(1, 30)) for _ in range(600)] + ODD
    got = mixing.mix(docs(spark, texts), keep_source=True).toPandas()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert len(got) == len(texts) and (got.taken <= 3 * got["size"]).all()
    assert (by.target <= 3 * by["size"] + 1e-6).all() and abs(by.target.sum() - got["size"].sum()) < 1e-6
    assert ((by.taken - by.target).abs() <= 5100).all()


def test_mix_reruns_agree_on_null_ids_and_ties(spark):
    rng = random.Random(9)
    texts = [words(rng, 20 + i % 3) for i in range(300)]
    rows = [(None if i % 3 else 7, t, "en", f"s{i % 4}", 0, 1.0, "x", "y") for i, t in enumerate(texts)]
    runs = [Counter(tuple(r) for r in mixing.mix(spark.createDataFrame(order, SCHEMA).repartition(n), keep_source=True, slices=8).collect()) for order, n in ((rows, 1), (rows[::-1], 5))]
    assert runs[0] == runs[1] and sum(runs[0].values()) == 300
    # documents without an id don't share a slice
    assert mixing.mix(spark.createDataFrame(rows, SCHEMA), keep_source=True).where("doc_id is null").select("taken").distinct().count() >= 2


def test_fingerprints_compare_order(spark):
    rng = random.Random(6)
    texts = [words(rng, 300) for _ in range(12)] + [None, "", "short", "same text here now", "same text here now", "a" * 5000, "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(800)), "b" * 100]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in order_minhash.edited_neighbours(d, parts=4).collect()}
    ids = sorted(got, reverse=True)
    assert len(ids) == len(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[i] or "", texts[nxt] or ""
        cut = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
    assert got[15]["fingerprint"] == got[16]["fingerprint"] and got[16]["near_next"] == 1.0
    assert all(got[i]["near_edited"] > got[i]["near_next"] for i in range(1, 12))
    assert all(got[i]["near_edited"] > 0.2 for i in (17, 18, 19))  # no blanks, two thirds unchanged


def test_fingerprint_order_takes_any_id(spark):
    rows = [(-(2**63), "least"), (2**63 - 1, "most"), (7, "x"), (7, "y"), (7, "y"), *[(None, f"n{i}") for i in range(30)], (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash")).repartition(3)
    for parts in (1, 5, 40):
        got = order_minhash.edited_neighbours(d, parts=parts).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        assert sorted((r["doc_id"] is None, r["edited_sha256"]) for r in got) == sorted((r["doc_id"] is None, r["edited_sha256"]) for r in order_minhash.edited_neighbours(d, parts=3).collect())


def test_order_minhash_selection_is_brute_force(monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    rng = random.Random(9)
    for text in ["a b c a b c a b c d e f", "xy", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", words(rng, 60, 8), "\U0001f389é漢" * 20]:
        k = min(6, len(text))
        grams, seen, ids = [text[i : i + k] for i in range(len(text) - k + 1)], Counter(), []
        h = order_minhash.numbered_kmers(text)
        for g in grams:
            ids.append((g, seen[g]))
            seen[g] += 1
        # equal hashes are equal numbered k-mers, within a text and across texts
        assert len(set(h.tolist())) == len(set(ids)) == len(grams)
        again = order_minhash.numbered_kmers(text + "tail of it")
        assert (again[: len(h)] == h).all() if len(text) >= 6 else True
        places = order_minhash.selected(h)
        for j in range(order_minhash.COORDINATES):
            value = lambda p, j=j: ((int(h[p]) >> 32) * int(order_minhash._TURNS[j]) & 0xFFFFFFFF) ^ int(order_minhash._FLIPS[j])
            assert places[j].tolist() == sorted(sorted(range(len(h)), key=lambda p: (value(p), p))[:2])


def slow_base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    often = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(often)


def test_base_counts():
    assert quality.base_counts("a b c a b c\n#x\n#x\n \n ") == (8, 10, 2, 1, 6)
    assert quality.base_counts("") == (0, 0, 0, 0, 0)
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "b", "é", "🎉", " ", " ", "\n", "#", "\x0b", "\u2003", "word "]) for _ in range(rng.randrange(120))) for _ in range(200)]
    assert [quality.base_counts(t) for t in texts] == [slow_base_counts(t) for t in texts]
    many = quality.tokenized(texts, True).counts
    assert [tuple(int(many[c][i]) for c in quality.COUNTS) for i in range(len(texts))] == [slow_base_counts(t) for t in texts]


def slow_log_perplexity(texts):
    """Interpolated modified Kneser-Ney bigrams by dictionaries."""
    w = [(t or "").split() for t in texts]
    n = Counter(x for own in w for x in own)
    known = {x for x, c in n.items() if c >= 2}
    kinds = max(1, len(n) - len(known))
    lines = [["<s>", *[x if x in known else "<unk>" for x in own], "<s>"] for own in w]
    two = Counter(p for own in lines for p in zip(own, own[1:]))
    symbols = known | {"<unk>", "<s>"}

    def steps(counts):
        n1, n2, n3, n4 = (sum(c == i for c in counts) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [i - (i + 1) * y * b / a if a else 0.75 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [0, *[min(max(x, 0.05), i) for i, x in enumerate(d, 1)]]

    precede = Counter(b for _, b in two)
    d1, d2 = steps(list(precede.values())), steps(list(two.values()))
    total = sum(precede.values())
    left = sum(d1[min(c, 3)] for c in precede.values()) / total
    single = {x: (max(precede[x] - d1[min(precede[x], 3)], 0) / total if precede[x] else 0) + left / len(symbols) for x in symbols}
    follow = {}
    for (a, _), c in two.items():
        follow.setdefault(a, []).append(c)

    def p(a, b):
        own = follow.get(a, [])
        rest = sum(d2[min(c, 3)] for c in own) / sum(own) if own else 1
        return ((two[a, b] - d2[min(two[a, b], 3)]) / sum(own) if own else 0) + rest * single[b]

    assert all(abs(sum(p(a, b) for b in symbols) - 1) < 1e-9 for a in list(symbols)[:20])
    return [-sum(np.log(p(a, b) / (kinds if b == "<unk>" else 1)) for a, b in zip(own, own[1:])) / (len(own) - 1) for own in lines]


def test_perplexity_is_brute_force_and_bands_reject(spark, monkeypatch):
    rng = random.Random(7)
    river = ["the", "漢字", "\ue000", "\U0001f389", *[f"river{i}" for i in range(150)]]
    texts = []
    for i in range(80):
        w = ["the"]
        while len(w) < 60 + i % 40:  # each word has few successors
            w.append(river[(river.index(w[-1]) * 7 + rng.randrange(5)) % len(river)])
        texts.append(" ".join(w) + (f" rare{i}" if i % 3 else ""))
    shuffled = texts[5].split()
    rng.shuffle(shuffled)
    noise = " ".join("".join(rng.choice("qxzjkv#@0981") for _ in range(6)) for _ in range(80))
    every = [*texts, " ".join(shuffled), noise, *ODD]
    monkeypatch.setattr(quality, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(quality, "PART_WORDS", 500)
    d = docs(spark, every).union(docs(spark, ["autre langue"], "fr").withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["doc_id"]: r for r in quality.judge(d.repartition(3)).collect()}
    assert len(got) == len(every) + 1 and got[None]["n_words"] == 2 and got[None]["base_failed"]
    want = slow_log_perplexity(every)
    for i, t in enumerate(every):
        assert got[i]["log_perplexity"] == pytest.approx(want[i], abs=1e-4), i
        assert tuple(got[i][c] for c in quality.COUNTS) == slow_base_counts(t or "")
    assert not got[81]["kept"] and not got[81]["base_failed"] and not got[80]["kept"] and not got[80]["base_failed"]
    assert sum(got[i]["kept"] for i in range(80)) >= 70
    twice = quality.judge(d.union(d)).collect()
    assert len(twice) == 2 * len(got) and len({(r["doc_id"], r["log_perplexity"]) for r in twice}) == len(got)


def test_toxicity_learns_held_out(spark):
    rng = random.Random(8)
    bad, texts, labels = ["idiot", "scum", "clown"], [], []
    for i in range(500):
        w = words(rng, 40).split()
        if i % 4 == 0:
            w[5] = w[20] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = [r for r in toxicity.judge(docs(spark, texts), table).collect() if r["held_out"]]
    assert len(got) > 80 and sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) >= 0.95 * len(got)
    odd = toxicity.judge(docs(spark, ODD), table.where("doc_id < 0")).collect()
    assert len(odd) == len(ODD) and {r["score"] for r in odd} == {0.5}


def test_toxicity_is_brute_force(spark):
    rng = random.Random(18)
    texts = [" ".join(rng.choice(["idiot", "scum", "tree", "Fluß", "漢字", "sea", "to"]) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    label = [int("idiot" in t or rng.random() < 0.1) for t in texts]

    def grams(t):
        return set(order for order in toxicity.ngrams(t).tolist())

    # every character n-gram of 3 to 6 has its bucket, and nothing else
    padded = f" {texts[0].lower()} "
    distinct = {padded[i : i + n] for n in (3, 4, 5, 6) for i in range(len(padded) - n + 1)}
    assert len(grams(texts[0])) <= len(distinct) and len(toxicity.ngrams(texts[0])) == sum(max(0, len(padded) - n + 1) for n in (3, 4, 5, 6))
    rows = spark.createDataFrame(list(zip(texts, label, [1.0] * 80)), "text string, label int, weight double")
    kept, r = toxicity.ratios(rows)
    counts = [Counter(g for t, y in zip(texts, label) if y == k for g in grams(t)) for k in (0, 1)]
    n = [label.count(0), label.count(1)]
    for g, value in zip(kept.tolist(), r.tolist()):
        a, b = counts[1][g], counts[0][g]
        assert value == pytest.approx(np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1)))
    sure = {g for g in counts[0].keys() | counts[1].keys() if counts[0][g] + counts[1][g] >= 4 and abs(np.log((counts[1][g] + 0.5) / (n[1] + 1)) - np.log((counts[0][g] + 0.5) / (n[0] + 1))) > 3 * (1 / (counts[1][g] + 0.5) + 1 / (counts[0][g] + 0.5)) ** 0.5}
    assert set(kept.tolist()) == sure
    table = spark.createDataFrame(list(enumerate(label)), "doc_id long, toxic int")
    d = docs(spark, texts)
    model = toxicity.fit(d, table)
    place = {g: i for i, g in enumerate(kept.tolist())}
    for row in toxicity.score(d.select("doc_id", "text"), model).collect():
        own = [place[g] for g in grams(row["text"]) if g in place]
        z = model.intercept + sum(model.weight[i] for i in own) / max(1, len(own)) ** 0.5
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    # an id that is repeated takes one place of the bound
    assert toxicity.training_rows(d.union(d).union(d), table, 40).count() == 40


def test_language_pooling_is_brute_force():
    net = language.new_network(["a", "b", "c"], 4, seed=3)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é1 漢\n") for _ in range(n)) for n in (0, 1, 40, 127, 300)]

    def direction(x, u, steps):
        h, out = np.zeros(4), []
        for s in steps:
            a = h @ u.astype(float)
            z, r = (np.clip(x[s, i * 4 : i * 4 + 4] + a[i * 4 : i * 4 + 4], 0, 1) for i in (0, 1))
            c = np.clip(x[s, 8:] + r * a[8:], -1, 1)
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    got = language.pooled(net, texts)
    for k, t in enumerate(texts):
        raw, sums, n = t.encode(), np.zeros(3), 0
        for at in range(0, len(raw), language.WINDOW):
            steps = list(raw[at : at + language.WINDOW].ljust(language.WINDOW, b"\0"))
            ahead, behind = direction(net.x[0], net.u[0], steps), direction(net.x[1], net.u[1], steps[::-1])[::-1]
            for s, f, b in zip(steps, ahead, behind):
                if s >= 128 or chr(s).isalpha():
                    e = np.exp(f @ net.out[:4] + b @ net.out[4:] + net.bias)
                    sums, n = sums + e / e.sum(), n + 1
        assert got[k] == pytest.approx(sums / max(n, 1), abs=1e-4)


def test_language_gradients_and_accuracy(spark):
    rng = np.random.default_rng(0)
    net = language.new_network(["a", "b"], 3)
    w, y = rng.integers(60, 130, (4, 10)).astype(np.uint8), rng.integers(0, 2, 4)
    _, grads = language.gradients(net, w, y)
    for k in (2, 3, 4):
        part, i = net.parts()[k], (1, 1)
        old = part[i].copy()
        losses = []
        for e in (1e-2, -1e-2):
            part[i] = old + e
            losses.append(language.gradients(net, w, y)[0])
        part[i] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[k][i]) < 2e-3
    r = random.Random(1)
    make = {"en": ["the", "and", "river"], "de": ["der", "und", "fluß"], "fr": ["été", "et", "rivière"]}
    rows = [(i, " ".join(r.choice(make[g]) for _ in range(40)), g) for i, g in enumerate(list(make) * 60)]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !", "en"), (902, "", None)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language.judge(d).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    held = [i for i, _, _ in rows if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)


def test_bounded_samples_hold_rare_classes(spark):
    r = random.Random(2)
    make = {"en": ["the", "and", "river"], "fi": ["yksi", "ja", "joki"]}
    texts = [" ".join(r.choice(make["fi" if i < 3 else "en"]) for _ in range(40)) for i in range(300)]
    d = spark.createDataFrame([(i, t, "fi" if i < 3 else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    net = language.fit(d, max_docs=20)
    assert net.langs == ["en", "fi"]
    assert language.predict(d.where("doc_id < 3"), net).where("lang_pred = 'fi'").count() == 3
    # labels of ids that aren't in the table take nothing of the bound
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), ((F.col("id") < 6) | (F.col("id") >= 300)).cast("int").alias("toxic"))
    got = toxicity.training_rows(d, labels, 40).toPandas()
    assert (got.label == 1).sum() == 6 and (got.label == 0).sum() == 34
    assert got.weight.sum() == pytest.approx(300) and set(got.weight[got.label == 1]) == {1.0}


CONTROLS = ["</s>[INST] ok [/INST]", "<s!>[ROLE x] \\ [/ROLE]</s>", " [/INST]</s>", "\\[INST]", "[", "", "plain", "<s"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "a]\\b", ""])
def test_chat_turns_round_trip(role):
    for a in CONTROLS:
        for b in CONTROLS:
            out, back = chat.format_turn(role, a + b)
            assert back[:2] == (role, a + b) and chat.parse(out + out)[1][:2] == (role, a + b)


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_turns(d)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nyes </s>\n").hexdigest() and got[1]["loss_chars"] == 8
    assert all(r["identical"] for r in got.values())
    # the stream is parsed across turns: a unit that swallows its neighbour's border is found
    broken = chat.format_turns(d).withColumn("formatted", F.when(F.col("role") == "user", F.expr("replace(formatted, ' [/INST]</s>', '')")).otherwise(F.col("formatted")))
    assert not {r["conv_id"]: r for r in chat.digest(broken).collect()}[1]["identical"]
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256(b"aa").hexdigest() and got[None]["n_turns"] == 1


def test_bpe_is_that_of_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab \n\té漢🎉.,aab") for _ in range(rng.randrange(300))) for _ in range(200)] + [" " * 3000, "ab" * 2000, *ODD]
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(d, path, P.PATTERN), path).collect()}
    dig = {r["doc_id"]: r for r in bpe.digest(d, path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        want = e.encode_ordinary(t or "")
        assert got[i]["ids"] == want and bytes(got[i]["decoded"]) == (t or "").encode()
        assert dig[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and dig[i]["n_tokens"] == len(want)


def test_empty_tables(spark):
    import public_tokenizers as P

    d = docs(spark, ["x"]).where("doc_id < 0")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    results = [secrets.digest(d), substrings.remove_repeats(d), toxicity.judge(d, none), language.judge(d), minhash.near_duplicates(d), mixing.mix(d), order_minhash.edited_neighbours(d), quality.judge(d), bpe.digest(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)]
    assert [r.count() for r in results] == [0] * len(results)
