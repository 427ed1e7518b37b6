"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. A document is the set of hashes of its word shingles; documents of one set are one class.
2. A class has a signature of COORDINATES minima. Each (coordinate, value) is a posting token.
   Two sets of similarity s agree in Binomial(COORDINATES, s) coordinates; MATCHES is so low that a
   pair of similarity 0.8 falls below it with a probability of 3e-6.
3. Prefix: tokens are ordered by how many classes hold them, rarest first. Two classes that agree in
   MATCHES coordinates share one of the first COORDINATES - MATCHES + 1, so only these are posted.
   Tokens of one class meet nobody; a class all of whose first tokens are such is skipped whole.
4. Pivots: each class is compared, on whole sets, with the one list head with which it shares most
   posted tokens. That joins most of a large group by as many comparisons as it has classes.
5. Skip: a posting list all of whose classes are connected by now is done. The components that meet
   in the others form families, cut into blocks of bounded size. Within two blocks the posting lists of
   each class's prefix are merged; whoever is met there and isn't connected yet has its other lists
   probed, as long as MATCHES collisions can still be reached, and is confirmed on whole sets. What
   leaves a task is a spanning forest of confirmed links.
6. Components of the confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY = 5, (80, 100)
COORDINATES, MATCHES = 96, 58
#: Shingles in a block of a family, about (a set counts as SET_WEIGHT more); a task holds two blocks.
BLOCK_SHINGLES, SET_WEIGHT = 1_000_000, 100
#: Comparisons with one pivot in a task, about, and candidates of a set that are compared one by one.
PIVOT_SETS, MANY = 256, 16

_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words; of fewer words, the
    whole sequence is one; without words none. Only A-Z are lower-cased."""
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.frombuffer(hashlib.blake2b(b"\0" + b" ".join(w), digest_size=8).digest(), np.uint64).copy()
    # words to 64 bits once each, then a polynomial of them
    known: dict[bytes, int] = {}
    for x in w:
        if x not in known:
            known[x] = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")
    h = np.fromiter([known[x] for x in w], np.uint64, len(w))
    n = len(w) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each of COORDINATES hash functions, as 32 bits; very long sets in pieces."""
    least = None
    for i in range(0, len(hashes), 4096):
        part = ((hashes[i : i + 4096, None] * _SEEDS[None, :]) >> np.uint64(24)).min(0)
        least = part if least is None else np.minimum(least, part)
    return (least * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.list_(pa.int32()))])


def _node(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _signed(rows: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t, words) for t in b["text"].to_pylist()]
            b = b.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))
            sets = [s for s in sets if len(s)]
            yield common.batch(_SIGNED, doc_id=b["doc_id"], key=b["key"], node=[_node(s) for s in sets], n_shingles=[len(s) for s in sets], signature=[signature(s).view(np.int32) for s in sets])

    return rows.mapInArrow(run, "doc_id long, key long, node binary, n_shingles long, signature array<int>")


def _postings(classes: DataFrame) -> DataFrame:
    """(node, token) of each class's prefix, without tokens that one class alone holds."""
    token = F.explode(F.transform("signature", lambda v, i: F.xxhash64(i, v)))
    tokens = classes.select("node", token.alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
    # lone tokens are rarer than any other: they fill the prefix first
    per_class = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("classes", "token"))).alias("own"))
    prefix = F.slice("own", F.lit(1), F.greatest(F.lit(COORDINATES - MATCHES + 1 - COORDINATES) + F.size("own"), F.lit(0)))
    return per_class.select("node", F.explode(prefix).alias("t")).select("node", "t.token")


def similar(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sorted sets have at least that Jaccard similarity; their sizes alone may rule it out."""
    part, whole = similarity
    if len(a) > len(b):
        a, b = b, a
    if whole * len(a) < part * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return whole * both >= part * (len(a) + len(b) - both)


def _pivot_links(batches: Iterable[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows hub, salt, member, node, own, sorted so that a hub comes before its members: confirmed links."""
    key = own = None
    for b in batches:
        a, z = [], []
        for hub, salt, member, node, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = np.frombuffer(data, np.uint64)
            if not member:
                key, own = (hub, salt), found
            elif key == (hub, salt) and similar(own, found, similarity):
                a.append(node)
                z.append(hub)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(z, pa.binary())], ["a", "b"])


def _pivots(postings: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links of classes to the list head (a token's least class) they share most tokens with.
    A head of many classes goes to several tasks."""
    heads = postings.groupBy("token").agg(F.min("node").alias("hub"))
    shared = postings.join(heads, "token").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = common.checkpointed(shared.groupBy("node").agg(F.max(F.struct("n", "hub")).alias("best")).select("node", "best.hub"))
    sizes = best.groupBy("hub").agg(F.ceil(F.count("*") / PIVOT_SETS).cast("int").alias("salts"))
    member = best.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("member"), "node")
    hub = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), F.col("hub").alias("node"))
    both = member.unionByName(hub).join(sets, "node").select("hub", "salt", "member", "node", "own")
    return both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(lambda it: _pivot_links(it, similarity), "a binary, b binary")


def _links(batches: Iterable[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Confirmed links (a, b) between components, of each (family, i, j) group: rows family, i, j,
    block, node, component, set."""
    for (_, i, j), rows in common.groups_in_order(batches, ["family", "i", "j"]):
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        found = confirmed(sets, None if i == j else [r[3] == i for r in rows], [r[5] for r in rows], similarity)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([rows[x][5] for x, _ in found], pa.binary()), pa.array([rows[y][5] for _, y in found], pa.binary())], ["a", "b"])


def _prefix_lists(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of the sets' prefixes in this order of rarity: the holders by list, where each list
    begins (one more: the end), and of each set its lists (COORDINATES - MATCHES + 1 of them)."""
    n = len(signatures)
    tokens = signatures.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))[None, :]
    _, of, often = np.unique(tokens, return_inverse=True, return_counts=True)
    of = of.reshape(n, COORDINATES)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    own = np.sort(rank[of], axis=1)[:, : COORDINATES - MATCHES + 1]
    order = np.argsort(own.ravel(), kind="stable")
    begin = np.searchsorted(own.ravel()[order], np.arange(len(often) + 1))
    return order // own.shape[1], begin, own


def _collide(own: np.ndarray, others: np.ndarray, step: int = 24) -> np.ndarray:
    """Which of the other signatures agree in MATCHES coordinates or more; one that can't reach them any
    more is skipped."""
    left, count = np.arange(len(others)), np.zeros(len(others), np.int64)
    for at in range(0, COORDINATES, step):
        count += (others[left, at : at + step] == own[None, at : at + step]).sum(1)
        ok = count + max(0, COORDINATES - at - step) >= MATCHES
        left, count = left[ok], count[ok]
    return left[np.argsort(-count, kind="stable")]


def confirmed(sets: list[np.ndarray], first: list[bool] | None, component: list, similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets' components (first: only between sets of it
    and the others). Sets of the most frequent component need no search of their own: each pair of
    two components has one that isn't of it."""
    n = len(sets)
    place: dict = {}
    label = np.array([place.setdefault(c, len(place)) for c in component], np.int64)
    if len(place) < 2:
        return []
    parent = list(range(len(place)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    part, whole = similarity
    sizes = np.array([len(s) for s in sets], np.int64)
    signatures = np.array([signature(s) for s in sets])
    holders, begin, own = _prefix_lists(signatures)
    side = None if first is None else np.array(first)
    large = label == np.bincount(label).argmax()
    index = None
    out = []
    for x in np.flatnonzero(~large).tolist():
        met = np.unique(np.concatenate([holders[begin[t] : begin[t + 1]] for t in own[x].tolist()]))
        met = met[(label[met] != label[x]) & (large[met] | (met > x))]
        met = met[whole * np.minimum(sizes[met], sizes[x]) >= part * np.maximum(sizes[met], sizes[x])]
        if side is not None:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        met = met[_collide(signatures[x], signatures[met])]
        sure = len(met) > MANY
        if sure:  # the common shingles of all of them at once, by the sets' own posting lists
            if index is None:
                index = _shingle_lists(sets, sizes)
            met = met[whole * (c := _common(index, x, n)[met]) >= part * (sizes[x] + sizes[met] - c)]
        for y in met.tolist():
            a, b = root(label[x]), root(label[y])
            if a != b and (sure or similar(sets[x], sets[y], similarity)):
                out.append((x, y))
                parent[a] = b
    return out


def _shingle_lists(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sets' posting lists: holders by shingle, where each shingle's begin, of each entry its
    shingle, and where each set's entries begin."""
    data = np.concatenate(sets)
    order = np.argsort(data, kind="stable")
    new = np.concatenate(([True], data[order][1:] != data[order][:-1]))
    of = np.empty(len(data), np.int64)
    of[order] = np.cumsum(new) - 1
    return np.repeat(np.arange(len(sets)), sizes)[order], np.append(np.flatnonzero(new), len(data)), of, np.concatenate(([0], np.cumsum(sizes)))


def _common(index: tuple[np.ndarray, ...], x: int, n: int) -> np.ndarray:
    """How many shingles of set x each set has."""
    holders, begin, of, entries = index
    runs = of[entries[x] : entries[x + 1]]
    lengths = begin[runs + 1] - begin[runs]
    at = np.repeat(begin[runs] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    return np.bincount(holders[at], minlength=n)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id of its group, itself included) and
    kept (doc_id = component_id).

    Similarity is Jaccard of whole sets, ``similarity`` its least value as a fraction. Null and
    blank texts have the empty set and are alone. Repeated rows, and rows of one id with different
    texts, are documents of their own; null ids are no representatives (a group of null ids only has
    a null component_id), and a row is kept if its id is that of its group. Other columns are ignored;
    an empty table gives no rows.
    """
    grouped = with_groups(docs, words, similarity, doc_id, text)
    return grouped.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def with_groups(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, key (a hash of its text), n_shingles, group (null for the empty set) and
    component_id, as near_duplicates says."""
    common.arrow_rows(docs.sparkSession)
    t = common.text_column(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("key"))
    # signatures once for each class; equal sets meet here, whatever their number
    membership = common.checkpointed(_signed(rows, words))
    classes = membership.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    postings = common.checkpointed(_postings(classes))
    # one row stands for a class; only those that are in the table several times need to be made one
    alike = membership.groupBy("node", "doc_id", "key").agg(F.count("*").alias("times"))
    picks = alike.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "times")).alias("pick"))
    wanted = postings.select("node").distinct().join(picks, "node").select("node", F.col("pick.doc_id").alias("w_id"), F.col("pick.key").alias("w_key"), "pick.times")
    texts = rows.join(wanted, (rows["key"] == wanted["w_key"]) & rows["doc_id"].eqNullSafe(wanted["w_id"]))
    texts = texts.where("times = 1").select("node", "text").union(texts.where("times > 1").dropDuplicates(["node"]).select("node", "text"))

    def whole_sets(batches):
        for b in batches:
            found = [shingle_hashes(x, words) for x in b["text"].to_pylist()]
            right = [i for i, (s, node) in enumerate(zip(found, b["node"].to_pylist(), strict=True)) if len(s) and _node(s) == node]
            yield pa.RecordBatch.from_arrays([b["node"].take(pa.array(right, pa.int64())), pa.array([found[i].tobytes() for i in right], pa.binary())], ["node", "own"])

    sets = common.checkpointed(texts.mapInArrow(whole_sets, "node binary, own binary"))
    groups = common.components(_pivots(postings, sets, similarity))
    nodes = common.checkpointed(classes.select("node", "least", "n_shingles").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    listed = postings.join(nodes.select("node", "component"), "node")
    mixed = listed.groupBy("token").agg(F.min("component").alias("hub"), F.max("component").alias("last")).where("hub <> last").select("token", "hub")
    listed = common.checkpointed(listed.join(mixed, "token").select("node", "component", "hub").distinct())
    families = common.components(listed.select(F.col("component").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("family"))
    sized = listed.select("node", "component").distinct().join(families, "component").join(nodes.select("node", "n_shingles"), "node")
    blocks = sized.groupBy("family").agg(F.ceil(F.sum(F.col("n_shingles") + SET_WEIGHT) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    # hash of the node deals a family to its blocks; each pair of blocks is a group of its own
    member = sized.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    owned = member.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = owned.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "own")
    links = pairs.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node").mapInArrow(lambda it: _links(it, similarity), "a binary, b binary")
    joined = common.components(links).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    of_class = nodes.join(joined, "component", "left").select("node", "least", F.coalesce("joined", "component").alias("group"))
    least = of_class.groupBy("group").agg(F.min("least").alias("component_id"))
    own = membership.select("doc_id", "key", "n_shingles", "node").join(of_class.join(least, "group").select("node", "group", "component_id"), "node")
    blank = rows.where(~F.regexp_like("text", F.lit(common.WORD))).select("doc_id", "key", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("component_id"))
    return own.select("doc_id", "key", "n_shingles", "group", "component_id").unionByName(blank)
