"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by
backpropagation through time. It labels every position; a document's probabilities are pooled over
the positions of its letters.

Texts are cut into windows of WINDOW bytes and the state starts anew in each, so that windows of all
documents form one batch and a text of any length takes bounded memory. The gates are piecewise
linear (clipped), in training and in use, which costs a fraction of exponentials.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, HIDDEN = 128, 8
#: Documents to learn from, dealt to the languages and taken of each in the order of a hash of the
#: id, and windows taken of each.
MAX_DOCS, WINDOWS_EACH = 3000, 3
STEPS, BATCH, RATE, SEED = 220, 128, 0.02, 7
#: Windows worked on at once.
BLOCK = 2048
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class Network:
    """Of each direction (forward, backward): x, what each byte adds to update gate, reset gate and
    candidate (256 x 3H); u, the recurrent weights (H x 3H). out (2H x languages) and bias."""

    langs: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    x = [draw(256, 3 * hidden, s=0.3) for _ in range(2)]
    for a in x:
        a[:, : 2 * hidden] += 0.5  # gates begin half open
    return Network(langs, x, [draw(hidden, 3 * hidden, s=0.3 / hidden**0.5) for _ in range(2)], draw(2 * hidden, len(langs), s=0.3), np.zeros(len(langs), np.float32))


def _run(x: np.ndarray, u: np.ndarray, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T x B x H) over byte steps (T x B). keep: gets what the backward pass needs."""
    t, b = steps.shape
    n = u.shape[0]
    states = np.empty((t, b, n), np.float32)
    h = np.zeros((b, n), np.float32)
    g, a = np.empty((b, 3 * n), np.float32), np.empty((b, 3 * n), np.float32)
    for i in range(t):
        np.take(x, steps[i], axis=0, out=g)
        np.matmul(h, u, out=a)
        zr = g[:, : 2 * n] + a[:, : 2 * n]
        np.clip(zr, 0, 1, out=zr)
        c = g[:, 2 * n :] + zr[:, n:] * a[:, 2 * n :]
        if keep is not None:
            keep.append((h, zr, c, a[:, 2 * n :].copy()))
        c = np.clip(c, -1, 1, out=None if keep is not None else c)
        h = np.subtract(h, c, out=states[i])
        h *= zr[:, :n]
        h += c
    return states


def _back(x: np.ndarray, u: np.ndarray, steps: np.ndarray, keep: list, upon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of x and u, given those of the states, back through time."""
    n = u.shape[0]
    gx, gu = np.zeros_like(x), np.zeros_like(u)
    dh = np.zeros_like(upon[0])
    for i in range(len(steps) - 1, -1, -1):
        h, zr, raw, an = keep[i]
        z, r, c = zr[:, :n], zr[:, n:], np.clip(raw, -1, 1)
        dh = dh + upon[i]
        dz = dh * (h - c) * ((z > 0) & (z < 1))
        dc = dh * (1 - z) * (np.abs(raw) < 1)
        dr = dc * an * ((r > 0) & (r < 1))
        d = np.concatenate((dz, dr, dc), axis=1)
        da = np.concatenate((dz, dr, dc * r), axis=1)
        np.add.at(gx, steps[i], d)
        gu += h.T @ da
        dh = dh * z + da @ u.T
    return gx, gu


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    """Of each position (T x B) the probabilities of the languages; windows is B x T bytes."""
    steps = np.ascontiguousarray(windows.T)
    ahead, behind = _run(net.x[0], net.u[0], steps), _run(net.x[1], net.u[1], steps[::-1])[::-1]
    n = net.u[0].shape[0]
    return _softmax(ahead @ net.out[:n] + behind @ net.out[n:] + net.bias)


def gradients(net: Network, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the letters' positions, and its gradient for each of net.parts()."""
    steps = np.ascontiguousarray(windows.T)
    kept: list[list] = [[], []]
    s = [_run(net.x[0], net.u[0], steps, kept[0]), _run(net.x[1], net.u[1], steps[::-1], kept[1])]
    both = np.concatenate((s[0], s[1][::-1]), axis=2)
    p = _softmax(both @ net.out + net.bias)
    weight = _LETTER[steps]
    weight = weight / max(1.0, float(weight.sum()))
    at = np.broadcast_to(target, steps.shape)[..., None]
    loss = -float((np.log(np.take_along_axis(p, at, 2)[..., 0] + 1e-9) * weight).sum())
    np.put_along_axis(p, at, np.take_along_axis(p, at, 2) - 1, 2)
    p *= weight[..., None]
    g_out, g_bias = np.tensordot(both, p, ((0, 1), (0, 1))), p.sum((0, 1))
    upon = p @ net.out.T
    n = net.u[0].shape[0]
    gx0, gu0 = _back(net.x[0], net.u[0], steps, kept[0], upon[..., :n])
    gx1, gu1 = _back(net.x[1], net.u[1], steps[::-1], kept[1], upon[::-1, :, n:])
    return loss, [gx0, gx1, gu0, gu1, g_out, g_bias]


def train(windows: np.ndarray, target: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = SEED) -> Network:
    """Adam over batches in which languages are equally likely; the same input gives the same network."""
    net = new_network(langs, seed=seed)
    rng = np.random.default_rng(seed)
    of = [np.flatnonzero(target == k) for k in range(len(langs))]
    parts = net.parts()
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, steps + 1):
        rows = np.array([rng.choice(of[k]) for k in rng.integers(0, len(langs), BATCH)])
        _, grads = gradients(net, windows[rows], target[rows])
        size = sum(float((g * g).sum()) for g in grads) ** 0.5
        rate = RATE * min(1.0, 2 * (1 - t / (steps + 1)))
        for p, g, a, b in zip(parts, grads, m, v, strict=True):
            g = g * min(1.0, 1 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.98**t)) + 1e-8)).astype(np.float32)
    return net


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (rows of bytes, 0 at the end of a text) and whose each is."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([-(-len(r) // WINDOW) for r in raw], np.int64)
    data = b"".join([r.ljust(int(n) * WINDOW, b"\0") for r, n in zip(raw, counts, strict=True)])
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> Network | None:
    """Learn from windows of at most ``max_docs`` documents with an id, a language and a text; None if
    there are none. Each language gives all of its documents or an equal share of the bound, chosen
    by a hash of the id, so that a rare language is learned too. The windows of a document are spread
    over all of it."""
    common.arrow_rows(docs.sparkSession)
    order = [F.xxhash64(doc_id, F.lit("language")), F.col(doc_id)]
    source = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(lang).alias("lang"), common.text_column(text).alias("text")).where("text <> ''")
    chosen, _, _ = common.sample_by_class(source.select(doc_id, "lang").distinct(), "lang", order, max_docs)

    def sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, data = [], []
            for lang_, text_ in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                w, _ = windows_of([text_])
                for i in sorted({len(w) * (2 * j + 1) // (2 * WINDOWS_EACH) for j in range(WINDOWS_EACH)}):
                    langs.append(lang_)
                    data.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["lang", "bytes"])

    # of several texts of an id the one with the least hash: no repeated id exceeds the bound
    texts = source.join(F.broadcast(chosen), [doc_id, "lang"]).groupBy(doc_id, "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = texts.select("lang", "text").mapInArrow(sample, "lang string, bytes binary").orderBy("lang", F.xxhash64("bytes"), "bytes").toArrow()
    if not got.num_rows:
        return None
    names = got["lang"].to_pylist()
    langs = sorted(set(names))
    windows = np.frombuffer(b"".join(got["bytes"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([langs.index(x) for x in names]), langs)


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """Of each text the mean of its letters' position probabilities (zeros if it has no letter)."""
    sums = np.zeros((len(texts), len(net.langs) + 1))
    windows, owner = windows_of(texts)
    for i in range(0, len(windows), BLOCK):
        w, own = windows[i : i + BLOCK], owner[i : i + BLOCK]
        letters = _LETTER[w.T]
        p = np.einsum("tbl,tb->bl", probabilities(net, w), letters)
        np.add.at(sums, own, np.concatenate((p, letters.sum(0)[:, None]), axis=1))
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows of docs with ``lang_pred`` and ``score``, the pooled probability of that language.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there was
    nothing to learn from. Other columns stay (own ones of
    these names are replaced); repeated rows are predicted alike."""
    common.arrow_rows(docs.sparkSession, 500)
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.drop("lang_pred", "score")
    schema = common.T.StructType([*base.schema.fields, common.T.StructField("lang_pred", common.T.StringType()), common.T.StructField("score", common.T.DoubleType())])

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b[text].to_pylist()]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if held.value is not None and texts:
                p = pooled(held.value, texts)
                for i, (best, top) in enumerate(zip(p.argmax(1).tolist(), p.max(1).tolist(), strict=True)):
                    if top > 0 and any(map(str.isalpha, texts[i])):
                        names[i], scores[i] = held.value.langs[best], min(1.0, top)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return base.mapInArrow(run, schema)


def label(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows of docs with ``labels array<tinyint>``: of each byte of the text the most probable
    language, as its place in net.langs, and -1 where there is no letter."""
    common.arrow_rows(docs.sparkSession, 200)
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.drop("labels")

    def run(batches):
        for b in batches:
            out = []
            for t in b[text].to_pylist():
                w, _ = windows_of([t or ""])
                best = [np.where(_LETTER[w[i : i + BLOCK].T] > 0, probabilities(held.value, w[i : i + BLOCK]).argmax(2), -1).T.ravel() for i in range(0, len(w), BLOCK)]
                out.append(np.concatenate(best)[: len((t or "").encode())].astype(np.int8) if best else np.zeros(0, np.int8))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int8()))], [*b.schema.names, "labels"])

    return base.mapInArrow(run, common.extended(base, "labels", common.T.ArrayType(common.T.ByteType())))


def judge(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score; learns only where crc32(doc_id) mod 5 is not 0.

    Null text and texts without a letter are ``und``; a null id counts as the empty text in the fold;
    repeated rows are predicted alike, other columns are ignored, and an empty table gives no rows."""
    net = fit(docs.where(common.fold(doc_id, 5) != 0), doc_id=doc_id, lang=lang, text=text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (common.fold(doc_id, 5) == 0).alias("held_out"))
    return predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")
