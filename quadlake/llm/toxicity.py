"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input has word and character parts: evidence of the word and of its character
n-grams (how much oftener they stand in toxic texts of the sample), a learnt vector of the
word, and the mean of learnt vectors of its character n-grams. Both directions run at once
over windows of words; attention weighs the states and a logistic unit scores the window.
A text is as toxic as its most toxic window; windows overlap and cover all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, mixed, pieces, PrefixHash, slices, texts

WINDOW, STRIDE = 64, 48
BITS, SMALL = 18, 1024
HIDDEN, WORD_DIM, CHAR_DIM = 12, 4, 4
GRAMS = (3, 5, 8)
_WORD_BYTE = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


@dataclass
class Tokens:
    """Words of several texts: hashes, n-gram hashes (flat, with counts by word), words of each text."""

    words: np.ndarray
    grams: np.ndarray
    n_grams: np.ndarray
    upto: np.ndarray


def tokens(batch: list[str]) -> Tokens:
    """Words are runs of ASCII letters and digits and of bytes above 127, in lower case."""
    raw = [x.lower().encode() for x in batch]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    inside = _WORD_BYTE[data]
    data = np.where(inside, data, np.uint8(32))
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    hashed = PrefixHash(data)
    words = hashed.of(start, end) if len(start) else np.empty(0, np.uint64)
    size = end - start
    counts = np.stack([np.maximum(size + 3 - n, 0) for n in GRAMS], 1) if len(start) else np.zeros((0, len(GRAMS)), np.int64)
    total = counts.sum(1)
    grams = np.empty(int(total.sum()), np.uint64)
    at = np.cumsum(total) - total
    for k, n in enumerate(GRAMS):
        if not len(start) or len(data) < n:
            continue
        c = counts[:, k]
        step = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        grams[np.repeat(at + counts[:, :k].sum(1), c) + step] = mixed(hashed.windows(n)[np.repeat(start - 1, c) + step] + np.uint64(n))
    upto = np.searchsorted(start, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) + 1)
    return Tokens(words, grams, total, upto)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(SMALL - 1)).astype(np.int64)


def evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of standing in a toxic text, over their standard error."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return (np.clip(odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)), -4, 8) / 2).astype(np.float32)


def _pooled(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum and mean of each word's n-gram values (every word has an n-gram)."""
    at = np.cumsum(counts) - counts
    return np.maximum.reduceat(values, at), np.add.reduceat(values, at) / counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


class Network:
    """Parameters, forward pass and gradients."""

    FEATURES = 3 + WORD_DIM + CHAR_DIM

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN

        def draw(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": draw(SMALL, WORD_DIM, scale=0.1), "char": draw(SMALL, CHAR_DIM, scale=0.1),
            "wx": draw(2, self.FEATURES, 3 * h, scale=0.3), "b": np.zeros((2, 1, 3 * h), np.float32), "wh": draw(2, h, 3 * h, scale=0.3),
            "wa": draw(2 * h, h, scale=0.3), "ba": np.zeros(h, np.float32), "va": draw(h, scale=0.3), "w": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
        }

    def states(self, g: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """g: (2, time, windows, 3 * HIDDEN), the second direction in reverse; states (time, windows, 2 * HIDDEN)."""
        h, wh = np.zeros((2, g.shape[2], HIDDEN), np.float32), self.p["wh"]
        out = np.empty((2, g.shape[1], g.shape[2], HIDDEN), np.float32)
        for t in range(g.shape[1]):
            m = mask[:, t, :, None]
            a = np.matmul(h, wh)
            zr = _sigmoid(g[:, t, :, : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(g[:, t, :, 2 * HIDDEN :] + r * a[..., 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((h, z, r, n, a[..., 2 * HIDDEN :], m))
            h = h + m * (new - h)
            out[:, t] = h
        return np.concatenate([out[0], out[1, ::-1]], 2)

    def pooled(self, s: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        u = np.tanh(s @ self.p["wa"] + self.p["ba"])
        e = np.where(mask, u @ self.p["va"], np.float32(-1e9))
        e = np.exp(e - e.max(0)) * mask
        a = e / np.maximum(e.sum(0), np.float32(1e-9))
        context = (a[..., None] * s).sum(0)
        return context @ self.p["w"] + self.p["bias"][0], context, a, u

    def gates(self, x: np.ndarray) -> np.ndarray:
        """x: (time, windows, features)."""
        return np.stack([x @ self.p["wx"][0] + self.p["b"][0], x[::-1] @ self.p["wx"][1] + self.p["b"][1]])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p, kept = self.p, []
        both = np.stack([mask, mask[::-1]]).astype(np.float32)
        s = self.states(self.gates(x), both, kept)
        logit, context, a, u = self.pooled(s, mask)
        d = (_sigmoid(logit) - y) / len(y)
        g = {"w": context.T @ d, "bias": d.sum(keepdims=True)}
        dc = d[:, None] * p["w"]
        ds = a[..., None] * dc
        da = (s * dc).sum(2)
        de = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tnh,tn->h", u, de)
        du = de[..., None] * p["va"] * (1 - u * u)
        g["wa"], g["ba"] = np.einsum("tni,tnh->ih", s, du), du.sum((0, 1))
        ds += du @ p["wa"].T
        dh_out = np.stack([ds[..., :HIDDEN], ds[::-1, :, HIDDEN:]])
        dg = np.empty((2, *x.shape[:2], 3 * HIDDEN), np.float32)
        g["wh"], dh = np.zeros_like(p["wh"]), np.zeros((2, x.shape[1], HIDDEN), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            h, z, r, n, an, m = kept[t]
            dh = dh + dh_out[:, t]
            dn_ = m * dh
            dn = dn_ * (1 - z) * (1 - n * n)
            dz = dn_ * (h - n) * z * (1 - z)
            dr = dn * an * r * (1 - r)
            back = np.concatenate([dz, dr, dn * r], 2)
            dg[:, t, :, :HIDDEN], dg[:, t, :, HIDDEN : 2 * HIDDEN], dg[:, t, :, 2 * HIDDEN :] = dz, dr, dn
            g["wh"] += np.matmul(h.transpose(0, 2, 1), back)
            dh = (1 - m) * dh + dn_ * z + np.matmul(back, p["wh"].transpose(0, 2, 1))
        g["b"] = dg.sum((1, 2))[:, None]
        g["wx"] = np.stack([np.einsum("tni,tnk->ik", x, dg[0]), np.einsum("tni,tnk->ik", x[::-1], dg[1])])
        return g, dg[0] @ p["wx"][0].T + (dg[1] @ p["wx"][1].T)[::-1]


class Model:
    """Evidence tables and network; scores texts."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, network: Network | None):
        self.words, self.grams, self.network = words, grams, network

    def features(self, t: Tokens) -> np.ndarray:
        p = self.network.p
        x = np.empty((len(t.words) + 1, Network.FEATURES), np.float32)
        x[-1] = 0  # stands for no word
        if len(t.words):
            x[:-1, 0] = self.words[_bucket(t.words)]
            x[:-1, 1], x[:-1, 2] = _pooled(self.grams[_bucket(t.grams)], t.n_grams)
            x[:-1, 3 : 3 + WORD_DIM] = p["word"][_small(t.words)]
            at = np.cumsum(t.n_grams) - t.n_grams
            x[:-1, 3 + WORD_DIM :] = np.add.reduceat(p["char"][_small(t.grams)], at) / t.n_grams[:, None]
        return x

    def windows(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all windows of all texts (-1: none), (windows, WINDOW), and whose they are."""
        first = np.concatenate([[0], t.upto[:-1]]).astype(np.int64)
        n = t.upto - first
        count = np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1
        whose = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count)
        at = (first[whose] + k * STRIDE)[:, None] + np.arange(WINDOW)
        return np.where(at < t.upto[whose][:, None], at, -1), whose

    def window_scores(self, x: np.ndarray, at: np.ndarray, step: int = 1024) -> np.ndarray:
        p, out = self.network.p, np.empty(len(at), np.float32)
        g = [x @ p["wx"][d] + p["b"][d] for d in (0, 1)]
        for a in range(0, len(at), step):
            w = np.ascontiguousarray(at[a : a + step].T)
            mask = w >= 0
            s = self.network.states(np.stack([g[0][w], g[1][w[::-1]]]), np.stack([mask, mask[::-1]]).astype(np.float32))
            out[a : a + step] = self.network.pooled(s, mask)[0]
        return out

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(batch))
        t = tokens(batch)
        at, whose = self.windows(t)
        logit = self.window_scores(self.features(t), at)
        starts = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
        return 1 / (1 + np.exp(-np.maximum.reduceat(logit, starts).astype(np.float64)))


def train(samples: list[tuple[str, int]], updates: int = 160, seed: int = 5) -> Model:
    """Fits a model to labelled texts; the same texts give the same model.

    Counts of evidence leave out the text they are used for. Which window of a toxic text is
    toxic is not known: its strongest one is taken, first by evidence, then by the network.
    """
    y = np.array([label for _, label in samples], np.float32)
    zero = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(zero, zero, None)
    whole = [x for x, _ in samples]
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    counts = {name: np.zeros((2, 1 << BITS), np.float32) for name in ("word", "gram")}

    def sliced():
        """Tokens of a few texts at a time, and the label of each word and n-gram's text."""
        for a, b in slices(whole, len, 200_000):
            t = tokens(whole[a:b])
            doc = np.repeat(np.arange(a, b), np.diff(t.upto, prepend=0))
            yield t, doc, np.repeat(doc, t.n_grams)

    for t, doc, gram_doc in sliced():
        for name, hashes, owner in (("word", t.words, doc), ("gram", t.grams, gram_doc)):
            pairs = np.unique(owner << BITS | _bucket(hashes))
            toxic = y[pairs >> BITS] > 0
            which = pairs & ((1 << BITS) - 1)
            counts[name][1] += np.bincount(which[toxic], minlength=1 << BITS)
            counts[name][0] += np.bincount(which[~toxic], minlength=1 << BITS)

    def own(name: str, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Evidence without the text that it is for."""
        bucket, label = _bucket(hashes), y[owner]
        return evidence(counts[name][1][bucket] - label, counts[name][0][bucket] - (1 - label), n1 - label, n0 - (1 - label))

    net = Network()
    model = Model(*(evidence(counts[n][1], counts[n][0], n1, n0) for n in ("word", "gram")), net)
    known, word_parts, gram_parts, size_parts, ends = [], [], [], [], [np.zeros(1, np.int64)]
    for t, doc, gram_doc in sliced():
        if len(t.words):
            most, mean = _pooled(own("gram", t.grams, gram_doc), t.n_grams)
            known.append(np.stack([own("word", t.words, doc), most, mean], 1).astype(np.float32))
        word_parts.append(_small(t.words).astype(np.int16))
        gram_parts.append(_small(t.grams).astype(np.int16))
        size_parts.append(t.n_grams)
        ends.append(t.upto + ends[-1][-1])
    if not known:
        return Model(zero, zero, None)
    words, grams, n_grams, upto = np.concatenate(word_parts), np.concatenate(gram_parts), np.concatenate(size_parts), np.concatenate(ends)[1:]
    word_of, gram_of = np.append(words, 0).astype(np.int16), grams
    gram_at = np.append(np.cumsum(n_grams) - n_grams, 0)
    x = np.zeros((len(words) + 1, Network.FEATURES), np.float32)
    x[:-1, :3] = np.concatenate(known)

    def refresh() -> None:
        """The learnt vectors of all words, a part at a time."""
        for a in range(0, len(words), 100_000):
            b = min(a + 100_000, len(words))
            x[a:b, 3 : 3 + WORD_DIM] = net.p["word"][words[a:b]]
            first = int(gram_at[a])
            x[a:b, 3 + WORD_DIM :] = np.add.reduceat(net.p["char"][gram_of[first : first + int(n_grams[a:b].sum())]], gram_at[a:b] - first) / n_grams[a:b, None]

    refresh()
    n_grams = np.append(n_grams, 0)
    at, whose = model.windows(Tokens(words, grams, n_grams, upto))
    starts = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
    strength = np.where(at >= 0, (x[:, 0] + x[:, 1])[at], -9).max(1)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    keep_features = np.ones((2, Network.FEATURES), np.float32)
    keep_features[0, 3:] = 0  # half of the windows are seen without learnt vectors, so that these can't replace evidence
    for turn in range(2):
        ends = np.append(starts[1:], len(whose))
        best = np.array([a + int(strength[a:b].argmax()) for a, b in zip(starts, ends, strict=True)])
        other = np.array([rng.integers(a, b) for a, b in zip(starts, ends, strict=True)])[y == 0]
        pick = np.concatenate([best, other, [-1]])
        label = np.concatenate([y, np.zeros(len(other) + 1, np.float32)])
        chosen = np.concatenate([at[pick[:-1]], np.full((1, WINDOW), -1)])
        size = int(min(128, max(16, len(pick) // 4)))
        for k in range(updates):
            rows = rng.choice(len(pick), size, replace=False)
            w = np.ascontiguousarray(chosen[rows].T)
            mask = w >= 0
            flat = w.ravel()
            c = n_grams[flat]
            take = gram_of[np.repeat(gram_at[flat], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)]
            owner = np.repeat(np.arange(len(flat)), c)
            inputs = x[flat].copy()
            inputs[:, 3 : 3 + WORD_DIM] = np.where(mask.ravel()[:, None], net.p["word"][word_of[flat]], 0)
            scale = 1 / np.maximum(c, 1).astype(np.float32)[:, None]
            for q in range(CHAR_DIM):
                inputs[:, 3 + WORD_DIM + q] = np.bincount(owner, net.p["char"][take, q], len(flat)) * scale[:, 0]
            inputs *= keep_features[rng.integers(0, 2, size)][None].repeat(WINDOW, 0).reshape(len(flat), -1)
            g, dx = net.gradients(inputs.reshape(WINDOW, size, -1), mask, label[rows])
            dx = dx.reshape(len(flat), -1) * 0.05 * mask.ravel()[:, None]
            g["word"] = np.stack([np.bincount(word_of[flat], dx[:, 3 + q], SMALL) for q in range(WORD_DIM)], 1).astype(np.float32)
            g["char"] = np.stack([np.bincount(take, (dx[:, 3 + WORD_DIM + q] * scale[:, 0])[owner], SMALL) for q in range(CHAR_DIM)], 1).astype(np.float32)
            step += 1
            rate = 0.02 * (1 - 0.8 * (turn * updates + k) / (2 * updates))
            for name, grad in g.items():
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.99 * v[name] + 0.01 * grad * grad
                net.p[name] = (net.p[name] - rate * (0.05 if name in ("word", "char") else 1) * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        refresh()
        strength = np.concatenate([model.window_scores(x[w := np.unique(at[a : a + 1024])], np.where(at[a : a + 1024] < 0, -1, np.searchsorted(w, at[a : a + 1024]))) for a in range(0, len(at), 1024)])
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 1000, clean: int = 1500, chars: int = 10_000) -> Model:
    """Trains on a bounded sample: at most `toxic` and `clean` labelled texts of at most `chars` characters.

    Rows whose crc32(doc_id) mod 5 is 0 are held out. The rows of least hash are taken, so the
    sample does not depend on partitioning. Labels that are null or lack a text are left out;
    of rows that repeat a doc_id one text is taken, so that the driver gets no more than the sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.where(F.length(F.col("text").cast("string")) <= chars).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.join(short, "doc_id", "left_semi")  # before the limit, so that longer texts take no places
    order = [F.xxhash64("doc_id"), "doc_id"]
    few = known.where("toxic = 1").orderBy(*order).limit(toxic).union(known.where("toxic = 0").orderBy(*order).limit(clean))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars).join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    return train([(r.text, r.toxic) for r in sorted(rows, key=lambda r: r.doc_id)])


def _score_batches(batches, model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in pieces(batches):
        whole = texts(batch.column("text"))
        scores = np.empty(len(whole))
        for a, b in slices(whole, len, 500_000):
            scores[a:b] = model.scores(whole[a:b])
        yield batch, scores


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id mod 5 is 0), score and predicted (score >= 0.5) of every whole text.

    Null and empty texts are scored as a window without words; repeated rows give a row each;
    an empty table gives an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, scores in _score_batches(batches, shared.value):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(freed(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, scores in _score_batches(batches, shared.value):
            yield batch.filter(pa.array(scores < limit))

    return docs.mapInArrow(freed(run), docs.schema)
