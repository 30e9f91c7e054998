"""Operator 3, toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the mean of embeddings of the word itself and of its character n-grams (hashed), so unseen words share what their
parts have taught.  A gated recurrent network reads each window of ``WINDOW`` words in both directions, attention pools its states, and a
logistic unit scores the pool.  Windows overlap by half; every window of a text is scored and the highest score is the text's, calibrated
to the label rate on texts set aside.

Training: at most ``TOXIC_DOCS`` toxic and ``CLEAN_DOCS`` clean labelled rows (those with the smallest hash of their id: the documented
bound), fitted on the driver.  A label belongs to a text and not to a window, so in each epoch a toxic text teaches by its highest window and
a clean one by its highest and a random one.  Embeddings start from the smoothed log odds of their feature.

Defined cases: null texts and texts without letters get the score of an empty pool; without labels of both classes every score is the label
rate (0 if there are none); repeated rows are scored each; only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from . import textvec as V
from .language_id import Text

WINDOW, STRIDE, HIDDEN, DIM = 32, 16, 12, 12
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 8192, 24576, (3, 4, 5)
TOXIC_DOCS, CLEAN_DOCS, EPOCHS, BATCH, CACHE = 2500, 4000, 10, 64, 120_000
THRESHOLD = 0.3
_tables: dict[str, tuple[V.Memo, np.ndarray]] = {}
V.cached("toxicity", _tables.clear)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def features(t: Text, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs, words ascending: the word's own bucket and its n-grams'."""
    ids = [(t.hash[which] % np.uint64(WORD_BUCKETS)).astype(np.int64)]
    own = [np.arange(len(which))]
    for n in GRAMS:
        h, w = t.grams(which, n)
        ids.append((V.mix(h + np.uint64(n)) % np.uint64(GRAM_BUCKETS)).astype(np.int64) + WORD_BUCKETS)
        own.append(w)
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return ids[order], own[order]


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word in the text) of all windows; the last one ends with the text."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, np.maximum(np.minimum(k * STRIDE, counts[doc] - WINDOW), 0)


class Net:
    """Parameters and passes.  Names: E embeddings; for both directions W, c (input), U, d (state); v attention; o, q output."""

    def __init__(self, seed: int = 1):
        g = np.random.default_rng(seed)
        r = lambda *s, f=1.0: (g.standard_normal(s) * f).astype(np.float32)
        self.p = {"E": r(WORD_BUCKETS + GRAM_BUCKETS, DIM, f=0.05), "v": r(2 * HIDDEN, f=0.3), "o": r(2 * HIDDEN, f=0.3), "q": np.full(1, -1.0, np.float32)}
        for s in "fb":
            self.p |= {f"W{s}": r(DIM, 3 * HIDDEN, f=0.4), f"c{s}": np.zeros(3 * HIDDEN, np.float32), f"U{s}": r(HIDDEN, 3 * HIDDEN, f=0.25), f"d{s}": np.zeros(HIDDEN, np.float32)}

    def word_vectors(self, ids: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(mean embedding of each word, number of its features)."""
        size = np.bincount(own, minlength=n)
        at = np.cumsum(size) - size
        return np.add.reduceat(self.p["E"][ids], at, axis=0) / size[:, None].astype(np.float32), size

    def run(self, gx: np.ndarray, mask: np.ndarray | None, s: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over steps (T, B, 3H)."""
        H, U, d = HIDDEN, self.p[f"U{s}"], self.p[f"d{s}"]
        steps, n = gx.shape[:2]
        out = np.empty((steps, n, H), np.float32)
        h = np.zeros((n, H), np.float32)
        saved: list = [None] * steps
        for t in range(steps) if s == "f" else range(steps - 1, -1, -1):
            hu = h @ U
            zr = sigmoid(gx[t, :, : 2 * H] + hu[:, : 2 * H])
            z, r, hn = zr[:, :H], zr[:, H:], hu[:, 2 * H :] + d
            m = np.tanh(gx[t, :, 2 * H :] + r * hn)
            new = m + z * (h - m)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                saved[t] = (h, z, r, hn, m)
            h = new
            out[t] = h
        return out, saved

    def pool(self, hs: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, attention, pooled states) of states (T, B, 2H)."""
        e = hs @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        if mask is not None:
            a = a * mask
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", a, hs)
        return pooled @ self.p["o"] + self.p["q"][0], a, pooled

    def loss_and_gradients(self, ids: np.ndarray, own: np.ndarray, n_words: int, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean logistic loss of windows (index, mask: T, B) over distinct words, and its gradients."""
        H, p = HIDDEN, self.p
        x, size = self.word_vectors(ids, own, n_words)
        states, kept = {}, {}
        for s in "fb":
            gx = (x @ p[f"W{s}"] + p[f"c{s}"])[index]
            states[s], kept[s] = self.run(gx, mask, s, True)
        hs = np.concatenate([states["f"], states["b"]], axis=2)
        logit, a, pooled = self.pool(hs, mask)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dl, "q": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["o"]
        da = np.einsum("bh,tbh->tb", dp, hs)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, hs)
        dhs = a[:, :, None] * dp + de[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        steps = len(index)
        for s, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            U = p[f"U{s}"]
            dU, dd = np.zeros_like(U), np.zeros(H, np.float32)
            dgx = np.zeros((steps, len(y), 3 * H), np.float32)
            back = np.zeros((len(y), H), np.float32)
            for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
                h, z, r, hn, m = kept[s][t]
                dh = dhs[t, :, part] + back
                on = mask[t][:, None]
                live = np.where(on, dh, 0)
                dm = live * (1 - z) * (1 - m * m)
                dz = live * (h - m) * z * (1 - z)
                dr = dm * hn * r * (1 - r)
                du = np.concatenate([dz, dr, dm * r], axis=1)
                dU += h.T @ du
                dd += (dm * r).sum(axis=0)
                dgx[t] = np.concatenate([dz, dr, dm], axis=1)
                back = np.where(on, live * z, dh) + du @ U.T
            flat = np.zeros((n_words, 3 * H), np.float32)
            np.add.at(flat, index.ravel(), dgx.reshape(-1, 3 * H))
            g[f"U{s}"], g[f"d{s}"] = dU, dd
            g[f"W{s}"], g[f"c{s}"] = x.T @ flat, flat.sum(axis=0)
            dx += flat @ p[f"W{s}"].T
        each = (dx / size[:, None])[own]
        g["E"] = np.stack([np.bincount(ids, weights=each[:, k], minlength=len(p["E"])) for k in range(DIM)], axis=1).astype(np.float32)
        return loss, g

    def gate_inputs(self, ids: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """Input parts of all gates of both directions for each word: (n, 6H)."""
        x, _ = self.word_vectors(ids, own, n)
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def window_logits(self, table: np.ndarray, rows: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Logits of windows given as rows (T, B) of a gate-input table."""
        gx = table[rows]
        f, _ = self.run(gx[:, :, : 3 * HIDDEN], mask, "f", False)
        b, _ = self.run(gx[:, :, 3 * HIDDEN :], mask, "b", False)
        return self.pool(np.concatenate([f, b], axis=2), mask)[0]


def text_logits(net: Net, table: np.ndarray, row: np.ndarray, counts: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(highest window logit of each text, and of all windows: text, first word, logit); row: table row of every word, texts in order."""
    base = np.cumsum(counts) - counts
    doc, first = windows(counts)
    some = counts[doc] > 0
    doc, first = doc[some], first[some]
    logit = np.empty(len(doc), np.float32)
    short = counts[doc] < WINDOW
    step = np.arange(WINDOW)[:, None]
    for group in (np.flatnonzero(~short), np.flatnonzero(short)):
        for a in range(0, len(group), block):
            w = group[a : a + block]
            left = counts[doc[w]] - first[w]
            mask = step < left if short[w[0]] else None
            at = base[doc[w]] + first[w] + (np.minimum(step, left - 1) if mask is not None else step)
            logit[w] = net.window_logits(table, row[at], mask)
    best = np.full(len(counts), -np.inf)
    np.maximum.at(best, doc, logit)
    best = np.where(counts > 0, best, float(net.p["q"][0]))
    return best, doc, first, logit


def gate_table(net: Net, ids: np.ndarray, starts: np.ndarray, block: int = 20_000) -> np.ndarray:
    """Gate inputs of all words, whose features are ids[starts[w]:starts[w + 1]]."""
    parts = []
    for a in range(0, len(starts) - 1, block):
        cut = starts[a : a + block + 1]
        own = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        parts.append(net.gate_inputs(ids[cut[0] : cut[-1]], own, len(cut) - 1))
    return np.concatenate(parts)


def fit_texts(texts: list[str], y: np.ndarray, rate: float, epochs: int = EPOCHS, seed: int = 1) -> dict:
    """Train on labelled texts; rate: the share of toxic texts among all labels.  Returns the net and its calibration."""
    rng = np.random.default_rng(seed)
    net = Net(seed)
    if len(set(y.tolist())) < 2:
        return {"net": net, "scale": 0.0, "shift": float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))}
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order].astype(np.float32)
    # words as numbers, chunk by chunk: only numbers and the distinct words' features stay
    memo, words, sizes, feature_parts, size_parts = V.Memo(1 << 60), [], [], [], []
    for _, _, data, off in V.chunks(V.binary(pa.array(texts, pa.string()))):
        t = Text(data, off)
        sizes.append(np.bincount(t.row, minlength=len(off) - 1))
        uniq, first, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
        at = memo.find(uniq)
        new = np.flatnonzero(at < 0)
        if len(new):
            f, w = features(t, first[new])
            feature_parts.append(f.astype(np.int32))
            size_parts.append(np.bincount(w, minlength=len(new)))
            at[new] = memo.add(uniq[new])
        words.append(at[inverse].astype(np.int32))
    word, counts = np.concatenate(words), np.concatenate(sizes)
    if not memo.size:
        return {"net": net, "scale": 0.0, "shift": float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))}
    ids, starts = np.concatenate(feature_parts), np.append(0, np.cumsum(np.concatenate(size_parts)))
    del feature_parts, size_parts, words
    base = np.cumsum(counts) - counts
    aside = np.arange(len(texts)) % 5 == 4
    # log odds of each feature by the texts that have it
    n_features = len(net.p["E"])
    seen = [np.zeros(n_features), np.zeros(n_features)]
    for k in np.flatnonzero(~aside):
        w = np.unique(word[base[k] : base[k] + counts[k]])
        f = np.unique(ids[V.ragged(starts[w], starts[w + 1] - starts[w])])
        seen[int(y[k])][f] += 1
    n1, n0 = max(1.0, y[~aside].sum()), max(1.0, (1 - y[~aside]).sum())
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    trust = np.minimum(1.0, (seen[0] + seen[1]) / 8)
    net.p["E"][:, 0] += (np.clip(odds, -4, 4) * trust * 0.5).astype(np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    train = np.flatnonzero(~aside & (counts > 0))
    for epoch in range(epochs):
        rate_now = 0.012 * (0.5 ** (epoch / 3))
        if epoch == 0:  # before the net can tell: the window with the highest sum of odds
            x = np.add.reduceat(net.p["E"][ids, 0], starts[:-1]) / np.maximum(1, np.diff(starts)) if len(ids) else np.zeros(0)
            total = np.append(0, np.cumsum(np.maximum(x[word], 0)))
            doc, at = windows(counts)
            left = np.minimum(counts[doc] - at, WINDOW)
            score = total[base[doc] + at + left] - total[base[doc] + at]
        else:
            _, doc, at, score = text_logits(net, gate_table(net, ids, starts), word, counts)
        order = np.lexsort((score, doc))
        last = np.append(np.flatnonzero(doc[order][1:] != doc[order][:-1]), len(order) - 1)
        best = order[last]
        best_of = np.full(len(texts), -1)
        best_of[doc[best]] = best
        span = np.searchsorted(doc, np.arange(len(texts) + 1))
        picked = []
        for k in train:
            picked.append(best_of[k])
            if y[k] == 0:
                picked.append(rng.integers(span[k], span[k + 1]))
        picked = rng.permutation(np.array(picked))
        for a in range(0, len(picked), BATCH):
            w = picked[a : a + BATCH]
            left = counts[doc[w]] - at[w]
            pos = np.arange(WINDOW)[:, None]
            mask = pos < left
            index = word[base[doc[w]] + at[w] + np.minimum(pos, left - 1)]
            local, index = np.unique(index, return_inverse=True)
            index = index.reshape(WINDOW, len(w))
            size = starts[local + 1] - starts[local]
            f = ids[V.ragged(starts[local], size)]
            _, g = net.loss_and_gradients(f, np.repeat(np.arange(len(local)), size), len(local), index, mask, y[doc[w]])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 2.0 / (norm + 1e-9))
                m, s = moments[k]
                m *= 0.9
                m += 0.1 * v
                s *= 0.99
                s += 0.01 * v * v
                net.p[k] -= (rate_now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    best, *_ = text_logits(net, gate_table(net, ids, starts), word, counts)
    # calibration on the texts set aside, weighted to the label rate
    use = aside if len(set(y[aside].tolist())) == 2 else np.ones(len(y), bool)
    z, label = best[use], y[use]
    share = label.mean()
    weight = np.where(label == 1, rate / share, (1 - rate) / (1 - share))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(theta[0] * z + theta[1])
        grad = np.array([(weight * (q - label) * z).sum() + 0.1 * (theta[0] - 1), (weight * (q - label)).sum()])
        curve = weight * q * (1 - q)
        hess = np.array([[(curve * z * z).sum() + 0.1, (curve * z).sum()], [(curve * z).sum(), curve.sum() + 1e-3]])
        theta = theta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return {"net": net, "scale": float(max(theta[0], 0.05)), "shift": float(theta[1])}


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> dict:
    """The model, from the rows of ``documents`` that ``labels`` marks (one label per id: the largest)."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = one.join(documents.select(id_col).distinct(), id_col, "left_semi")
    rate = known.agg(F.avg("y")).first()[0]
    hashed = F.xxhash64(F.col(id_col), F.lit(5))
    sample = known.where("y = 1").orderBy(hashed).limit(toxic_docs).union(known.where("y = 0").orderBy(hashed).limit(clean_docs))
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample), id_col)
    got = rows.groupBy(id_col, "y").agg(F.max("t").alias("t")).orderBy(id_col).collect()  # at most toxic_docs + clean_docs texts
    return fit_texts([r.t or "" for r in got], np.array([r.y for r in got], np.int64), float(rate or 0.0))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_windows) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size
    key = f"{id(model)}-{np.random.default_rng().integers(1 << 60)}"
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        net: Net = m["net"]
        if key not in _tables:
            _tables.clear()
            _tables[key] = (V.Memo(CACHE), np.zeros((0, 6 * HIDDEN), np.float32))
        for b in V.trimmed(batches, "toxicity"):
            scores, sizes = [], []
            for r0, r1, data, off in V.chunks(V.binary(b.column(1)), V.CHUNK_BYTES):
                t = Text(data, off)
                counts = np.bincount(t.row, minlength=r1 - r0)
                memo, table = _tables[key]
                if memo.size > memo.limit:
                    memo.clear()
                    table = table[:0]
                row = np.zeros(0, np.int64)
                if len(t.hash):
                    uniq, first, inverse = np.unique(t.hash, return_index=True, return_inverse=True)
                    at = memo.find(uniq)
                    new = at < 0
                    if new.any():
                        ids, own = features(t, first[new])
                        table = np.concatenate([table, net.gate_inputs(ids, own, int(new.sum()))])
                        at[new] = memo.add(uniq[new])
                    row = at[inverse]
                _tables[key] = (memo, table)
                best, doc, *_ = text_logits(net, table, row, counts)
                scores.append(sigmoid(m["scale"] * best + m["shift"]))
                sizes.append(np.bincount(doc, minlength=r1 - r0))
            if scores:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores), pa.float64()), pa.array(np.concatenate(sizes).astype(np.int64))], names=["id", "score", "n_windows"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double, n_windows long")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs, labels = scratch.load(spark, sf_dir, "documents"), scratch.load(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
