"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of WINDOW bytes, forward and backward, and labels every byte
position with a distribution over the learned languages; a document's probabilities are the mean over all its
positions. It is trained in numpy by backpropagation through time on a bounded sample of labelled rows: at most
SAMPLE_PER_LANG documents of each language, first by a hash of their identifier, of which all bytes are in the
windows that batches are drawn from. Gates are piecewise linear
(clipped, with the gradient of that) so that inference is a few vector operations a byte: windows of many documents
advance together.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text when no row can
be learned from; ties go to the language first by code point; an empty table gives no rows; rows that repeat are
each predicted; rows without an identifier are not learned from, and of rows that repeat identifier and language the
first text is; texts of any length are read whole, in windows; columns other than doc_id, text and (for learning) lang
are not read; columns of `docs` named lang_pred or score are replaced, all others stay untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import attach, held_out, sample_by_class, session

HIDDEN, WINDOW, LANES = 6, 128, 2048
SAMPLE_PER_LANG = 300
PAD = 256
UNDETERMINED = "und"


class ByteGRU:
    """Parameters by name: per direction E (3H x 257, input and bias), U (3H x H); O (C x 2H), b (C)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.p = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.15, (3 * hidden, 257)).astype(np.float32)
            self.p["E" + d][: 2 * hidden] += 0.5
            self.p["U" + d] = (rng.normal(0, 0.4, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.p["O"] = rng.normal(0, 0.3, (classes, 2 * hidden)).astype(np.float32)
        self.p["b"] = np.zeros((classes, 1), np.float32)
        self._hold()

    def _hold(self) -> None:
        """At PAD the update gate is 1: the state passes through."""
        for d in "fb":
            self.p["E" + d][: self.hidden, PAD] = 1e3
            self.p["E" + d][self.hidden :, PAD] = 0

    def run(self, x: np.ndarray, d: str):
        """States (T x H x N) of symbols x (T x N) in direction d, with what backpropagation needs."""
        e, u, h, n = self.p["E" + d], self.p["U" + d], self.hidden, x.shape[1]
        state, out, tape = np.zeros((h, n), np.float32), np.empty((len(x), h, n), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, g = e[:, x[t]], u @ state
            zr = a[: 2 * h] + g[: 2 * h]
            gate = np.clip(zr, 0, 1)
            pre = a[2 * h :] + gate[h:] * g[2 * h :]
            cand = np.clip(pre, -1, 1)
            new = cand + gate[:h] * (state - cand)
            tape.append((t, state, g[2 * h :], zr, gate, pre, cand))
            out[t] = state = new
        return out, tape

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over positions (pads apart) and the gradient of every parameter."""
        h = self.hidden
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self.run(x, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
        logits = np.einsum("ck,tkn->tcn", self.p["O"], both) + self.p["b"]
        logits -= logits.max(axis=1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(axis=1, keepdims=True)
        real = (x != PAD).astype(np.float32)
        total = max(1.0, real.sum())
        hot = np.arange(self.classes)[:, None] == y
        loss = -(np.log(q + 1e-9) * hot * real[:, None]).sum() / total
        dl = (q - hot) * real[:, None] / total
        grad["O"], grad["b"] = np.einsum("tcn,tkn->ck", dl, both), dl.sum(axis=(0, 2))[:, None]
        dboth = np.einsum("ck,tcn->tkn", self.p["O"], dl)
        slope = lambda v, lo, hi: ((v > lo) & (v < hi)).astype(np.float32)
        for d in "fb":
            dh, part = np.zeros_like(dboth[0, :h]), dboth[:, :h] if d == "f" else dboth[:, h:]
            for t, state, gn, zr, gate, pre, cand in reversed(runs[d][1]):
                dh = dh + part[t]
                z, r = gate[:h], gate[h:]
                dcand = dh * (1 - z) * slope(pre, -1, 1)
                dz, dr = dh * (state - cand), dcand * gn
                dzr = np.concatenate([dz, dr]) * slope(zr, 0, 1)
                dg = np.concatenate([dzr, dcand * r])
                da = np.concatenate([dzr, dcand]).T
                np.add.at(grad["E" + d].T, x[t], da)
                grad["U" + d] += dg @ state.T
                dh = dh * z + self.p["U" + d].T @ dg
        return float(loss), grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over random batches of windows x (N x T) with labels y."""
        rng, m, v, loss = np.random.default_rng(seed), {}, {}, 0.0
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grad = self.step(np.ascontiguousarray(x[pick].T), y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * min(1, i / 20) * (1 - 0.9 * i / steps)
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            self._hold()
        return loss

    def label(self, x: np.ndarray):
        """Distributions (T x C x N) of every position of symbols x (T x N)."""
        h, n, c = self.hidden, x.shape[1], self.classes
        out, zero, one = np.empty((len(x), c, n), np.float32), np.float32(0), np.float32(1)
        for d in "fb":
            e, u, o = self.p["E" + d], self.p["U" + d], np.ascontiguousarray(self.p["O"][:, :h] if d == "f" else self.p["O"][:, h:])
            state, g, a, gate, cand = (np.zeros((k, n), np.float32) for k in (h, 3 * h, 3 * h, 2 * h, h))
            for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                np.take(e, x[t], axis=1, out=a, mode="clip")
                np.matmul(u, state, out=g)
                np.add(a[: 2 * h], g[: 2 * h], out=gate)
                np.clip(gate, zero, one, out=gate)
                np.multiply(gate[h:], g[2 * h :], out=cand)
                cand += a[2 * h :]
                np.clip(cand, -one, one, out=cand)
                state -= cand
                state *= gate[:h]
                state += cand
                if d == "f":
                    np.matmul(o, state, out=out[t])
                else:
                    out[t] += o @ state
        out += self.p["b"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out


def windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows (N x width, padded) of texts data[offsets[i]:offsets[i+1]], and the text of each."""
    lengths = np.diff(offsets)
    count = -(-lengths // width)
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[:-1][owner] + nth * width)[:, None] + np.arange(width)
    inside = at < offsets[1:][owner][:, None]
    x = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, PAD).astype(np.int16)
    return x, owner


class Tagger:
    """A trained network with its language names."""

    def __init__(self, langs: list[str], net: ByteGRU | None):
        self.langs, self.net = langs, net

    def positions(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        b = np.frombuffer(text.encode(), np.uint8)
        x, _ = windows(b, np.array([0, len(b)]))
        q = self.net.label(np.ascontiguousarray(x.T)).argmax(axis=1).T.ravel()[: len(b)] if len(b) else []
        return [self.langs[i] for i in q]

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean distribution (texts x languages) over all positions, windows of all texts in lanes of LANES."""
        texts, sums = len(offsets) - 1, np.zeros((len(offsets) - 1, len(self.langs)))
        first = 0
        while first < texts:  # a bounded stretch of bytes at a time; a single long text is cut by windows too
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + LANES * WINDOW, "right")) - 1)
            for lo in range(int(offsets[first]), int(offsets[last]) or 1, LANES * WINDOW) if last == first + 1 else [int(offsets[first])]:
                hi = min(lo + LANES * WINDOW, int(offsets[last])) if last == first + 1 else int(offsets[last])
                x, owner = windows(data[lo:hi], np.array([0, hi - lo]) if last == first + 1 else offsets[first : last + 1] - lo)
                for k in range(0, len(x), LANES):
                    xt = np.ascontiguousarray(x[k : k + LANES].T)
                    q = self.net.label(xt)
                    q *= (xt != PAD)[:, None]
                    np.add.at(sums, first + owner[k : k + LANES], q.sum(axis=0).T)
            first = last
        return sums / np.maximum(np.diff(offsets), 1)[:, None]


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, steps: int = 260, batch: int = 192, width: int = 48, hidden: int = HIDDEN, seed: int = 0) -> Tagger:
    """Fit on rows that are not held out and have a language, at most `per_lang` documents of each."""
    known = docs.where(docs["doc_id"].isNotNull() & docs["lang"].isNotNull() & docs["text"].isNotNull() & ~held_out(docs["doc_id"]))
    picked = sample_by_class(known, "lang", per_lang).collect()
    if not picked:
        return Tagger([], None)
    rows = docs.where(docs["doc_id"].isin(sorted({r.doc_id for r in picked})) & docs["lang"].isNotNull() & docs["text"].isNotNull()).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang))
    langs = sorted({r.lang for r in rows})
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for r in rows:
        b = np.frombuffer(r.text.encode(), np.uint8)
        if len(b):
            x, _ = windows(b, np.array([0, len(b)]), width)
            xs.append(x)
            ys += [langs.index(r.lang)] * len(x)
    if not xs:
        return Tagger([], None)
    x, y = np.concatenate(xs), np.array(ys)
    share = np.bincount(y, minlength=len(langs))
    most = max(share)  # all windows of every language, the fewer ones filled up by repeats
    even = np.concatenate([np.r_[at, rng.choice(at, most - len(at))] for at in (np.flatnonzero(y == k) for k in range(len(langs)) if share[k])])
    net = ByteGRU(len(langs), hidden, seed)
    net.fit(x[even], y[even], steps, batch)
    return Tagger(langs, net)


def identify(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """All columns of `docs` with lang_pred and score (replacing columns of those names)."""
    spark = session(docs)
    shared = spark.sparkContext.broadcast(tagger)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return label_texts(shared.value, text.tolist())

    lettered = F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False))
    return attach(docs, predict(F.when(lettered, docs["text"])), ["lang_pred", "score"])


def label_texts(tagger: Tagger, texts: list) -> pd.DataFrame:
    """lang_pred and score of texts; None (null, or no letter) gives und."""
    encoded = [t.encode() if t else b"" for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in encoded])]).astype(np.int64)
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if tagger.net is not None and offsets[-1]:
        q = tagger.pooled(np.frombuffer(b"".join(encoded), np.uint8), offsets)
        best = q.argmax(axis=1)
        for i in np.flatnonzero(np.diff(offsets)):
            names[i], scores[i] = tagger.langs[best[i]], min(1.0, float(q[i, best[i]]))
    return pd.DataFrame({"lang_pred": names, "score": scores})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
