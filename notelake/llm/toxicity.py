"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy.

A word's vector is the sum of three hashed embeddings: of the word, and of its first four and five bytes, so that
an inflected form of a known stem is known too. Filters of widths 1 to 3 run over the whole text, are max-pooled, and
a logistic layer makes the score. The model is fitted on the driver on a bounded sample of labelled rows
(``max_rows`` of at most ``max_text`` characters each, up to half of them of each label, ordered by a hash of the id); it is small and sent to the executors as it is. A score
depends on the text alone. The decision threshold of each language is calibrated on the training rows and returned
beside the score; it never enters it.

Null and empty texts get the score of a text without words. Labels that are null, and rows without an id, train nothing.
With no labelled rows of both classes every score is 0. Rows with the same doc_id are scored one by one; an empty table
gives no rows. Very long texts are scored whole, in bounded memory. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, ranges
from .words import Words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 12, (1, 2, 3), 8
#: Words are runs of ASCII letters and of bytes beyond ASCII.
NO_LETTER = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
STEMS = (4, 5)
#: Words of one piece of the convolution, and texts that are looked at together.
PIECE, BATCH = 1 << 17, 250


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Three rows of the embedding table for each word, one text after the other, and the texts' numbers of words; row 0 is empty."""
    w = Words(docs, fold=True, space=NO_LETTER, prefixes=STEMS)
    row = lambda h: np.where(h == 0, 0, 1 + (h >> U64(20)) % U64(BUCKETS - 1)).astype(np.int32)
    return np.stack([row(w.hash), *map(row, w.heads)], 1), w.lens


@dataclass
class Model:
    """Weights; ``filters`` has one array (width, DIM, FILTERS) for each width."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]

    def pool(self, vectors: np.ndarray, starts: np.ndarray, ends: np.ndarray, want_argmax: bool = False):
        """Max-pooled activations of each text (and where they are); a text's words are followed by two zero rows."""
        cuts = np.stack([starts, ends], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] >= len(vectors) else cuts
        tops, places = [], []
        for f, b in zip(self.filters, self.bias):
            y = np.zeros((len(vectors), f.shape[2]), np.float32)
            for j in range(len(f)):
                y[: len(vectors) - j] += vectors[j:] @ f[j]
            top = np.maximum.reduceat(y, cuts, axis=0)[::2] + b
            tops.append(np.maximum(top, 0))
            if want_argmax:
                places.append(np.stack([s + y[s:e].argmax(0) for s, e in zip(starts, ends)]))
        return np.concatenate(tops, 1), places

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return (pooled @ self.out + self.out_bias) * self.scale[0] + self.scale[1]

    def score(self, docs: list[bytes]) -> np.ndarray:
        """Scores of whole texts, some pieces at a time; a piece of a long text overlaps the next by two words."""
        if len(docs) > BATCH:
            return np.concatenate([self.score(docs[i : i + BATCH]) for i in range(0, len(docs), BATCH)])
        if not docs:
            return np.zeros(0)
        rows, lens = features(docs)
        first = np.cumsum(lens) - lens
        pooled = np.zeros((len(docs), len(self.out)), np.float32)
        owner = np.repeat(np.arange(len(docs)), np.maximum(-(-lens // PIECE), 1))
        start = ranges(np.maximum(-(-lens // PIECE), 1)) * PIECE
        size = np.minimum(lens[owner] - start, PIECE + 2)
        at = 0
        while at < len(owner):
            to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), PIECE, side="right")) + at)
            padded, starts, ends = spread(rows, (first[owner] + start)[at:to], size[at:to])
            top, _ = self.pool(self.embed(padded), starts, ends)
            np.maximum.at(pooled, owner[at:to], top)
            at = to
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled.astype(np.float64)), -30, 30)))


def spread(rows: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rows, each of one row at least and followed by two empty ones; where they start and end."""
    room = np.maximum(size, 1)
    starts = np.cumsum(room + 2) - room - 2
    out = np.zeros((int((room + 2).sum()), 3), np.int32)
    step = ranges(size)
    out[np.repeat(starts, size) + step] = rows[np.repeat(first, size) + step]
    return out, starts, starts + room


def train(docs: list[bytes], labels: np.ndarray, langs: list[str], *, epochs: int = 4, rate: float = 0.05, seed: int = 7) -> Model:
    """Fit on three rows in four, and calibrate on the fourth, or on all if it has one class alone."""
    held = np.arange(len(docs)) % 4 == 3
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(docs), bool)
    pick = lambda xs, at: [x for x, y in zip(xs, at) if y]
    model = learn(pick(docs, ~held), labels[~held], epochs, rate, seed)
    if len(set(labels)) == 2:
        held = held if held.any() else ~held
        calibrate(model, pick(docs, held), labels[held], pick(langs, held))
    return model


def learn(docs: list[bytes], labels: np.ndarray, epochs: int, rate: float, seed: int) -> Model:
    """Fit by Adagrad; embeddings start from the log-odds of their bucket among the training texts."""
    rng = np.random.default_rng(seed)
    n_out = len(WIDTHS) * FILTERS
    model = Model(
        (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (np.abs(rng.standard_normal(n_out)) * 0.3), 0.0,
    )
    model.table[0] = 0
    if len(set(labels)) < 2:
        model.out[:], model.out_bias = 0, -30.0
        return model
    parts = [features(docs[i : i + BATCH]) for i in range(0, len(docs), BATCH)]
    all_words, lens = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    first = np.cumsum(lens) - lens
    seen = np.zeros((2, BUCKETS), np.float32)
    for a, n, y in zip(first, lens, labels):
        seen[int(y), np.unique(all_words[a : a + n])] += 1
    odds = np.log((seen[1] + 0.1) / (labels.sum() + 0.2)) - np.log((seen[0] + 0.1) / ((1 - labels).sum() + 0.2))
    # a cautious estimate: what is left of the log-odds after its own uncertainty
    odds = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)), 0)
    model.table[:, 0] = np.where(seen.sum(0) >= 3, np.clip(odds, -3, 4) / 4, 0)
    model.table[0] = 0
    for f in model.filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.7
    for b in model.bias:
        b -= 0.4
    g2: dict = {}

    def step(name, at, value, grad):
        acc = g2.setdefault(name, np.zeros_like(value))
        if at is None:
            acc += grad * grad
            value -= rate * grad / np.sqrt(acc + 1e-6)
        else:
            acc[at] += grad * grad
            value[at] -= rate * grad / np.sqrt(acc[at] + 1e-6)

    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), 32):
            batch = order[lo : lo + 32]
            all_rows, starts, ends = spread(all_words, first[batch], lens[batch])
            vec = model.embed(all_rows)
            pooled, places = model.pool(vec, starts, ends, True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))
            err = (p - labels[batch]) * weight[batch] / len(batch)
            back = err[:, None] * model.out * (pooled > 0)
            bias_grad = err.sum()
            acc = g2.setdefault("out_bias", np.zeros(1))
            acc += bias_grad**2
            model.out_bias -= rate * bias_grad / float(np.sqrt(acc[0] + 1e-6))
            step("out", None, model.out, pooled.T @ err)
            touched, flows = [], []
            for k, (f, place) in enumerate(zip(model.filters, places)):
                g = back[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                grad_f = np.zeros_like(f)
                d, q = np.nonzero(g)
                for j in range(len(f)):
                    at = place[d, q] + j
                    np.add.at(grad_f[j].T, q, g[d, q, None] * vec[at])
                    touched.append(all_rows[at].ravel())
                    flows.append(np.repeat(g[d, q, None] * f[j][:, q].T, 3, axis=0))
                step(("b", k), None, model.bias[k], g.sum(0))
                step(("f", k), None, f, grad_f)
            row, of = np.unique(np.concatenate(touched), return_inverse=True)
            grad = np.zeros((len(row), DIM), np.float32)
            np.add.at(grad, of, np.concatenate(flows))
            some = row > 0
            step("table", row[some], model.table, grad[some])
    return model


def calibrate(model: Model, docs: list[bytes], labels: np.ndarray, langs: list[str]) -> None:
    """Put the best cut of these rows' logits at a score of 0.7, and find each language's own cut."""
    z = np.log(np.maximum(p := model.score(docs), 1e-13)) - np.log(np.maximum(1 - p, 1e-13))

    def cut(z: np.ndarray, y: np.ndarray) -> float:
        """A third up the widest gap among the cuts with the fewest errors: unseen positives score lower than seen ones."""
        order = np.argsort(z)
        z, y = z[order], y[order]
        errors = np.cumsum(np.append(0, y)) + (1 - y).sum() - np.cumsum(np.append(0, 1 - y))
        lo, hi = np.append(z[0] - 2, z), np.append(z, z[-1] + 2)
        best = np.lexsort((-(hi - lo), errors))[0]
        return float((2 * lo[best] + hi[best]) / 3)

    at = cut(z, labels)
    model.scale = (1.0, float(np.log(0.7 / 0.3)) - at)
    of = np.array([x or "" for x in langs])
    for lang in sorted(set(langs) - {None}):
        y = labels[of == lang]
        shifted = z[of == lang] + model.scale[1]
        model.thresholds[lang] = 0.7 if y.min() == y.max() else float(1 / (1 + np.exp(-cut(shifted, y))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, *, max_rows: int = 6000, max_text: int = 50_000, label: str = "toxic") -> Model:
    """Train on labelled documents for which ``train_rows`` holds: at most ``max_rows``, up to half of them with label 1.

    Texts of more than ``max_text`` characters train nothing (all are scored whole), so that the driver holds a bounded sample.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).where(train_rows).distinct()
    order = F.xxhash64("doc_id")
    picked = known.where("y = 1").orderBy(order, "doc_id").limit(max_rows // 2).union(known.where("y = 0").orderBy(order, "doc_id").limit(max_rows // 2))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), lang.alias("lang")).where(F.char_length("text") <= max_text).join(F.broadcast(picked), "doc_id").orderBy(order, "doc_id", "text").limit(max_rows)
    got = [(r.text.encode(), r.y, r.lang) for r in rows.toLocalIterator()]
    return train([g[0] for g in got], np.array([g[1] for g in got], np.float64), [g[2] for g in got])


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows of ``docs`` with column ``out`` added (or replaced), in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def udf(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score([(t or "").encode() for t in column]))

    return docs.withColumn(out, udf(F.col(text_col).cast("string")))
