"""Quality classifier: a generalised additive model with pairwise interactions.

Every document becomes ``len(FEATURES)`` numbers taken from its whole text.  Boosting goes
round the features in turn; each step fits a shallow tree (a few leaves over the bins of one
feature, or of a pair) to the current residual and adds a share of it to that feature's lookup
table.  A score is the sum of table entries, looked up for whole batches, through a logistic.

Only labels of documents outside the held-out fifth are learned from, and at most ``SAMPLE``
of them (by the hash of doc_id): this is the one bounded sample here.  Features are computed
for all documents, in one pass that nothing shuffles; only numbers meet the labels.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import chunks, prepare, runs, words

SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, LEAVES = 20_000, 32, 8, 6, 150, 0.1, 4
FEATURES = [
    "log_words", "word_length", "upper", "digit", "symbol", "stop", "wide", "line_words", "long_words", "short_words",
    "ends_symbol", "repeated_words", "repeated_runs", "top_word", "repeated_lines", "starts_upper",
]

_CLASS = np.zeros((5, 256), np.int32)
for _c in range(256):
    _CLASS[0, _c] = 65 <= _c <= 90
    _CLASS[1, _c] = 48 <= _c <= 57
    _CLASS[2, _c] = chr(_c) in "#$%&*+/<=>@\\^_`{|}~!"
    _CLASS[3, _c] = chr(_c) in ".,;:?'\"()-"
    _CLASS[4, _c] = _c >= 128


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; zeros where there is no word."""
    w = words(texts, lower=False)
    count = np.diff(w.off)
    out = np.zeros((len(count), len(FEATURES)))
    some = np.flatnonzero(count)
    if not len(some):
        return out
    a, b, n = w.off[some], w.off[some + 1], count[some].astype(float)
    size = (w.end - w.start).astype(float)
    chars = np.add.reduceat(size, a)
    by_word = lambda x: np.add.reduceat(x.astype(float), a) / n
    out[some, 0] = np.log(n)
    out[some, 1] = chars / n
    lo, hi = w.start[a], w.end[b - 1]
    for k in range(5):
        total = np.concatenate([[0], np.cumsum(_CLASS[k][w.buf])])
        out[some, 2 + k] = (total[hi] - total[lo]) / chars
    breaks = np.concatenate([[0], np.cumsum(w.buf == 10)])
    line = breaks[w.start]
    fresh = np.ones(len(line), bool)
    fresh[1:] = line[1:] != line[:-1]
    fresh[a] = True
    lines = np.add.reduceat(fresh.astype(float), a)
    out[some, 7] = np.log(n / lines)
    out[some, 8], out[some, 9] = by_word(size > 12), by_word(size <= 3)
    out[some, 10] = by_word(_CLASS[2][w.buf[w.end - 1]] > 0)
    first, second = w.buf[w.start], w.buf[np.minimum(w.start + 1, len(w.buf) - 1)]
    out[some, 15] = by_word((_CLASS[0][first] > 0) | ((first == 195) & (second < 160)))
    row = np.flatnonzero(fresh)
    sums = np.add.reduceat(w.h * (np.arange(len(w.h), dtype=np.uint64) - row[np.cumsum(fresh) - 1].astype(np.uint64) + np.uint64(1)), row)
    three = runs(w.h, 3)
    at = np.searchsorted(row, np.append(a, len(w.h)))
    for i, (x, y, d) in enumerate(zip(a.tolist(), b.tolist(), some.tolist())):
        _, c = np.unique(w.h[x:y], return_counts=True)
        # repeats among the words that are not the commonest say more than those of all
        out[d, 11], out[d, 13] = 1 - len(c) / (y - x), c.max() / (y - x)
        if y - x > 3:
            out[d, 12] = 1 - len(np.unique(three[x : y - 2])) / (y - x - 2)
        m = at[i + 1] - at[i]
        if m > 1:
            out[d, 14] = 1 - len(np.unique(sums[at[i] : at[i + 1]])) / m
    return out


class Model(NamedTuple):
    """Bin edges of each feature, a table for each, pairs of features with coarse edges, a table for each."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Steps of a shallow tree over ordered bins: best splits one after another."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = value(a, m) + value(m, b) - value(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), a + 1 + k), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the pairs with most left to explain."""
    n, d = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    cut = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    edges, coarse = cut(BINS), cut(PAIR_BINS)
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not n or not 0 < y.sum() < n:
        return Model(base, edges, tables, [], coarse, [])
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    z = np.full(n, base)

    def step(idx, table, shape):
        nonlocal z
        p = 1 / (1 + np.exp(-z))
        m = int(np.prod(shape))
        g, h = np.bincount(idx, y - p, m), np.bincount(idx, p * (1 - p), m)
        if len(shape) == 1:
            t = _tree(g, h, LEAVES)
        else:  # a tree of two levels: one split of either feature after the other
            g2, h2 = g.reshape(shape), h.reshape(shape)
            rows = _tree(g2.sum(axis=1), h2.sum(axis=1), 2)
            t = np.zeros(shape)
            for v in np.unique(rows):
                on = rows == v
                t[on] = _tree(g2[on].sum(axis=0), h2[on].sum(axis=0), 2)
            t = t.ravel()
        table += RATE * t.reshape(table.shape)
        z = z + RATE * t[idx]

    for _ in range(ROUNDS):
        for j in range(d):
            step(bins[j], tables[j], tables[j].shape)
    p = 1 / (1 + np.exp(-z))
    gain = []
    for i in range(d):
        for j in range(i + 1, d):
            idx = rough[i] * (len(coarse[j]) + 1) + rough[j]
            g, h = np.bincount(idx, y - p), np.bincount(idx, p * (1 - p))
            gain.append((float((g * g / (h + 1)).sum()), i, j))
    pairs = [(i, j) for _, i, j in sorted(gain, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in pairs]
    for _ in range(ROUNDS // 3):
        for (i, j), t in zip(pairs, pair_tables):
            step(rough[i] * t.shape[1] + rough[j], t, t.shape)
    return Model(base, edges, tables, pairs, coarse, pair_tables)


def _features(batches):
    for b in chunks(batches):
        f = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))], names=["quality", "features"])


def _score(model: Model):
    def run(batches):
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(b.column("text"))))], names=["doc_id", "score"])

    return run


def _keep(model: Model, least: float):
    def run(batches):
        for b in chunks(batches):
            yield b.filter(pa.array(model.score(features(b.column("text"))) >= least))

    return run


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels.quality from at most SAMPLE labelled documents outside the held-out part."""
    n = F.col
    y = labels.select(n("doc_id").cast("long").alias("doc_id"), n("quality").cast("double").alias("quality"))
    y = y.where(n("quality").isNotNull() & n("doc_id").isNotNull() & ~held_out(n("doc_id")))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # at most SAMPLE pairs of numbers: safe to broadcast
    texts = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").select("quality", "text")
    known = texts.mapInArrow(_features, "quality double, features array<double>").collect()
    known.sort()
    x = np.array([r.features for r in known]).reshape(len(known), len(FEATURES))
    return fit(x, np.array([float(r.quality > 0) for r in known]))


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= least) of every document.

    Null or empty text has the features zero and a score like any other.  Labels that are null
    or without a document are left out; without labels of both kinds every score is the share
    of label 1 (0.5 without any).  Repeated rows give a row each.
    """
    prepare(docs.sparkSession)
    n = F.col
    texts = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text"))
    out = texts.mapInArrow(_score(learn(docs, labels)), "doc_id long, score double")
    return out.select("doc_id", held_out(n("doc_id")).alias("held_out"), "score", (n("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that quality_scores predicts as 1."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_keep(learn(docs, labels), least), docs.schema)
