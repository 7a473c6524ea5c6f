"""Exact top-k inner products over a pivot-distance index.

Vectors become points whose distance to a query falls as their inner product rises: with M
the largest norm, x gains the coordinate sqrt(M^2 - |x|^2), a query gains 0, and
d^2 = |q|^2 + M^2 - 2 q.x.  Every point is keyed by its nearest pivot and its distance to it;
in that order the points are cut into blocks, annuli of at most ``BLOCK`` points around one
pivot.  For a query at distance t from the pivot, no point of an annulus [lo, hi] is nearer
than max(lo - t, t - hi), so annuli are expanded in the order of that bound and a query stops
when the bound is beyond its k-th best.  Scores start from those in the pivots' sample.

Scale: the pivots come from a bounded sample; everything else covers all rows.  Queries and
annuli meet in groups of at most ``GROUP`` queries and a share of the annuli; neither side is
broadcast or held whole, and a group passes on at most k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import dealt, groups, prepare, settle, width
from .vectors import NUM, matrix, packed, sound, unpacked, widened

SAMPLE, PIVOTS, BLOCK, GROUP, SHARE = 4096, 64, 512, 16384, 65536
#: Squared norms beyond this, and components beyond LARGEST, are outside the index's geometry.
HUGE, LARGEST = 2.0**900, 1e300


def _integers(scale: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(scale * matrix(b.column("v"))), -LARGEST, LARGEST) + 0.0
                    norm2 = (v * v).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("asks"), packed(v), pa.array(norm2)], names=["vec_id", "asks", "v", "norm2"])

    return run


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Far apart from each other: each next one is farthest from those before."""
    at = [0] if len(sample) else []
    d = ((sample - sample[:1]) ** 2).sum(axis=1)
    while len(at) < min(PIVOTS, len(sample)) and d.max() > 0:
        at.append(int(d.argmax()))
        d = np.minimum(d, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


def _lift(v: np.ndarray, norm2: np.ndarray, most: float, dim: int) -> np.ndarray:
    return np.column_stack([widened(v, dim), np.sqrt(np.maximum(most - norm2, 0))])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _place(pivots: np.ndarray, most: float, dim: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                n2, v = b.column("norm2").to_numpy(), unpacked(b.column("v"))
                far = n2 > HUGE
                d = _apart(_lift(np.where(far[:, None], 0.0, v), np.where(far, 0.0, n2), most, dim), pivots)
                near = d.argmin(axis=1)
                d[far], near = 0.0, np.where(far, -1, near)  # annuli of their own, which every query expands
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "asks", "v", "norm2")), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "asks", "v", "norm2", "pivot", "r"])

    return run


def _blocks(cut: int, name: str):
    """Sorted points -> blocks of at most ``cut`` points of one pivot."""

    def run(batches):
        for t in groups(batches, ["pivot"]):
            for at in range(0, t.num_rows, cut):
                x = t.slice(at, cut)
                r = x.column("r").to_numpy()
                cols = {"kind": [name], "pivot": [x.column("pivot")[0].as_py()], "lo": [float(r.min())], "hi": [float(r.max())], "first": [x.column("vec_id")[0].as_py()], "ids": [x.column("vec_id").to_numpy().tobytes()], "vecs": [unpacked(x.column("v")).tobytes()]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    return run


def _product(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integers as longs (held at the limits of a long beyond them)."""
    if q.size and v.size and np.abs(q).max() * np.abs(v).max() * q.shape[1] >= 2**53:
        big = np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(v).T
        return np.clip(big, -(2**63) + 1, 2**63 - 1).astype(np.int64)  # the least long means none
    return (q @ v.T).astype(np.int64)


def _search(k: int, pivots: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, most: float, dim: int):
    def run(batches):
        for t in groups(batches, ["g", "s"]):
            kind = np.array(t.column("kind").to_pylist())
            load = lambda i: (np.frombuffer(t.column("ids")[i].as_buffer(), np.int64), np.frombuffer(t.column("vecs")[i].as_buffer(), np.float64))
            asks, holds = np.flatnonzero(kind == "q"), np.flatnonzero(kind == "v")
            if not len(asks) or not len(holds):
                continue
            loaded = [load(int(i)) for i in asks]
            qid = np.concatenate([i for i, _ in loaded])
            q = np.concatenate([widened(v.reshape(len(i), -1), dim) for i, v in loaded])
            with np.errstate(over="ignore"):
                n2 = (q * q).sum(axis=1)
            huge = n2 > HUGE
            n2 = np.where(huge, 0.0, n2)
            far = _apart(np.column_stack([np.where(huge[:, None], 0.0, q), np.zeros(len(q))]), pivots)
            # what the sample alone guarantees
            least = np.full(len(q), np.iinfo(np.int64).min)
            if len(sample) > k:
                s = _product(q, sample)
                s[qid[:, None] == sample_ids[None, :]] = np.iinfo(np.int64).min
                least = np.partition(s, -k, axis=1)[:, -k]
            piv, lo, hi = (t.column(c).to_numpy()[holds] for c in ("pivot", "lo", "hi"))
            tt = far[:, piv]
            bound = np.maximum(np.maximum(lo[None, :] - tt, tt - hi[None, :]), 0)
            top = (n2[:, None] + most - bound * bound) / 2
            top += 1e-9 * (n2[:, None] + most) + 1e-6  # rounding
            top[huge], top[:, piv < 0] = np.inf, np.inf
            best_s, best_i = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
            for j in np.argsort(-top.max(axis=0), kind="stable").tolist():
                on = np.flatnonzero(top[:, j] >= least)
                if not len(on):
                    if top[:, j:].size and (top.max(axis=0)[j] < least.min()):
                        break
                    continue
                ids, v = load(int(holds[j]))
                score = _product(q[on], widened(v.reshape(len(ids), -1), dim))
                every = np.broadcast_to(ids, score.shape)
                off = (ids[None, :] == qid[on][:, None])
                pad = lambda m, fill: np.concatenate([m, np.full((len(q), max(0, k - m.shape[1])), fill, np.int64)], axis=1)
                best_s, best_i = pad(best_s, np.iinfo(np.int64).min), pad(best_i, -1)
                s = np.concatenate([best_s[on], score], axis=1)
                i = np.concatenate([best_i[on], every], axis=1)
                out = np.concatenate([best_s[on] == np.iinfo(np.int64).min, off], axis=1)
                s = np.where(out, np.iinfo(np.int64).min, s)
                order = np.lexsort([i, -s.astype(np.float64), out], axis=1)[:, :k] if np.abs(s[~out]).max(initial=0) < 2**53 else np.array([sorted(range(s.shape[1]), key=lambda c: (out[r, c], -int(s[r, c]), int(i[r, c])))[:k] for r in range(len(s))]).reshape(len(s), -1)
                best_s[on], best_i[on] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                full = best_s[on][:, -1]
                least[on] = np.maximum(least[on], full)
            if best_s.shape[1]:
                keep = (best_s > np.iinfo(np.int64).min) & (best_s >= least[:, None])
                rows = np.repeat(qid, keep.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best_i[keep]), pa.array(best_s[keep])], names=["query_id", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, asks: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of every query
    (rows where ``asks`` holds) with all other rows; ties go to the smaller vec_id.

    Components become floor(scale * x).  Vectors that are null or hold a null or non-finite
    component, and rows without vec_id, take no part.  Shorter vectors count as filled up with
    zeros.  Rows that repeat a vec_id are candidates each, but never of their own vec_id.
    Components beyond 1e300 are held there, and scores at the limits of a long; such vectors
    are compared without the index's bounds.
    """
    spark, n = prepare(vectors.sparkSession), F.col
    v = vectors.where(sound("embedding") & n("vec_id").isNotNull()).select(n("vec_id").cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"), n("embedding").cast(NUM).alias("v"))
    v = settle(v.mapInArrow(_integers(scale), "vec_id long, asks boolean, v binary, norm2 double"), "integers")
    count = v.agg(F.count("*").alias("n"), F.sum(n("asks").cast("long")).alias("q"), F.max(F.when(n("norm2") <= HUGE, n("norm2"))).alias("most"), (F.max(F.octet_length("v")) / 8).cast("int").alias("dim")).first()
    most, dim = float(count.most or 0), int(count.dim or 0)
    picked = v.where(n("norm2") <= HUGE).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.array([np.pad(np.frombuffer(r.v, np.float64), (0, dim - len(r.v) // 8)) for r in picked]).reshape(len(picked), dim)
    ids = np.array([r.vec_id for r in picked], np.int64)
    if len(set(ids.tolist())) < len(ids):  # of rows that repeat an id one speaks for the sample
        keep = np.unique(ids, return_index=True)[1]
        sample, ids = sample[keep], ids[keep]
    pivots = _pivots(_lift(sample, (sample * sample).sum(axis=1), most, dim)) if len(sample) else np.zeros((1, dim + 1))
    placed = settle(v.mapInArrow(_place(pivots, most, dim), "vec_id long, asks boolean, v binary, norm2 double, pivot int, r double"), "placed")
    shape = "kind string, pivot long, lo double, hi double, first long, ids binary, vecs binary"
    order = ["pivot", "r", "vec_id"]
    ranged = lambda d: d.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)
    holds = ranged(placed).mapInArrow(_blocks(BLOCK, "v"), shape)
    wants = ranged(placed.where("asks")).mapInArrow(_blocks(BLOCK, "q"), shape)
    g, s = max(1, -(-int(count.q or 0) // GROUP)), max(width(spark), -(-count.n // SHARE))
    spot = lambda m: F.pmod(F.xxhash64("pivot", "lo", "hi", "first"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    met = wants.withColumn("g", spot(g)).withColumn("s", every(s)).unionByName(holds.withColumn("s", spot(s)).withColumn("g", every(g)))
    found = dealt(met, "g", "s").mapInArrow(_search(k, pivots, sample, ids, most, dim), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(n("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(n("rank") <= k).select("query_id", "rank", "vec_id", "score")
