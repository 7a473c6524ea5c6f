"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

Exact copies are one row from the start.  Centres are fitted on a bounded sample (``SAMPLE``
vectors, chosen by the hash of their id); every vector is then put into its ``PROBES`` nearest
cells.  Two vectors are compared wherever they share a cell, and counted in the first cell
they share.  Cells are cut into blocks, and pairs of blocks are the unit of work, so a cell
that holds a third of all rows is spread like any other; a unit passes on one row a vector
(its number of links and one neighbour), never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _roots, components, dealt, groups, prepare, settle
from .vectors import NUM, matrix, packed, sound, unpacked, widened

SAMPLE, ROUNDS, PROBES, BLOCK, CELL = 8192, 12, 6, 256, 128


def _units(batches):
    for b in batches:
        if b.num_rows:
            m = matrix(b.column("v"))
            top = np.abs(m).max(axis=1, keepdims=True, initial=0)
            some = top[:, 0] > 0
            m = m[some] / top[some]  # scaled first: squares neither overflow nor vanish
            m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
            keep = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in ("vec_id", "f1", "f2")), packed(m)], names=["vec_id", "f1", "f2", "unit"])


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centres; starts from vectors spread over the sample."""
    if not x.size:
        return np.zeros((1, max(1, x.shape[1])))
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], c)
    return c


def _cells(centres: np.ndarray):
    p = min(PROBES, len(centres))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = widened(unpacked(b.column("unit")), centres.shape[1])
                near = np.sort(np.argpartition(-(x @ centres.T), p - 1, axis=1)[:, :p], axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "copies", "unit")), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["vec_id", "copies", "unit", "cells"])

    return run


def _compare(least: float):
    def run(batches):
        for t in groups(batches, ["cell", "i", "j"]):
            cell, i, j = (t.column(c)[0].as_py() for c in ("cell", "i", "j"))
            ids, k, own = (t.column(c).to_numpy() for c in ("vec_id", "copies", "own"))
            x = unpacked(t.column("unit"))
            probes = np.array(t.column("cells").to_pylist())
            rows, cols = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = np.nonzero(x[rows] @ x[cols].T >= least)
            a, b = rows[a], cols[b]
            keep = a < b if i == j else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            # in the first cell that both share
            shared = (probes[a][:, :, None] == probes[b][:, None, :]).any(axis=2) if len(a) else np.zeros((0, 1), bool)
            keep = probes[a, shared.argmax(axis=1)] == cell
            a, b = a[keep], b[keep]
            if len(a):
                links = np.bincount(a, k[b], len(ids)) + np.bincount(b, k[a], len(ids))
                nodes, roots = _roots(ids[a], ids[b])
                at = np.argsort(ids)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots), pa.array(links[at[np.searchsorted(ids[at], nodes)]].astype(np.int64))], names=["a", "b", "links"])

    return run


def similar_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links (other vectors with cosine >= least), component_id (smallest vec_id
    reachable over links), kept (vec_id = component_id).

    Vectors that are null, zero or hold a null or non-finite component, and rows without
    vec_id, link with nothing.  Shorter vectors count as filled up with zeros.  Repeated rows
    are copies of each other.
    """
    spark, n = prepare(vectors.sparkSession), F.col
    rows = vectors.select(n("vec_id").cast("long").alias("vec_id"), n("embedding").cast(NUM).alias("v"))
    rows = rows.withColumn("f1", F.xxhash64("v")).withColumn("f2", F.xxhash64(F.lit(1), "v"))
    part = settle(rows.where(sound("v") & n("vec_id").isNotNull()).mapInArrow(_units, "vec_id long, f1 long, f2 long, unit binary"), "units")
    classes = settle(part.groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    one = part.join(classes.select("f1", "f2", n("rep").alias("vec_id"), "copies"), ["f1", "f2", "vec_id"]).select("vec_id", "copies", "unit")
    one = settle(one.groupBy("vec_id").agg(F.first("copies").alias("copies"), F.first("unit").alias("unit")), "one")
    total = one.count()
    picked = one.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("unit").collect()
    sample = unpacked([pa.scalar(r.unit, pa.binary()) for r in picked])
    centres = spherical_kmeans(sample, max(1, min(len(sample) // 8, total // CELL)))
    near = settle(one.mapInArrow(_cells(centres), "vec_id long, copies long, unit binary, cells array<int>"), "cells")
    put = near.withColumn("cell", F.explode("cells"))
    size = settle(put.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    put = put.join(size, "cell").withColumn("own", F.pmod(F.xxhash64("vec_id", "cell"), n("blocks")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), n("blocks") - 1)))
    put = put.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "copies", "unit", "cells")
    links = settle(dealt(put, "cell", "i", "j").mapInArrow(_compare(least), "a long, b long, links long"), "links")
    comp = components(links.select("a", "b"))
    count = links.groupBy(n("a").alias("rep")).agg(F.sum("links").alias("links"))
    group = settle(classes.join(count, "rep", "left").join(comp.select(n("id").alias("rep"), "root"), "rep", "left"), "groups")
    linked = sound("v") & n("vec_id").isNotNull()
    out = rows.withColumn("ok", linked).join(group, ["f1", "f2"], "left").withColumn("ok", n("ok") & n("rep").isNotNull())
    cid = F.when(n("ok"), F.coalesce("root", "rep")).otherwise(n("vec_id"))
    return out.select("vec_id", F.when(n("ok"), n("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(n("vec_id") == cid, F.lit(True)).alias("kept"))
