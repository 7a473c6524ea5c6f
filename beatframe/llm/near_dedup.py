"""MinHash near-dedup with an LSH forest.

A document is the set of its distinct five-word shingles.  Each tree of the forest sorts
the signatures in another order (the signature rotated to begin at another place), so
documents that share a long prefix are neighbours in it.  A region is a run of rows with a
common prefix of ``DEPTH`` minima; where a region is dense, ``DEEP`` minima are asked for.
Rows of a region hang on its first row, and what hangs together in any tree is a cluster of
candidates.  Inside clusters the links are then confirmed on the full shingle sets.

With similarity s a pair shares no region with probability (1 - s**DEPTH)**TREES, which is
2e-8 for 0.85 and 3e-6 for 0.8 (dense regions: 1e-5 and 7e-4, for a pair that nothing else
connects).

Scale: exact copies are one row from the start.  Clusters larger than ``BLOCK`` are compared
in blocks: first each block with itself and with a few documents that visit every block,
then, only where a cluster is still in several pieces, the pieces outside the largest one
with everything else.  No pair of one group is emitted that is already connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import chunks, components, dealt, groups, mix, prepare, runs, settle, signed, width, words

TREES, DEPTH, DEEP = 24, 4, 6
#: Rows of a region from which on DEEP minima must agree, and documents of a block.
DENSE, BLOCK, VISITORS = 64, 96, 4
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int):
    """Sorted distinct shingle hashes of each text; the whole sequence if it has fewer words."""
    w = words(texts, lower=True)
    every = runs(w.h, size)
    for a, b in zip(w.off[:-1].tolist(), w.off[1:].tolist()):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        elif b > a:
            yield mix(runs(w.h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _signature(s: np.ndarray) -> np.ndarray:
    """Minima under every permutation, over slices of a long set."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        h = x[i : i + 2048, None] * _A[None, :] + _B[None, :]
        h ^= h >> np.uint32(15)
        np.minimum(out, h.min(axis=0), out=out)
    return out


_ROT = (np.arange(TREES)[:, None] * DEPTH + np.arange(DEEP)[None, :]) % (TREES * DEPTH)


def _keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per tree: hash of the first DEPTH minima, and the next ones up to DEEP."""
    m = sig[_ROT].astype(np.uint64)
    key = np.arange(TREES, dtype=np.uint64)
    for j in range(DEPTH):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, j])
    return key, m[:, DEPTH] << np.uint64(32) | m[:, DEPTH + 1]


def _sign(size: int):
    def run(batches):
        for b in chunks(batches):
            n, print_, keys, rest = [], [], [], []
            for s in shingle_sets(b.column("text"), size):
                n.append(len(s))
                if len(s):
                    k, r = _keys(_signature(s))
                    print_.append((int(np.bitwise_xor.reduce(mix(s))), int(np.sum(mix(s + np.uint64(77)), dtype=np.uint64))))
                    keys.append(signed(k))
                    rest.append(signed(r))
                else:
                    print_.append((0, 0))
                    keys.append(np.zeros(0, np.int64))
                    rest.append(np.zeros(0, np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, rest)]
            f = signed(np.array(print_, np.uint64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), *lists], names=["doc_id", "n_shingles", "f1", "f2", "keys", "rests"])

    return run


def _regions(batches):
    """Sorted (key, rest, doc_id) -> links to the first row of a region, or of its deeper part
    where the region is dense.  Keeps at most DENSE rows of the region at hand."""
    key = rest = head = None
    heads: list[int] = []  # first rows of the deeper parts of the region at hand
    seen = 0
    for b in batches:
        k, r, d = (b.column(i).to_numpy() for i in range(3))
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        part = new.copy()
        part[1:] |= r[1:] != r[:-1]
        new[0] = key is None or k[0] != key
        part[0] = new[0] or r[0] != rest
        out_a, out_b = [], []
        at = np.flatnonzero(part)
        first = np.searchsorted(at, np.arange(len(k)), "right") - 1
        own = np.where(first >= 0, d[at[np.maximum(first, 0)]] if len(at) else 0, head if head is not None else 0)
        far = ~part
        out_a.append(d[far])
        out_b.append(own[far])
        cuts = np.flatnonzero(new).tolist()
        for x, y in zip([0, *cuts], [*cuts, len(k)]):
            if x in cuts[:1] or (x and new[x]):
                if 1 < len(heads) and seen <= DENSE:
                    out_a.append(np.array(heads[1:], np.int64))
                    out_b.append(np.full(len(heads) - 1, heads[0], np.int64))
                heads, seen = [], 0
            if y > x:
                seen += y - x
                if seen <= DENSE:
                    heads += d[x:y][part[x:y]].tolist()
        key, rest, head = k[-1], r[-1], own[-1]
        yield _pairs(out_a, out_b)
    if 1 < len(heads) and seen <= DENSE:
        yield _pairs([np.array(heads[1:], np.int64)], [np.full(len(heads) - 1, heads[0], np.int64)])


def _pairs(a, b) -> pa.RecordBatch:
    cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([cat(a), cat(b)], names=["a", "b"])


def _sets(size: int):
    def run(batches):
        for b in chunks(batches):
            sets = pa.array([s.tobytes() for s in shingle_sets(b.column("text"), size)], pa.binary())
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), sets], names=[*keep, "shingles"])

    return run


def _same(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * n >= percent * (len(x) + len(y) - n)


def _confirm(percent: int, keys: list[str]):
    """Links among the documents of one block that connect what is not yet connected.
    piece: what an earlier pass connected; asks: whether a row is compared with the others."""

    def run(batches):
        for t in groups(batches, keys):
            ids, piece, asks = (t.column(c).to_numpy() for c in ("doc_id", "piece", "asks"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            order = np.lexsort([ids, -asks.astype(np.int8)])
            label = {i: p for i, p in zip(order.tolist(), piece[order].tolist())}
            members: dict[int, list[int]] = {}
            for i, p in label.items():
                members.setdefault(p, []).append(i)
            a, b = [], []
            for i in order[asks[order]].tolist():
                for j in order.tolist():
                    if label[i] != label[j] and (not asks[j] or i < j or len(keys) > 2) and _same(sets[i], sets[j], percent):
                        a.append(ids[i])
                        b.append(ids[j])
                        x, y = sorted((label[i], label[j]), key=lambda p: len(members[p]))
                        for m in members[x]:
                            label[m] = y
                        members[y] += members.pop(x)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Linked: 100 * intersection >= percent * union of the shingle sets.  Text without words
    (null included) has no shingle and no link.  Repeated rows each give a row.  Rows without
    doc_id are linked with nothing: their component is null and they are kept.
    """
    spark, n = prepare(docs.sparkSession), F.col
    docs = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text"))
    sig = settle(docs.mapInArrow(_sign(size), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, rests array<long>"), "signatures")
    full = sig.where((n("n_shingles") > 0) & n("doc_id").isNotNull())
    # one row for each distinct set
    prints = ["f1", "f2", "n_shingles"]
    classes = settle(full.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "classes")
    rep = full.join(classes.select(*prints, n("rep").alias("doc_id")), [*prints, "doc_id"], "left_semi")
    rows = rep.select("doc_id", F.posexplode("keys").alias("t", "key"), "rests").select("key", F.get("rests", n("t")).alias("rest"), "doc_id")
    near = rows.repartition(width(spark), "key").sortWithinPartitions("key", "rest", "doc_id").mapInArrow(_regions, "a long, b long")
    clusters = components(near)
    # the sets of all documents that have a candidate
    count = settle(clusters.groupBy("root").agg(F.count("*").alias("docs")), "sizes")
    member = clusters.join(count, "root").select(n("id").alias("doc_id"), "root", "docs")
    sets = settle(docs.join(member, "doc_id").mapInArrow(_sets(size), "doc_id long, root long, docs long, shingles binary"), "sets").dropDuplicates(["doc_id"])
    sets = sets.withColumn("blocks", F.ceil(n("docs") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), n("blocks")).cast("int"))
    # within blocks; a few documents visit every block of their cluster
    visits = (n("blocks") > 1) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), n("docs")) < VISITORS)
    first = sets.withColumn("block", F.explode(F.when(visits, F.sequence(F.lit(0), n("blocks") - 1)).otherwise(F.array("block"))))
    first = first.select("root", "block", "doc_id", n("doc_id").alias("piece"), F.lit(True).alias("asks"), "shingles")
    links = settle(dealt(first, "root", "block").mapInArrow(_confirm(percent, ["root", "block"]), "a long, b long"), "links")
    # clusters of several blocks that are still in pieces: the smaller pieces against the rest
    piece = components(links)
    big = member.where(n("docs") > BLOCK).join(piece.select(n("id").alias("doc_id"), n("root").alias("piece")), "doc_id", "left")
    big = big.withColumn("piece", F.coalesce("piece", "doc_id"))
    weigh = big.groupBy("root", "piece").agg(F.count("*").alias("k"))
    most = weigh.groupBy("root").agg(F.max(F.struct("k", "piece")).alias("m"), F.sum("k").alias("k"))
    most = settle(most.where(n("m.k") < n("k")).select("root", n("m.piece").alias("main"), F.ceil((n("k") - n("m.k")) / BLOCK).cast("int").alias("askers")), "main")
    rest = big.join(most, "root").select("doc_id", "piece", (n("piece") != n("main")).alias("asks"), "askers")
    rest = sets.join(rest, "doc_id")
    mine = F.pmod(F.xxhash64("doc_id", F.lit(2)), n("askers")).cast("int")
    asked = rest.select("root", F.explode(F.sequence(F.lit(0), n("askers") - 1)).alias("asker"), "block", "doc_id", "piece", F.lit(False).alias("asks"), "shingles")
    asking = rest.where("asks").select("root", mine.alias("asker"), F.explode(F.sequence(F.lit(0), n("blocks") - 1)).alias("block"), "doc_id", "piece", "asks", "shingles")
    keys = ["root", "asker", "block"]
    more = settle(dealt(asked.unionByName(asking), *keys).mapInArrow(_confirm(percent, keys), "a long, b long"), "links")
    last = components(links.unionByName(more))
    out = sig.drop("keys", "rests").join(classes, prints, "left").join(last.select(n("id").alias("rep"), n("root").alias("component_id")), "rep", "left")
    comp = F.when(n("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(n("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group; rows without doc_id all stay."""
    own = "_kept_id"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    kept = near_duplicates(docs, percent, size).where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(own))
    one = docs.join(kept, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
