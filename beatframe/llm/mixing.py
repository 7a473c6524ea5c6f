"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by source, language and topic.  Raking scales the table of tokens to each
marginal in turn until all three hold; a cell's weight over its tokens is how much of it is
wanted, and a common factor (found by bisection, no probability above 1) brings the expected
number of tokens to the budget.  A document stays if the hash of its id falls below the
probability of its cell, so every run and every copy of a row decides alike.

Topics are spherical k-means clusters of hashed word counts; the centres start from a bounded
sample (``SAMPLE`` documents by hash of id) and are then moved by sums over all documents.

Scale: every value has a target of its own.  A table of at most ``CELLS`` cells is raked on the
driver and broadcast; a larger one is raked in Spark (group sums by axis, factors joined) with
the same result.  Texts are read three times (topics are moved over packed word counts) and
shuffled only if the table is too large for a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, prepare, settle, words
from .embedding_dedup import ROUNDS, spherical_kmeans

SAMPLE, TOPICS, SPACE, CELLS = 2048, 8, 256, 1 << 16
UNIT = 1 << 20  # vectors are summed as whole numbers of this part: the same in any order
AXES = ("source", "lang", "topic")
#: Columns that ``mixed`` adds.
NEW = ["_source", "_lang", "_topic", "_tokens", "_weight", "_probability", "_kept"]
LOOK = "_source string, _lang string, _topic int, _weight double, _probability double"


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many have each hash."""
    w = words(texts, lower=True)
    n = np.diff(w.off)
    at = np.repeat(np.arange(len(n)), n) * SPACE + (w.h % np.uint64(SPACE)).astype(np.int64)
    return n, np.bincount(at, minlength=len(n) * SPACE).reshape(len(n), SPACE)


def _unit(counts: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts.astype(float))
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and a unit vector of its hashed word counts (zero without words)."""
    n, counts = _counts(texts)
    return n, _unit(counts)


def _vectors(batches):
    for b in chunks(batches):
        n, v = _hashed(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(pa.array(n > 0)), pa.array([x.tobytes() for x in v[n > 0]], pa.binary())], names=["doc_id", "v"])


def _packed(batches):
    """Hashed word counts of the texts of a chunk that have words."""
    codec = pa.Codec("zstd")
    for b in chunks(batches):
        n, c = _counts(b.column("text"))
        c = c[n > 0].astype(np.int32)
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array([len(c)], pa.int32()), pa.array([codec.compress(c.tobytes(), asbytes=True)], pa.binary())], names=["n", "counts"])


def _moved(centres: np.ndarray):
    def run(batches):
        total = np.zeros(centres.shape, np.int64)
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), b.column("counts").to_pylist()):
                v = _unit(np.frombuffer(pa.decompress(data, decompressed_size=4 * n * SPACE, codec="zstd"), np.int32).reshape(n, SPACE))
                own = np.arange(len(centres))[:, None] == (v @ centres.T).argmax(axis=1)
                total += (own.astype(float) @ np.rint(v * UNIT)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], names=["at", "v"])

    return run


def topics(docs: DataFrame) -> np.ndarray:
    """Centres that start from at most SAMPLE documents and are moved by all, repeated rows and
    rows without doc_id among them."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).dropDuplicates()
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").mapInArrow(_vectors, "doc_id long, v binary").collect()
    x = np.array([np.frombuffer(r.v) for r in sorted(rows)]).reshape(len(rows), SPACE)
    c = spherical_kmeans(x, min(TOPICS, len(x))) if len(x) else np.ones((1, SPACE)) / np.sqrt(SPACE)
    packed = settle(docs.select("text").mapInArrow(_packed, "n int, counts binary"), "counts")
    for _ in range(ROUNDS):
        total = np.zeros(c.size)
        for r in packed.mapInArrow(_moved(c), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():  # TOPICS * SPACE rows
            total[r["at"]] = r.v
        total = total.reshape(c.shape)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        old, c = c, np.where(size > 0, total / np.maximum(size, 1e-300), c)
        if np.abs(c - old).max() < 1e-6:
            break
    return c


def _assign(centres: np.ndarray):
    def run(batches):
        for b in chunks(batches):
            n, v = _hashed(b.column("text"))
            yield b.append_column("_tokens", pa.array(n)).append_column("_topic", pa.array((v @ centres.T).argmax(axis=1).astype(np.int32)))

    return run


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 500, close: float = 1e-10) -> np.ndarray:
    """Weights with the zeros of ``tokens`` and the given marginals (each sums to 1; targets
    of values without tokens are shared out among the others)."""
    at = [x.ravel() for x in np.indices(tokens.shape)]
    return rake_cells(at, tokens.ravel(), targets, rounds, close).reshape(tokens.shape)


def rake_cells(at: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 500, close: float = 1e-10) -> np.ndarray:
    """The same for a list of cells, ``at`` being the number of each cell's value on every axis."""
    w = tokens / max(tokens.sum(), 1e-300)
    want = []
    for k, target in zip(at, targets):
        have = np.bincount(k, w, len(target)) > 0
        t = np.where(have, target, 0.0)
        want.append(t / t.sum() if t.sum() > 0 else have / max(have.sum(), 1))
    for _ in range(rounds):
        off = 0.0
        for k, t in zip(at, want):
            m = np.bincount(k, w, len(t)).astype(float)  # (whole numbers if there are no cells)
            off = max(off, float(np.abs(m - t).max(initial=0)))
            w = w * np.divide(t, m, out=np.zeros_like(m), where=m > 0)[k]
        if off < close:
            break
    return w


def _on_driver(cells: DataFrame, given: list, share: float, power: float) -> DataFrame:
    rows = cells.collect()
    tokens = np.array([r.tokens for r in rows], float)
    at, want = [], []
    for k, g in enumerate(given):
        values, place = np.unique(np.array([r[k] for r in rows], object if k < 2 else int), return_inverse=True)
        m = np.bincount(place, tokens, len(values))
        at.append(place)
        want.append(np.array([float(g.get(v, g.get(str(v), 0))) for v in values.tolist()]) if g else m**power)
    w = rake_cells(at, tokens, want)
    p = probabilities(tokens, w, share)
    lines = [(*r[:3], float(x), float(y)) for r, x, y in zip(rows, w, p)]
    return F.broadcast(cells.sparkSession.createDataFrame(lines, LOOK))  # at most CELLS rows


def _in_spark(cells: DataFrame, given: list, share: float, power: float, rounds: int = 500, close: float = 1e-10) -> DataFrame:
    """``rake_cells`` and ``probabilities`` with the table and the factors of all values in Spark."""
    spark, n = cells.sparkSession, F.col
    some = cells.where(n("tokens") > 0)
    total = float(some.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    some = some.withColumn("w", n("tokens") / F.lit(total))
    names, factors = [f"_{c}" for c in AXES], {}
    for c, g in zip(names, given):
        t = some.groupBy(c).agg(F.sum("w").alias("m"))
        if g:
            t = t.join(spark.createDataFrame([(str(v), float(x)) for v, x in g.items()], "v string, t double"), n(c).cast("string") == n("v"), "left").select(c, F.coalesce("t", F.lit(0.0)).alias("t"))
        else:
            t = t.select(c, F.pow("m", F.lit(float(power))).alias("t"))
        t = settle(t, "targets")
        row = t.agg(F.sum("t").alias("t"), F.count("*").alias("n")).first()
        want = n("t") / F.lit(row.t) if row.t else F.lit(1.0 / max(row.n, 1))
        factors[c] = t.select(c, want.alias("want"), F.lit(1.0).alias("f"))
    for _ in range(rounds):
        off = 0.0
        for c in names:
            m = some
            for o in names:
                if o != c:
                    m = m.join(factors[o].select(o, n("f").alias(f"f{o}")), o).withColumn("w", n("w") * n(f"f{o}"))
            m = m.groupBy(c).agg(F.sum("w").alias("m"))
            factors[c] = settle(factors[c].join(m, c).select(c, "want", F.when(n("m") > 0, n("want") / n("m")).otherwise(0.0).alias("f"), F.abs(n("f") * n("m") - n("want")).alias("off")), "factors")
            off = max(off, factors[c].agg(F.max("off")).first()[0] or 0.0)
        if off < close:
            break
    look = cells.withColumn("_weight", n("tokens") / F.lit(total))
    for c in names:
        look = look.join(factors[c].select(c, "f"), c, "left").withColumn("_weight", n("_weight") * F.coalesce("f", F.lit(0.0))).drop("f")
    look = settle(look, "weights")
    # the expected tokens grow with the factor by ever smaller slopes: steps from below end at the budget
    factor, budget, before = 0.0, share * total, -1
    while True:
        full = n("_weight") * F.lit(factor) >= n("tokens")
        row = look.where((n("tokens") > 0) & (n("_weight") > 0)).agg(F.sum(full.cast("long")).alias("n"), F.sum(F.when(full, n("tokens"))).alias("t"), F.sum(F.when(~full, n("_weight"))).alias("w")).first()
        if not row.w:
            factor = 1e300
            break
        if row.n == before:
            break
        before, factor = row.n, (budget - (row.t or 0)) / row.w
    p = F.when(n("tokens") > 0, F.least(F.lit(1.0), n("_weight") / n("tokens") * F.lit(factor))).otherwise(1.0)
    return look.select(*names, "_weight", p.alias("_probability"))


def probabilities(tokens: np.ndarray, weights: np.ndarray, share: float) -> np.ndarray:
    """min(1, factor * weight / tokens), with ``share`` of all tokens expected."""
    ask = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    budget, lo, hi = share * tokens.sum(), 0.0, 1.0
    got = lambda f: float((np.minimum(1, f * ask) * tokens).sum())
    while got(hi) < budget * (1 - 1e-12) and hi < 1e300:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if got(mid) < budget else (lo, mid)
    return np.where(tokens > 0, np.minimum(1, hi * ask), 1.0)


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = 0.5, power: float = 0.5) -> DataFrame:
    """``docs`` with _source, _lang (null: "unknown"; "other" if its axis has targets and it has none),
    _topic, _tokens (words), _weight (of the cell, sums to 1), _probability and _kept.

    ``targets``: by axis (source, lang, topic) the wanted share of each value; an axis without
    targets gets shares in proportion to its tokens to ``power``.  Text without words counts no
    tokens; a cell without tokens keeps all its rows.  Repeated rows decide alike, and so do
    all rows without doc_id.  Columns of ``docs`` that have one of the new names are replaced
    (:func:`mixture` returns all columns as they were).
    """
    spark, n = prepare(docs.sparkSession), F.col
    docs = docs.drop(*NEW)
    text = docs.select(n("doc_id").cast("long").alias("doc_id"), n("text").cast("string").alias("text"))
    centres = topics(text)
    plain = docs.select("doc_id", n("text").cast("string").alias("text"), *(F.coalesce(n(c).cast("string"), F.lit("unknown")).alias(f"_{c}") for c in AXES[:2]))
    shape = lambda d: f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in d.schema)}, _tokens long, _topic int"
    seen = plain.mapInArrow(_assign(centres), shape(plain))
    given = [(targets or {}).get(c) for c in AXES]
    named = {f"_{c}": F.when(n(f"_{c}").isin(sorted(g)), n(f"_{c}")).otherwise("other") for c, g in zip(AXES[:2], given) if g}
    cells = settle(seen.withColumns(named).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")), "cells")
    look = (_on_driver if cells.count() <= CELLS else _in_spark)(cells, given, share, power)
    out = docs.withColumn("text", n("text").cast("string"))
    out = out.mapInArrow(_assign(centres), shape(out)).withColumns({f"_{c}": F.coalesce(n(c).cast("string"), F.lit("unknown")) for c in AXES[:2]}).withColumns(named)
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), n("doc_id").cast("long")), 11) / F.lit(float(1 << 53))
    return out.join(look, ["_source", "_lang", "_topic"]).withColumn("_kept", u < n("_probability"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are sampled; other columns may have any name."""
    used = ["doc_id", "text", *AXES[:2]]
    others = [c for c in docs.columns if c not in used]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest") if others else F.lit(0).alias("rest")
    kept = mixed(docs.select(*used, rest), **how).where("_kept")
    return kept.select(*[F.col("rest").getField(c).alias(c) if c in others else c for c in docs.columns])
