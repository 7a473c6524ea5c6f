"""Helpers shared by the corpus operators: scratch tables, words as hashes, components.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  They are handled as
64-bit hashes computed for a whole Arrow batch at once; nothing here loops over words.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.layout import ship_package

#: Bytes of text that are held as NumPy columns at a time (one longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20
#: Bytes whose words are hashed at a time (one longer word is a piece of its own).
PIECE_BYTES = 1 << 18


# ---- session and scratch -----------------------------------------------------
def prepare(spark: SparkSession) -> SparkSession:
    """Options the operators rely on; all are runtime SQL options."""
    ship_package(spark)
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
        # shuffle files of a finished write go at once, not when the driver collects garbage
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }.items():
        spark.conf.set(k, v)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  A local folder stands in for
    it only in local mode, where driver and tasks share one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.environ.get("BEATFRAME_LOCAL_SCRATCH")
        if not root:
            root = os.environ["BEATFRAME_LOCAL_SCRATCH"] = tempfile.mkdtemp(prefix="beatframe-")
    return root.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/llm-{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "table") -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder."""
    path = fresh(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, also the number of salts that spread a hot group."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- words -------------------------------------------------------------------
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of a chunk of texts: hash, byte range in ``buf``, and per text its range of words."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    buf: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def words(texts: pa.Array, lower: bool) -> Words:
    buf, off = text_bytes(texts)
    n = len(buf)
    if lower:
        buf = _LOWER[buf]
    solid = ~_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = off[(off > 0) & (off < n)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_hashes(buf, start, end), start, end, np.searchsorted(start, off), buf)


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every word, piece by piece: a long text needs no long columns of 64-bit sums."""
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE_BYTES, "right")))
        a, b = int(start[at]), int(end[to - 1])
        x, y = start[at:to] - a, end[at:to] - a
        p, q = _power_tables(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * p[: b - a], out=total[1:])
        h[at:to] = mix((total[y] - total[x]) * q[x] + (y - x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return h


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (one entry per start; the last k - 1 starts are left out)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    mult = 1
    for j in range(k):
        mult = mult * _BASE & _MASK
        out += h[j : j + m] * np.uint64(mult)
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about CHUNK_BYTES of text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + CHUNK_BYTES, "right")))
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker stays, and others start beside it


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs that Spark has."""
    return x.view(np.int64)


# ---- connected components ----------------------------------------------------
def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the given edges, and the smallest node it reaches by them."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        if np.array_equal(nxt, root):
            return nodes, nodes[root]
        root = nxt


def _thin(batches):
    for b in batches:
        if b.num_rows:
            n, r = _roots(b.column(0).to_numpy(), b.column(1).to_numpy())
            keep = n != r
            yield pa.RecordBatch.from_arrays([pa.array(n[keep]), pa.array(r[keep])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a long, b long): the smallest id it reaches.

    Stars are drawn together (each node hooks its neighbours to its smallest one) until no
    edge changes; every round is a written table, and batches of edges are first reduced to
    forests inside their tasks.  Neither nodes nor links pass through the driver.
    """
    n = F.col
    thin = lambda e: e.mapInArrow(_thin, "a long, b long").distinct()
    cur = settle(thin(edges.select("a", "b").where(n("a") != n("b"))), "edges")
    while True:
        # large star, then small star; both keep a > b
        both = cur.unionByName(cur.select(n("b").alias("a"), n("a").alias("b")))
        # written first: a join of two written tables can be split where one node has most edges
        low = settle(both.groupBy("a").agg(F.least(F.min("b"), n("a")).alias("m")), "low")
        large = both.join(low, "a").where(n("b") > n("a")).select(n("b").alias("a"), n("m").alias("b"))
        large = settle(large.unionByName(low.where(n("m") < n("a")).select("a", n("m").alias("b"))).distinct(), "large")
        least = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where(n("b") != n("m")).select(n("b").alias("a"), n("m").alias("b"))
        nxt = settle(small.unionByName(least.select("a", n("m").alias("b"))).distinct(), "edges")
        # done when every node has one edge and no root is itself hooked
        row = nxt.groupBy("a").agg(F.count("*").alias("k")).agg(F.max("k").alias("k")).first()
        if row.k is None or (row.k == 1 and nxt.select("b").distinct().join(nxt.select(n("a").alias("b")), "b", "left_semi").isEmpty()):
            break
        cur = nxt
    return settle(nxt.select(n("a").alias("id"), n("b").alias("root")).unionByName(nxt.select(n("b").alias("id"), n("b").alias("root")).distinct()), "roots")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one key after another, from batches that are sorted by the keys (not null)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in cols)
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one partition, one key after another; for keys of bounded size."""
    return df.repartition(width(df.sparkSession), *keys).sortWithinPartitions(*keys)
