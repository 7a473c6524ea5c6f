"""How rows of one recording segment are spread over tasks.

A segment is normally short (thousands of samples), so one group per segment is
the right unit of work.  Nothing guarantees that, though: a single recording may
hold a third of all rows.  Every ordered or order-statistic operator therefore
goes through :class:`Layout`, which offers two exact strategies:

* ``long=False``: no group exceeds ``size`` samples (a checked fact, see
  :meth:`Layout.measure`), windows are partitioned by the segment key;
* ``long=True``: segments are cut into chunks of ``size`` positions.  Fixed-reach
  windows see a halo copied from the neighbouring chunks, unbounded windows
  (previous row, fill, running totals) add a carry computed from one summary row
  per chunk, and quantiles are selected by counting around approximate cut points.

Both strategies return the same rows.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..params import MAD_SCALE

CHUNK = 1 << 20
KEYS = ["recording_id", "segment_no"]
PKEYS = KEYS + ["polarity"]
PLACEMENT = "spark.sql.requireAllClusterKeysForCoPartition"


def tune(spark: SparkSession) -> SparkSession:
    """Session options the plans rely on (all are runtime SQL options)."""
    ship_package(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # joins on (segment, more) keep a partitioning by segment instead of re-shuffling,
    # until a layout finds a long segment
    spark.conf.set(PLACEMENT, "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # shuffle files of a finished write go at once, not when the driver collects garbage
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver runs."""
    sc = spark.sparkContext
    if getattr(sc, "_beatframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="beatframe-pkg-")) / "beatframe.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._beatframe_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` when the
    cluster names one; a local folder only where it is unset in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.environ.get("BEATFRAME_LOCAL_SCRATCH")
        if not root:
            root = tempfile.mkdtemp(prefix="beatframe-")
            os.environ["BEATFRAME_LOCAL_SCRATCH"] = root
    return root.rstrip("/")


_written: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def settle(df: DataFrame | Callable[[], DataFrame], by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a table that survives executor loss and reading it back.

    With ``by`` the table is bucketed and sorted by those columns, so that windows, groups
    and joins on them (and more) read it without a shuffle.  If a function makes ``df``, the
    tables it wrote on the way are dropped when the result is written.
    """
    if callable(df):
        return private(lambda: settle(df(), by))
    spark = df.sparkSession
    name = f"beatframe_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    if not by:
        df.write.mode("errorifexists").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
        out = spark.table(name)
    out._scratch = (name if by else None, path)
    if (written := _written.get()) is not None:
        written.append(out)
    return out


def steady(df: DataFrame) -> DataFrame:
    """``df`` for several readers: settled, unless it only selects from a table."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    simple = all(re.match(r"[\s:+-]*(Project|Filter|Relation|LocalRelation|LogicalRDD)\b", line) for line in plan)
    return df if simple and "UDF" not in "".join(plan) else settle(df)


def drop(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for t in tables:
        name, path = t._scratch
        spark = t.sparkSession
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def private(make: Callable):
    """What ``make()`` returns, a settled table or a tuple with some; every other table written
    by it (and the jobs it started and waited for) is dropped."""
    mine: list[DataFrame] = []
    token = _written.set(mine)
    try:
        out = make()
    finally:
        _written.reset(token)
    spared = [t for t in (out if isinstance(out, tuple) else (out,)) if hasattr(t, "_scratch")]
    paths = {t._scratch for t in spared}
    drop(*[t for t in mine if t._scratch not in paths])
    if (written := _written.get()) is not None:
        written.extend(spared)
    return out


@contextmanager
def lasting():
    """Tables settled within are dropped by nobody."""
    token = _written.set(None)
    try:
        yield
    finally:
        _written.reset(token)


class Jobs:
    """Independent parts of a plan as concurrent jobs: while one waits for its last tasks, or
    is still being planned, the others use the cluster."""

    def __init__(self, width: int = 6) -> None:
        self.pool = ThreadPoolExecutor(width)

    def __enter__(self) -> "Jobs":
        return self

    def __exit__(self, *error) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)

    def narrow(self) -> None:
        """From now on one job beside the caller's at a time: parts that fill the cluster by
        themselves would only add up their shuffles on disk."""
        self.pool.shutdown(wait=True)
        self.pool = ThreadPoolExecutor(1)

    def start(self, part, *args):
        """Begin ``part(*args)``; call the result to wait for it."""
        return self.pool.submit(copy_context().run, part, *args).result

    def all(self, *parts):
        return [p() for p in [self.start(p) for p in parts]]


@dataclass(frozen=True)
class Scan:
    """One ordered-scan column: lag, lead, ffill, bfill, cumsum, cummax or rownum."""

    kind: str
    expr: Column | None = None


@dataclass(frozen=True)
class Layout:
    size: int = CHUNK
    long: bool = False
    max_fs: float = 250.0

    @staticmethod
    def measure(df: DataFrame, keys: list[str], size: int = CHUNK, weight: Column | None = None) -> "Layout":
        """Check the largest group with one map-side combined count (``weight`` =
        samples per row when a row is a whole trace)."""
        weight = F.lit(1) if weight is None else weight
        fs = F.max("fs") if "fs" in df.columns else F.lit(250.0)
        row = df.groupBy(*keys).agg(F.sum(weight).alias("n"), fs.alias("fs")).agg(F.max("n"), F.max("fs")).first()
        return Layout(size, (row[0] or 0) > size, float(row[1] or 250.0)).placed(df.sparkSession)

    def placed(self, spark: SparkSession) -> "Layout":
        """Long segments: joins on (segment, position) are placed by both, not by segment alone."""
        if self.long:
            spark.conf.set(PLACEMENT, "true")
        return self

    def chunk(self, pos: str | Column) -> Column:
        pos = F.col(pos) if isinstance(pos, str) else pos
        return F.floor(pos / F.lit(self.size)).cast("long")

    # ---- fixed-reach windows -------------------------------------------------
    def frame(self, df: DataFrame, keys: list[str], reach: int, pos: str = "idx"):
        """Rows plus ``reach`` neighbours, and the window over them.

        Returns ``(rows, window, group_keys)``; rows carry ``_core``.  Follow with
        :meth:`core` once the window columns are computed.
        """
        if not self.long:
            return df.withColumn("_core", F.lit(True)), W.partitionBy(*keys).orderBy(pos), list(keys)
        p = F.col(pos)
        lo = F.greatest(self.chunk(p - reach), F.lit(0).cast("long"))
        rows = df.withColumn("_chunk", F.explode(F.sequence(lo, self.chunk(p + reach))))
        rows = rows.withColumn("_core", F.col("_chunk") == self.chunk(pos))
        group = list(keys) + ["_chunk"]
        return rows, W.partitionBy(*group).orderBy(pos), group

    @staticmethod
    def core(rows: DataFrame) -> DataFrame:
        return rows.where("_core").drop("_core", "_chunk")

    # ---- unbounded ordered scans ---------------------------------------------
    def scan(self, df: DataFrame, keys: list[str], order: list[str], **cols: Scan) -> DataFrame:
        """Add ordered-scan columns; ``order[0]`` is the position used for chunking."""
        if not self.long:
            w = W.partitionBy(*keys).orderBy(*order)
            past = w.rowsBetween(W.unboundedPreceding, 0)
            # a fill from the right runs backwards: growing frames stay linear
            back = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
            future = back.rowsBetween(W.unboundedPreceding, 0)
            made = {}
            for name, s in cols.items():
                made[name] = {
                    "lag": lambda s=s: F.lag(s.expr).over(w),
                    "lead": lambda s=s: F.lead(s.expr).over(w),
                    "ffill": lambda s=s: F.last(s.expr, True).over(past),
                    "bfill": lambda s=s: F.last(s.expr, True).over(future),
                    "cumsum": lambda s=s: F.sum(s.expr).over(past),
                    "cummax": lambda s=s: F.max(s.expr).over(past),
                    "rownum": lambda s=s: F.row_number().over(w),
                }[s.kind]()
            return df.withColumns(made)
        return self._scan_long(df, keys, order, cols)

    def _scan_long(self, df, keys, order, cols):
        group = list(keys) + ["_chunk"]
        # times become sample positions, so that a chunk of them is as large as any other
        timed = isinstance(df.schema[order[0]].dataType, (T.DoubleType, T.FloatType))
        df = steady(df.withColumn("_chunk", self.chunk(F.col(order[0]) * self.max_fs if timed else order[0])))
        w = W.partitionBy(*group).orderBy(*order)
        past = w.rowsBetween(W.unboundedPreceding, 0)
        future = W.partitionBy(*group).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
        at = [F.col(c) for c in order]
        local, summary, carry = {}, {}, {}
        cw = W.partitionBy(*keys).orderBy("_chunk")
        before = cw.rowsBetween(W.unboundedPreceding, -1)
        after = W.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
        for name, s in cols.items():
            e = s.expr
            if s.kind == "lag":
                local[name] = F.lag(F.struct(e.alias("v"))).over(w)
                summary[name] = F.max_by(F.struct(e.alias("v")), F.struct(*at))
                carry[name] = F.lag(name).over(cw)
            elif s.kind == "lead":
                local[name] = F.lead(F.struct(e.alias("v"))).over(w)
                summary[name] = F.min_by(F.struct(e.alias("v")), F.struct(*at))
                carry[name] = F.lead(name).over(cw)
            elif s.kind == "ffill":
                local[name] = F.last(F.when(e.isNotNull(), F.struct(e.alias("v"))), True).over(past)
                summary[name] = F.max_by(F.struct(e.alias("v")), F.when(e.isNotNull(), F.struct(*at)))
                carry[name] = F.last(name, True).over(before)
            elif s.kind == "bfill":
                local[name] = F.last(F.when(e.isNotNull(), F.struct(e.alias("v"))), True).over(future)
                summary[name] = F.min_by(F.struct(e.alias("v")), F.when(e.isNotNull(), F.struct(*at)))
                carry[name] = F.last(name, True).over(after)
            elif s.kind == "cumsum":
                local[name] = F.sum(e).over(past)
                summary[name] = F.sum(e)
                carry[name] = F.sum(name).over(before)
            elif s.kind == "cummax":
                local[name] = F.max(e).over(past)
                summary[name] = F.max(e)
                carry[name] = F.max(name).over(before)
            else:
                local[name] = F.row_number().over(w)
                summary[name] = F.count(F.lit(1))
                carry[name] = F.sum(name).over(before)
        chunks = df.groupBy(*group).agg(*[c.alias(n) for n, c in summary.items()])
        chunks = chunks.select(*group, *[c.alias(f"_c_{n}") for n, c in carry.items()])
        out = df.withColumns(local).join(chunks, group, "left")
        final = {}
        for name, s in cols.items():
            if s.kind == "cummax":
                final[name] = F.greatest(name, f"_c_{name}")
            elif s.kind in ("cumsum", "rownum"):
                v = F.when(
                    F.col(name).isNotNull() | F.col(f"_c_{name}").isNotNull(),
                    F.coalesce(name, F.lit(0)) + F.coalesce(f"_c_{name}", F.lit(0)),
                )
                final[name] = v.cast("int") if s.kind == "rownum" else v
            else:
                final[name] = F.coalesce(name, f"_c_{name}")["v"]
        return out.withColumns(final).drop("_chunk", *[f"_c_{n}" for n in cols])

    def islands(self, df: DataFrame, keys: list[str], gap: Column, pos: str = "idx", name: str = "island") -> DataFrame:
        """Label runs of rows whose consecutive distance is at most ``gap``."""
        d = self.scan(df, keys, [pos], _prev=Scan("lag", F.col(pos)))
        fresh = F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > gap)
        d = d.withColumn("_fresh", F.when(fresh, F.col(pos)))
        return self.scan(d, keys, [pos], **{name: Scan("ffill", F.col("_fresh"))}).drop("_prev", "_fresh")

    def neighbours(self, points: DataFrame, marks: DataFrame, keys: list[str], fields: list[str], pos: str = "idx") -> DataFrame:
        """As-of join both ways: adds ``prev`` (last mark at or before the point)
        and ``next`` (first mark after it), each a struct of the mark's ``fields``.

        One ordered pass over points and marks together; no pairs are formed.
        """
        rest = [c for c in points.columns if c not in keys + [pos]]
        ptype = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_one"))
        m = marks.select(*keys, pos, F.lit(0).alias("_k"), F.struct(*fields).alias("_m"))
        p = points.select(*keys, pos, F.lit(1).alias("_k"), ptype.alias("_p"))
        u = p.unionByName(m, allowMissingColumns=True)
        u = self.scan(u, keys, [pos, "_k"], prev=Scan("ffill", F.col("_m")), next=Scan("bfill", F.col("_m"))).where("_k = 1")
        return u.select(*keys, pos, *([F.col("_p")[c].alias(c) for c in rest]), "prev", "next")

    def index_rows(self, df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "idx") -> DataFrame:
        """Dense 0-based position per key.  ``bucket`` is monotone in the order, so a
        large key is numbered bucket by bucket plus a prefix sum of bucket counts."""
        if not self.long:
            return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
        group = list(keys) + ["_b"]
        d = df.withColumn("_b", bucket)
        counts = d.groupBy(*group).count()
        prior = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.select(*group, F.coalesce(F.sum("count").over(prior), F.lit(0)).alias("_o"))
        local = d.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)
        return local.join(offsets, group).withColumn(name, (F.col("_o") + F.col("_r")).cast("int")).drop("_b", "_o", "_r")

    # ---- exact quantiles -----------------------------------------------------
    def quantiles(self, df: DataFrame, keys: list[str], value: Column, qs: dict[str, float]) -> DataFrame:
        """One row per key with linearly interpolated quantiles (nulls ignored)."""
        if not self.long:
            p = F.percentile(value, F.array(*[F.lit(float(q)) for q in qs.values()]))
            g = df.groupBy(*keys).agg(p.alias("_p"))
            return g.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(qs)])
        out, values = None, steady(df.select(*keys, value.alias("_v")).where("_v is not null"))
        for n, q in qs.items():
            one = self._quantile_long(values, keys, float(q)).withColumnRenamed("_q", n)
            out = one if out is None else out.join(one, keys)
        return settle(out)

    def quantile_table(self, df: DataFrame, keys: list[str], **named: tuple[Column, float]) -> DataFrame:
        """Quantiles of several values per key (short groups: one aggregation)."""
        if not self.long:
            return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(float(q))).alias(n) for n, (v, q) in named.items()])
        out, df = None, steady(df)
        for n, (v, q) in named.items():
            one = self.quantiles(df, keys, v, {n: q})
            out = one if out is None else out.join(one, keys, "full")
        return out

    @staticmethod
    def _quantile_long(d, keys, q):
        eps, acc = 2e-4, 20000
        lohi = F.percentile_approx("_v", [max(0.0, q - eps), min(1.0, q + eps)], acc)
        cuts = d.groupBy(*keys).agg(F.count("_v").alias("_n"), lohi.alias("_a"))
        cuts = cuts.select(*keys, "_n", F.col("_a")[0].alias("_lo"), F.col("_a")[1].alias("_hi"))
        at = d.join(cuts, keys)
        cnt = at.groupBy(*keys, "_n", "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_lt"),
            F.count_if(F.col("_v") <= F.col("_hi")).alias("_le"),
        )
        pos = F.lit(q) * (F.col("_n") - 1)
        # exact whatever the sketch said: widen the bracket when a rank falls outside
        cnt = (
            cnt.withColumn("_k0", F.floor(pos)).withColumn("_k1", F.ceil(pos))
            .withColumn("_f", pos - F.floor(pos))
            .withColumn("_open_lo", F.col("_k0") < F.col("_lt"))
            .withColumn("_open_hi", F.col("_k1") >= F.col("_le"))
            .withColumn("_base", F.when(F.col("_open_lo"), F.lit(0)).otherwise(F.col("_lt")))
            .select(*keys, "_lo", "_hi", "_k0", "_k1", "_f", "_open_lo", "_open_hi", "_base")
        )
        near = (
            d.join(cnt, keys)
            .where((F.col("_open_lo") | (F.col("_v") >= F.col("_lo"))) & (F.col("_open_hi") | (F.col("_v") <= F.col("_hi"))))
            .groupBy(*keys, "_k0", "_k1", "_f", "_base", "_v").agg(F.count(F.lit(1)).alias("_m"))
        )
        w = W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
        near = near.withColumn("_end", F.col("_base") + F.sum("_m").over(w)).withColumn("_start", F.col("_end") - F.col("_m"))

        def pick(k):
            return F.max(F.when((F.col("_start") <= F.col(k)) & (F.col(k) < F.col("_end")), F.col("_v")))

        got = near.groupBy(*keys, "_f").agg(pick("_k0").alias("_a"), pick("_k1").alias("_b"))
        return got.select(*keys, ((1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b")).alias("_q"))

    def with_quantiles(self, df: DataFrame, keys: list[str], value: Column, qs: dict[str, float]) -> DataFrame:
        """Attach quantiles to every row (short groups: one window, no join)."""
        if not self.long:
            p = F.percentile(value, F.array(*[F.lit(float(q)) for q in qs.values()])).over(W.partitionBy(*keys))
            d = df.withColumn("_p", p)
            return d.withColumns({n: F.col("_p")[i] for i, n in enumerate(qs)}).drop("_p")
        df = steady(df)
        return df.join(self.quantiles(df, keys, value, qs), keys, "left")

    def with_aggs(self, df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
        """Attach per-key aggregates to every row."""
        if not self.long:
            return df.withColumns({n: a.over(W.partitionBy(*keys)) for n, a in aggs.items()})
        df = steady(df)
        return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys, "left")

    def with_mad(self, df: DataFrame, keys: list[str], value: Column, median: str, mad: str) -> DataFrame:
        """Attach median and scaled median absolute deviation."""
        d = self.with_quantiles(df, keys, value, {median: 0.5})
        d = self.with_quantiles(d, keys, F.abs(value - F.col(median)), {mad: 0.5})
        return d.withColumn(mad, F.col(mad) * F.lit(MAD_SCALE))


SHORT = Layout()


def null_if_nan(c: Column) -> Column:
    """NaN is not a number to compare with: the engine stores NULL instead."""
    return F.when(~F.isnan(c), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo)))


def half_even(c: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(c, 0).cast("long")


def samples_of(seconds: Column | float, fs: Column, floor: int = 1) -> Column:
    """Seconds -> whole samples (half-even), at least ``floor``."""
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.greatest(F.lit(floor).cast("long"), half_even(s * fs))
