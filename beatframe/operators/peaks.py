"""Peak geometry: local maxima, distance thinning, prominence, half width."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..params import DETECTOR, DetectorParams
from .layout import Layout, Scan, lasting, settle, ship_package

SPEC = ["_prom", "_dist", "_wmin", "_wmax"]


def key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


class Errors:
    """Errors of kernels, one row a group, in written tables."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.found = keys, []

    def split(self, out: DataFrame) -> DataFrame:
        """The rows of groups that went well; the others' errors are kept."""
        with lasting():  # read when all is done
            out = settle(out)
        if set(self.keys) <= set(out.columns):
            self.found.append(out.where("_error is not null").select(*self.keys, "_error"))
        return out.where("_error is null").drop("_error")

    def table(self, spark, keys: T.StructType) -> DataFrame:
        out = spark.createDataFrame([], T.StructType([*keys.fields, T.StructField("_error", T.StringType())]))
        for f in self.found:
            out = out.unionByName(f)
        return out


_errors: ContextVar[Errors | None] = ContextVar("errors", default=None)


@contextmanager
def collected_errors(keys: list[str]):
    """Within this, a kernel that raises gives an error row for its group instead of ending
    the job (groups must carry ``keys``)."""
    token = _errors.set(Errors(keys))
    try:
        yield _errors.get()
    finally:
        _errors.reset(token)


def arrow_groups(df: DataFrame, group: list[str], keep: list[str], fields: list[tuple[str, str]], fn, many: bool = False) -> DataFrame:
    """Run ``fn(columns) -> dict of arrays`` once per bounded group.

    ``columns`` maps value names to NumPy arrays ordered by ``idx``; ``keep`` key
    columns are repeated on the output.  With ``many``, ``fn(columns, off)`` gets several whole
    groups (``off[g]:off[g + 1]``) at once and returns each output row's group as well.
    """
    ship_package(df.sparkSession)
    errors = _errors.get()
    schema = T.StructType(key_fields(df, keep) + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    if errors:
        schema = schema.add("_error", T.StringType())
    caught = Exception if errors else ()
    as_rows = errors is not None  # the object itself stays on the driver
    values = [c for c in df.columns if c not in group]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def one(cols: dict) -> dict:
        if "idx" in cols and not (cols["idx"][1:] >= cols["idx"][:-1]).all():
            order = np.argsort(cols["idx"], kind="stable")
            cols = {c: v[order] for c, v in cols.items()}
        try:
            out, why = fn(cols, np.array([0, len(cols[values[0]])]))[1] if many else fn(cols), None
        except caught as e:
            out, why = {name: [None] for name, _ in fields}, type(e).__name__
        return out | {"_error": [why] * len(out[fields[0][0]])} if out and as_rows else out

    def several(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Whole groups, the first rows of which are given."""
        ends = np.append(starts[1:], table.num_rows)
        mixed = {c: table.column(c) for c in values if table.column(c).null_count and not pa.types.is_floating(table.schema.field(c).type)}
        cols = {c: table.column(c).to_numpy() for c in values if c not in mixed}
        outs, first = [], []
        if many and not as_rows and not mixed:
            of, out = fn(cols, np.append(starts, table.num_rows))
            ends = ends[:0]
            if len(of):
                outs, first = [out], [starts[of]]
        for a, b in zip(starts.tolist(), ends.tolist()):
            mine = {c: cols[c][a:b] if c in cols else mixed[c].slice(a, b - a).to_numpy() for c in values}
            out = one(mine)
            if out and len(out[fields[0][0]]):
                outs.append(out)
                first.append(np.full(len(out[fields[0][0]]), a))
        if not outs:
            return None
        at = pa.array(np.concatenate(first))
        data = [table.column(k).take(at).combine_chunks().cast(arrow.field(k).type) for k in keep]
        for f in list(arrow)[len(keep):]:
            v = [o[f.name] for o in outs]
            plain = isinstance(v[0], np.ndarray) and v[0].dtype != object and all(isinstance(x, np.ndarray) and x.dtype == v[0].dtype for x in v)
            made = [pa.array(x, f.type, from_pandas=True) for x in ([np.concatenate(v)] if plain else v)]
            data.append(pa.concat_arrays(made))
        return pa.RecordBatch.from_arrays(data, schema=arrow)

    def run(batches):
        left = []  # of the group that may go on
        for batch in batches:
            starts = np.flatnonzero(batch.column("_nth").to_numpy() == 1)
            if not starts.size:
                left.append(batch)
                continue
            whole = [*left, batch.slice(0, int(starts[-1]))]
            left = [batch.slice(int(starts[-1]))]
            before = sum(x.num_rows for x in whole[:-1])
            starts = starts[:-1] + before
            if before:
                starts = np.append(0, starts)
            if starts.size:
                out = several(pa.Table.from_batches(whole), starts)
                if out is not None:
                    yield out
        if left:
            out = several(pa.Table.from_batches(left), np.zeros(1, np.int64))
            if out is not None:
                yield out

    # a window places and orders the rows; its first rows tell where groups begin, so that many
    # short groups come in one batch
    nth = F.row_number().over(W.partitionBy(*group).orderBy("idx" if "idx" in values else group[0]))
    out = df.withColumn("_nth", nth).mapInArrow(run, schema)
    return errors.split(out) if errors else out


def group_numbers(df: DataFrame, keys: list[str], names: list[str], fn) -> DataFrame:
    """One row of doubles per bounded group: ``fn(columns)`` gives them in order, None for null
    (NaN stays NaN).  Columns ``keys, names``."""
    def run(c):
        v = fn(c)
        nan = sum(1 << i for i, x in enumerate(v) if x is not None and x != x)
        return {n: [x] for n, x in zip(names, v)} | {"_nan": [nan]}

    d = arrow_groups(df, keys, keys, [*[(n, "double") for n in names], ("_nan", "int")], run)
    made = [F.when(F.col("_nan").bitwiseAND(1 << i) != 0, float("nan")).otherwise(F.col(n)).alias(n) for i, n in enumerate(names)]
    return d.select(*keys, *made)


def local_maxima(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Plateau-aware maxima: a run of equal samples above both neighbouring runs,
    reported at the (floored) middle of the run.  Columns ``keys, idx, amp``."""
    d = lay.scan(samples.select(*keys, "idx", "x"), keys, ["idx"], _px=Scan("lag", F.col("x")))
    # one row per run of equal samples; its end is the position before the next run
    runs = d.where("_px is null or x <> _px")
    runs = lay.scan(
        runs, keys, ["idx"],
        _next=Scan("lead", F.struct(F.col("idx").alias("i"), F.col("x").alias("v"))),
    )
    top = runs.where("_px is not null and _next is not null and x > _px and x > _next.v")
    mid = F.floor((F.col("idx") + F.col("_next.i") - 1) / 2).cast("int")
    return top.select(*keys, mid.alias("idx"), F.col("x").alias("amp"))


def thin_peaks(peaks: DataFrame, keys: list[str], lay: Layout, distance: Column) -> DataFrame:
    """Distance suppression: the highest peak removes lower ones closer than ``distance``."""
    from .greedy import in_rounds

    d = peaks.select(*keys, "idx", "amp", F.ceil(distance).cast("int").alias("_dist"))

    def decide(c, state, own):
        return K.thin(c["idx"].astype(np.int64), c["amp"], int(c["_dist"][0]), state, own)

    low, high = F.greatest(F.col("idx") - F.col("_dist"), F.lit(0)), F.col("idx") + F.col("_dist")
    return in_rounds(d, keys, lay, low, high, decide).select(*keys, "idx", "amp")


def seek(queries: DataFrame, samples: DataFrame, keys: list[str], lay: Layout, higher: bool) -> DataFrame:
    """Nearest sample beyond a threshold, for segments cut into chunks.

    ``queries``: ``keys, qid, idx, thr, side``; looks from ``idx`` towards ``side``
    (-1/+1) for the first ``x > thr`` (``higher``) or ``x <= thr``.  Adds ``low``
    (minimum on the way), ``pos`` and the samples ``xa`` at ``pos`` and ``xb`` one
    step back.  A query meets its own chunk; if that holds no such sample, the extremes of
    the segment's chunks name the one chunk that does, and the minimum up to it.  In all
    three places the queries of a chunk are answered together by a table of ranges.
    """
    ship_package(samples.sparkSession)
    reach, _, group = lay.frame(samples.select(*keys, "idx", "x"), keys, 1)
    reach = reach.select(*group, "idx", "x", "_core")
    sign = -1.0 if higher else 1.0

    def schema(*fields):
        made = T.StructType(key_fields(queries, keys) + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
        from pyspark.sql.pandas.types import to_arrow_schema

        return made, to_arrow_schema(made)

    asked = ("qid", "bigint"), ("side", "int"), ("thr", "double")
    met_schema, met_arrow = schema(("_chunk", "bigint"), *asked, ("low", "double"), ("pos", "int"), ("xa", "double"), ("xb", "double"))

    def answer(q: pa.Table, s: pa.Table) -> pa.Table:
        if q.num_rows == 0 or s.num_rows == 0:
            return met_arrow.empty_table()
        i = s.column("idx").to_numpy()
        order = np.argsort(i)
        i, x, core = i[order], s.column("x").to_numpy()[order], s.column("_core").to_numpy(zero_copy_only=False)[order]
        first, last = np.flatnonzero(core)[[0, -1]]
        side, thr, at = (q.column(c).to_numpy() for c in ("side", "thr", "idx"))
        at = np.clip(np.searchsorted(i, at), first, last)
        beyond, low = K.RangeTable(sign * x), K.RangeTable(x)
        pos = np.full(at.size, -1, np.int64)
        for way in (-1, 1):
            mine = side == way
            pos[mine] = beyond.nearest(at[mine], sign * thr[mine], way, strict=higher)
        pos = np.where(x[at] > thr if higher else x[at] <= thr, at, pos)
        found = (pos >= first) & (pos <= last)
        end = np.where(found, pos, np.where(side < 0, first, last))
        back = pos - side
        known = found & (back >= 0) & (back < x.size)
        cols = {c: q.column(c) for c in keys + ["_chunk", "qid", "side", "thr"]}
        cols["low"] = pa.array(low.lowest(np.minimum(at, end), np.maximum(at, end) + 1))
        for name, v, ok in (("pos", i, found), ("xa", x, found)):
            cols[name] = pa.array(v[np.where(ok, pos, 0)], mask=~ok)
        cols["xb"] = pa.array(x[np.where(known, back, 0)], mask=~known)
        return pa.Table.from_arrays([cols[f.name].cast(f.type) for f in met_arrow], schema=met_arrow)

    def visit(q):
        q = q.select(*keys, "_chunk", F.col("qid").cast("bigint"), F.col("side").cast("int"), F.col("thr").cast("double"), F.col("idx").cast("int"))
        return q.groupBy(*group).cogroup(reach.groupBy(*group)).applyInArrow(answer, met_schema)

    own = settle(visit(queries.withColumn("_chunk", lay.chunk("idx"))))
    open_q = own.where("pos is null").select(*keys, F.col("_chunk").alias("_from"), "qid", "side", "thr")
    far_schema, far_arrow = schema(*asked, ("_chunk", "bigint"), ("_between", "double"))

    def choose(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0:
            return far_arrow.empty_table()
        order = np.argsort(c.column("_chunk").to_numpy())
        chunk, mx, mn = (c.column(n).to_numpy()[order] for n in ("_chunk", "_mx", "_mn"))
        beyond, low = K.RangeTable(sign * (mx if higher else mn)), K.RangeTable(mn)
        side, thr = q.column("side").to_numpy(), q.column("thr").to_numpy()
        here = np.full(side.size, np.searchsorted(chunk, q.column("_from")[0].as_py()))
        to = np.full(side.size, -1, np.int64)
        for way in (-1, 1):
            mine = side == way
            to[mine] = beyond.nearest(here[mine], sign * thr[mine], way, strict=higher)
        end = np.where(to >= 0, to, np.where(side < 0, -1, chunk.size))
        between = low.lowest(np.minimum(here, end) + 1, np.maximum(here, end))
        cols = {n: q.column(n) for n in keys + ["qid", "side", "thr"]}
        cols["_chunk"] = pa.array(chunk[np.maximum(to, 0)], mask=to < 0)
        cols["_between"] = pa.array(between)
        return pa.Table.from_arrays([cols[f.name].cast(f.type) for f in far_arrow], schema=far_arrow)

    chunks = settle(reach.where("_core").groupBy(*group).agg(F.max("x").alias("_mx"), F.min("x").alias("_mn")))
    every = settle(open_q.select(*keys, "_from").distinct().join(chunks, keys))  # a new table: both sides read open_q
    target = settle(open_q.groupBy(*keys, "_from").cogroup(every.groupBy(*keys, "_from")).applyInArrow(choose, far_schema))
    edge = F.when(F.col("side") < 0, (F.col("_chunk") + 1) * lay.size - 1).otherwise(F.col("_chunk") * lay.size)
    far = visit(target.where("_chunk is not null").withColumn("idx", edge)).select(
        *keys, "qid", "side", F.col("low").alias("_flow"), F.col("pos").alias("_fpos"), F.col("xa").alias("_fxa"), F.col("xb").alias("_fxb")
    )
    rest = target.select(*keys, "qid", "side", "_between").join(far, keys + ["qid", "side"], "left")
    return own.drop("_chunk", "thr").join(rest, keys + ["qid", "side"], "left").select(
        *keys, "qid", "side",
        F.least("low", "_between", "_flow").alias("low"),
        F.coalesce("pos", "_fpos").alias("pos"),
        F.coalesce("xa", "_fxa").alias("xa"),
        F.coalesce("xb", "_fxb").alias("xb"),
    )


def _both_sides(peaks: DataFrame, thr: Column) -> DataFrame:
    q = peaks.withColumns({"qid": F.col("idx").cast("bigint"), "thr": thr})
    return q.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))


def prominence_width(peaks: DataFrame, samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Add ``prom`` and ``width`` (samples) to given peak positions ``keys, idx, amp``."""
    if not lay.long:
        flagged = samples.select(*keys, "idx", "x").join(
            peaks.select(*keys, "idx", F.lit(1).alias("_pk")), keys + ["idx"], "left"
        )

        def run(c):
            at = np.flatnonzero(c["_pk"] == 1)
            if at.size == 0:
                return {}
            prom = K.prominences(c["x"], at)
            return {"idx": c["idx"][at], "prom": prom, "width": K.half_widths(c["x"], at, prom)}

        shape = arrow_groups(flagged, keys, keys, [("idx", "int"), ("prom", "double"), ("width", "double")], run)
        return peaks.join(shape, keys + ["idx"])
    p = peaks.select(*keys, "idx", "amp")
    bases = seek(_both_sides(p, F.col("amp")), samples, keys, lay, True)
    bases = bases.groupBy(*keys, F.col("qid").cast("int").alias("idx")).agg(F.max("low").alias("_base"))
    p = p.join(bases, keys + ["idx"]).withColumn("prom", F.col("amp") - F.col("_base"))
    cross = seek(_both_sides(p, F.col("amp") - 0.5 * F.col("prom")), samples, keys, lay, False)
    cross = cross.groupBy(*keys, F.col("qid").cast("int").alias("idx")).pivot("side", [-1, 1]).agg(
        F.first(F.struct("pos", "xa", "xb"))
    )
    h = F.col("amp") - 0.5 * F.col("prom")
    p = p.join(cross, keys + ["idx"])

    def edge(side):
        c = F.col(f"`{side}`")
        bent = c["pos"] - side * (h - c["xa"]) / (c["xb"] - c["xa"])
        return F.when(c["xa"] < h, bent).otherwise(c["pos"].cast("double"))

    p = p.withColumn("width", edge(1) - edge(-1))
    return peaks.join(p.select(*keys, "idx", "prom", "width"), keys + ["idx"])


def find_peaks(
    samples: DataFrame,
    keys: list[str],
    lay: Layout,
    *,
    min_prom: Column,
    distance: Column,
    min_width: Column | None = None,
    max_width: Column | None = None,
    within: str | None = None,
    lone: bool = False,
) -> DataFrame:
    """Maxima, then distance, prominence and width limits (all in samples).

    Limits are column expressions constant within a key.  ``within`` names a column whose
    values part a key's samples into signals of their own; short ones share a group
    (``lone``: but for those with samples that are not finite).
    Returns ``keys, within, idx, amp, prom, width``.
    """
    if within and lay.long:
        return find_peaks(samples, keys + [within], lay, min_prom=min_prom, distance=distance, min_width=min_width, max_width=max_width)
    none = F.lit(None).cast("double")
    d = samples.select(
        *keys, "idx", "x", min_prom.cast("double").alias("_prom"), distance.cast("double").alias("_dist"),
        (none if min_width is None else min_width.cast("double")).alias("_wmin"),
        (none if max_width is None else max_width.cast("double")).alias("_wmax"), *([within] if within else []),
    )
    fields = [("idx", "int"), ("amp", "double"), ("prom", "double"), ("width", "double")]
    if not lay.long:
        part = [(within, samples.schema[within].dataType.simpleString())] if within else []

        def signals(c, off):
            """Rows ordered by segment and signal, and where these signals begin."""
            of = np.repeat(np.arange(off.size - 1), np.diff(off))
            order = np.lexsort((c[within], of))
            c, of = {k: v[order] for k, v in c.items()}, of[order]
            fresh = np.diff(of, prepend=-1) != 0
            fresh[1:] |= c[within][1:] != c[within][:-1]
            return c, of, np.append(np.flatnonzero(fresh), len(of))

        def apart(c, off):
            """Segments (or signals, if ``lone``) that hold other than finite samples by themselves, the others together."""
            owner = np.arange(off.size - 1)
            if within and lone:
                c, of, off = signals(c, off)
                owner = of[off[:-1]]
            odd = np.add.reduceat(~np.isfinite(c["x"]), off[:-1], dtype=np.int64) > 0
            if off.size == 2 or not odd.any():
                of, out = run(c, off)
                return owner[of], out
            parts = [np.flatnonzero(~odd), *np.flatnonzero(odd)[:, None]]
            got = []
            for g in parts:
                if g.size:
                    rows = np.concatenate([np.arange(off[i], off[i + 1]) for i in g])
                    of, out = run({k: v[rows] for k, v in c.items()}, np.append(0, np.cumsum(off[g + 1] - off[g])))
                    got.append((owner[g[of]], out))
            return np.concatenate([of for of, _ in got]), {k: np.concatenate([out[k] for _, out in got]) for k in got[0][1]}

        def run(c, off):
            of = np.repeat(np.arange(off.size - 1), np.diff(off))
            if within:
                c, of, off = signals(c, off)
            spec = [c[s][off[:-1]].astype(float) for s in SPEC]
            g, pos, prom, width = K.find_peaks_many(c["x"], off, *spec)
            at = off[g] + pos
            out = {"idx": c["idx"][at], "amp": c["x"][at], "prom": prom, "width": width}
            return of[at], out | ({within: c[within][at]} if within else {})

        return arrow_groups(d, keys, keys, part + fields, apart, many=True)
    limits = d.groupBy(*keys).agg(*[F.first(s).alias(s) for s in SPEC])
    p = local_maxima(samples, keys, lay).join(limits, keys)
    kept = settle(thin_peaks(p, keys, lay, F.col("_dist")))
    p = prominence_width(kept, samples, keys, lay).join(limits, keys)
    ok = F.col("_prom").isNull() | (F.col("prom") >= F.col("_prom"))
    ok &= F.col("_wmin").isNull() | (F.col("width") >= F.col("_wmin"))
    ok &= F.col("_wmax").isNull() | (F.col("width") <= F.col("_wmax"))
    return p.where(ok).select(*keys, *[f for f, _ in fields])


def raw_peaks(samples: DataFrame, keys: list[str], lay: Layout, p: DetectorParams = DETECTOR, within: str | None = None) -> DataFrame:
    """Raw peaks with width in seconds; ``within`` as in :func:`find_peaks`.  Needs an
    ``fs`` column."""
    fs = F.col("fs")
    got = find_peaks(
        samples, keys + ["fs"], lay,
        min_prom=F.lit(p.prom0),
        distance=F.greatest(F.lit(1), (F.lit(p.min_peak_distance_s) * fs).cast("int")),
        min_width=F.lit(2.0), within=within,
    )
    got = got.withColumn("width_s", F.col("width") / fs)
    return got.where((F.col("width_s") >= p.min_width_s) & (F.col("width_s") <= p.max_width_s)).drop("width")


def peaks_per_transient(mapped: DataFrame, keys: list[str], lay: Layout, p: DetectorParams = DETECTOR) -> DataFrame:
    """Raw peaks inside each transient of at least five samples (``tid`` on samples)."""
    k = keys + ["tid"]
    d = lay.with_aggs(mapped.where("tid is not null"), k, _n=F.count(F.lit(1))).where("_n >= 5")
    return raw_peaks(d, keys, lay, p, within="tid")
