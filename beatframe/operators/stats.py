"""Signal statistics (aggregations and window functions over ``samples``).

``samples`` = ``keys, idx, x`` and, where seconds matter, ``fs``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import kernels as K
from ..params import DETECTOR, MAD_SCALE, DetectorParams
from .layout import Layout, Scan, clip, null_if_nan, samples_of, settle, ship_package
from .peaks import arrow_groups, find_peaks, group_numbers

TINY = 1e-12


def baseline_shift(samples: DataFrame, keys: list[str], lay: Layout, p: float = 0.05) -> DataFrame:
    """Subtract the 5th percentile."""
    d = lay.with_quantiles(samples, keys, F.col("x"), {"_base": p})
    return d.withColumn("x", F.col("x") - F.col("_base")).drop("_base")


def _quiet_mad(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    d = lay.with_quantiles(samples.select(*keys, "idx", "x"), keys, F.col("x"), {"_p30": 0.30})
    d = d.withColumn("_q", F.when(F.col("x") <= F.col("_p30"), F.col("x")))
    d = lay.with_aggs(d, keys, _nq=F.count("_q"))
    d = d.withColumn("_q", F.when(F.col("_nq") < 5, F.col("x")).otherwise(F.col("_q")))
    return lay.with_quantiles(d, keys, F.col("_q"), {"_med": 0.5})


def with_known(samples: DataFrame, *cols: str) -> DataFrame:
    """Columns for a kernel; ``_ok``: the sample is not null (in NumPy null is NaN)."""
    return samples.select(*cols, "x", F.col("x").isNotNull().alias("_ok"))


def noise_mad(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Noise level per key: scaled MAD of the lowest 30 percent, floored."""
    d = _quiet_mad(samples, keys, lay)
    q = lay.quantiles(d, keys, F.abs(F.col("_q") - F.col("_med")), {"_mad": 0.5})
    return q.select(*keys, F.greatest(F.col("_mad") * MAD_SCALE, F.lit(TINY)).alias("noise_mad"))


def global_snr(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """``snr, noise_mad, signal_mad`` per key."""
    if lay.long:
        d = _quiet_mad(samples, keys, lay)
        d = lay.with_quantiles(d, keys, F.col("x"), {"_mx": 0.5})
        t = lay.quantile_table(d, keys, _mad=(F.abs(F.col("_q") - F.col("_med")), 0.5), _sig=(F.abs(F.col("x") - F.col("_mx")), 0.5))
    else:
        def levels(c):
            v = c["x"][c["_ok"]]
            return K.quiet_mad(v), K.step_spread(v, 1.0)[1]

        t = group_numbers(with_known(samples, *keys), keys, ["_mad", "_sig"], levels)
    noise = F.greatest(F.col("_mad") * MAD_SCALE, F.lit(TINY))
    sig = F.col("_sig") * MAD_SCALE
    return t.select(*keys, (sig / noise).alias("snr"), noise.alias("noise_mad"), sig.alias("signal_mad"))


def differences(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """First differences ``d`` (null on the first sample) and the next one ``d_next``."""
    rows, w, _ = lay.frame(samples, keys, 1)
    rows = rows.withColumns({
        "d": F.col("x") - F.lag("x").over(w),
        "d_next": F.lead("x").over(w) - F.col("x"),
    })
    return lay.core(rows)


def spike_fraction(samples: DataFrame, keys: list[str], lay: Layout, z: float = 8.0) -> DataFrame:
    """Share of first differences whose robust z exceeds ``z``."""
    if not lay.long:
        def share_of(c):
            d, known = K.steps(c["x"], c["_ok"])
            d = d[known]
            if not d.size:
                return [0.0]
            m, spread = K.step_spread(d, MAD_SCALE)
            zed = np.abs((d - m) / K.or_least(spread, TINY))
            return [float(np.mean((zed > z) | np.isnan(zed)))]

        return group_numbers(with_known(samples, *keys, "idx"), keys, ["spike_fraction"], share_of)
    d = lay.with_mad(differences(samples, keys, lay), keys, F.col("d"), "_m", "_s")
    zed = F.abs((F.col("d") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(TINY)))
    share = F.avg(F.when(F.col("d").isNotNull(), (zed > z).cast("double")))
    return d.groupBy(*keys).agg(F.coalesce(share, F.lit(0.0)).alias("spike_fraction"))


def moving_average(samples: DataFrame, keys: list[str], lay: Layout, ms: float = 15.0, least: int = 3) -> DataFrame:
    """Centred mean of an odd window of at least ``least`` samples; edges are zero padded,
    so the divisor is always the window length.  Signals shorter than the window are
    unchanged.  The window follows each segment's own ``fs``, which a window frame of a
    fixed number of rows cannot.  Returns ``keys, idx, x, fs, smooth``."""
    d = lay.with_aggs(samples.select(*keys, "idx", "x", "fs"), keys, _n=F.count(F.lit(1)))
    rows, _, group = lay.frame(d, keys, K.odd_window(lay.max_fs, ms, least) // 2)

    def run(c):
        core = c["_core"].astype(bool)
        k, n = K.odd_window(float(c["fs"][0]), ms, least), int(c["_n"][0])
        smooth = c["x"] if n < k else np.convolve(c["x"], np.ones(k))[k // 2:k // 2 + c["x"].size] / k
        return {"idx": c["idx"][core], "x": c["x"][core], "fs": c["fs"][core], "smooth": smooth[core]}

    return arrow_groups(rows, group, keys, [("idx", "int"), ("x", "double"), ("fs", "double"), ("smooth", "double")], run)


def _bridged(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Non-finite samples on the line between the finite ones beside them (held at the ends)."""
    x, i = F.col("x"), F.col("idx")
    known = F.when(F.abs(x) < float("inf"), F.struct(i.alias("i"), x.alias("v")))
    d = lay.scan(samples, keys, ["idx"], _a=Scan("ffill", known), _b=Scan("bfill", known))
    a, b = F.col("_a"), F.col("_b")
    line = (b["v"] - a["v"]) / F.greatest(b["i"] - a["i"], F.lit(1)) * (i - a["i"]) + a["v"]
    return d.withColumn("x", F.coalesce(F.when(known.isNotNull(), x), line, a["v"], b["v"])).drop("_a", "_b")


def _trend_of(c: dict, core: np.ndarray, n: int, window_s: float, q: float) -> np.ndarray:
    """Sliding order statistic at the core samples of a signal (or chunk of one) of ``n`` samples;
    NaN when fewer than 30."""
    at = c["idx"][core]
    if n < 30:
        return np.full(at.size, np.nan)
    win = K.trend_window(n, float(c["fs"][0]), window_s)
    h = win // 2
    j = np.arange(int(at[0]) - h, int(at[-1]) + h + 1)
    j = np.where(j < 0, -1 - j, np.where(j >= n, 2 * n - 1 - j, j))
    x, known = c["x"], np.isfinite(c["x"])
    if known.any() and not known.all():  # a whole segment; chunks are bridged before they are cut
        x = np.interp(c["idx"], c["idx"][known], x[known])
    padded = x[j - int(c["idx"][0])]
    return K.sliding_rank(padded, win, int(win * (100.0 * q) / 100.0))


def rolling_trend(
    samples: DataFrame, keys: list[str], lay: Layout,
    window_s: Column | float = DETECTOR.drift_window_s, quantile: float = DETECTOR.drift_quantile,
) -> DataFrame:
    """Sliding order statistic with mirrored edges as column ``trend`` (null when
    fewer than 30 samples).  Gaps of non-finite samples are bridged between the finite
    samples beside them, however far these are; a JVM frame would re-sort the window for
    every sample, so the order statistic is taken in NumPy, many windows at once."""
    ws = window_s if isinstance(window_s, Column) else F.lit(float(window_s))
    q = float(np.clip(quantile, 0.01, 0.99))
    d = samples.withColumn("_ws", ws)
    d = lay.with_aggs(_bridged(d, keys, lay) if lay.long else d, keys, _n=F.count(F.lit(1)))
    widest = (samples.agg(F.max(ws)).first()[0] or 0.0) if isinstance(window_s, Column) else 0.0
    reach = max(31, round(float(widest) * lay.max_fs)) // 2 + 16 if isinstance(window_s, Column) else max(31, round(float(window_s) * lay.max_fs)) // 2 + 1
    rows, _, group = lay.frame(d.select(*keys, "idx", "x", "fs", "_ws", "_n"), keys, reach)

    def run(c):
        core = c["_core"].astype(bool)
        at = c["idx"][core]
        if at.size == 0:
            return {}
        return {"idx": at, "trend": _trend_of(c, core, int(c["_n"][0]), float(c["_ws"][0]), q)}

    out = arrow_groups(rows, group, keys, [("idx", "int"), ("trend", "double")], run)
    return samples.join(out, keys + ["idx"], "left")


def _correlation(a: Column, b: Column) -> Column:
    """Pearson correlation, null without variance (``corr`` would divide by zero)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def remove_drift(
    samples: DataFrame, keys: list[str], lay: Layout, p: DetectorParams = DETECTOR, row_corr: str | None = None, by: list[str] | None = None
):
    """Detect and subtract slow drift.  Returns ``(samples, drift)``.

    ``row_corr`` names an optional column with the median trace correlation: very
    similar traces keep their drift unless it is strong.  ``by``: columns to bucket the
    table of trends by.
    """
    if not lay.long:
        return _remove_drift_whole(samples, keys, p, row_corr, by)
    # the trend is the costly part: computed once, then read by every branch below
    s = settle(rolling_trend(samples, keys, lay, p.drift_window_s, p.drift_quantile), by)
    tr, x = F.col("trend"), F.col("x")
    q = lay.quantile_table(s, keys, t5=(tr, 0.05), t50=(tr, 0.5), t95=(tr, 0.95), x5=(x, 0.05), x95=(x, 0.95))
    rc = F.first(row_corr) if row_corr else F.lit(None).cast("double")
    m = s.groupBy(*keys).agg(
        _correlation(F.when(F.col("trend").isNotNull(), F.col("idx").cast("double")), F.col("trend")).alias("trend_time_corr"), rc.alias("row_corr")
    )
    m = m.join(q, keys)
    span, sig = F.col("t95") - F.col("t5"), F.col("x95") - F.col("x5")
    ratio = F.coalesce(span / F.greatest(sig, F.lit(TINY)), F.lit(0.0))
    strong = F.col("drift_ratio") >= 1.35 * p.drift_apply_min_ratio
    monotonic = F.coalesce(F.abs("trend_time_corr") >= 0.30, F.lit(False))
    m = m.withColumn("drift_ratio", ratio)
    m = m.withColumn("drift_detected", (F.col("drift_ratio") >= p.drift_apply_min_ratio) & (monotonic | strong))
    skip = F.coalesce(F.col("row_corr") > p.drift_max_row_corr_for_apply, F.lit(False)) & ~strong
    m = m.withColumn("applied", F.col("drift_detected") & ~skip & F.lit(p.drift_strength > 0))
    drift = m.select(
        *keys, "drift_ratio", F.coalesce(span, F.lit(0.0)).alias("drift_span"),
        F.when(F.col("t50").isNull(), 0.0).otherwise(sig).alias("signal_span"),
        "trend_time_corr", "row_corr", "drift_detected", "applied",
    )
    s = s.join(m.select(*keys, "t50", "applied"), keys, "left")
    flat = F.col("x") - p.drift_strength * (F.col("trend") - F.col("t50"))
    s = s.withColumn("_y", F.when(F.col("applied"), flat).otherwise(F.col("x")))
    s = lay.with_quantiles(s, keys, F.col("_y"), {"_base": 0.05})
    s = s.withColumn("x", F.when(F.col("applied"), F.col("_y") - F.col("_base")).otherwise(F.col("x")))
    return s.drop("_y", "_base", "trend", "t50", "applied"), drift


DRIFT = ["drift_ratio", "drift_span", "signal_span", "trend_time_corr", "row_corr"]


def _remove_drift_whole(samples: DataFrame, keys: list[str], p: DetectorParams, row_corr: str | None, by: list[str] | None):
    """:func:`remove_drift` of short segments: trend, decision and subtraction in one kernel, one
    table written.  The first sample of a segment carries its decision."""
    q = float(np.clip(p.drift_quantile, 0.01, 0.99))
    others = [c for c in samples.columns if c not in [*keys, "idx", "x"]]
    rc = F.col(row_corr).cast("double") if row_corr else F.lit(None).cast("double")
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    d = samples.withColumns({"_ok": F.col("x").isNotNull(), "_rc": rc, "_has_rc": rc.isNotNull(), "_keyed": keyed})

    def run(c):
        n, x, ok = len(c["x"]), c["x"], c["_ok"].astype(bool)
        trend = _trend_of(c, np.ones(n, bool), n, float(p.drift_window_s), q)
        has = ~np.isnan(trend)
        tr, v = trend[has], x[ok]
        x5, x95 = K.percentile(v, 0.05), K.percentile(v, 0.95)
        t5, t50, t95 = (K.percentile(tr, a) for a in (0.05, 0.5, 0.95))
        span = None if t5 is None else np.float64(t95) - t5
        sig = None if x5 is None else np.float64(x95) - x5
        ratio = np.float64(0.0) if span is None else span / K.or_least(sig, TINY)
        corr = None
        if tr.size:
            i = c["idx"][has].astype(float)
            spread = i.std() * tr.std()
            corr = None if spread == 0 else np.mean((i - i.mean()) * (tr - tr.mean())) / spread
        row = c["_rc"][0] if c["_has_rc"][0] else None
        strong = K.at_least(ratio, 1.35 * p.drift_apply_min_ratio)
        monotonic = corr is not None and K.at_least(abs(corr), 0.30)
        detected = K.at_least(ratio, p.drift_apply_min_ratio) and (monotonic or strong)
        skip = row is not None and (row > p.drift_max_row_corr_for_apply or row != row) and not strong
        applied = detected and not skip and p.drift_strength > 0
        if applied and c["_keyed"][0]:
            x, ok = x - p.drift_strength * (trend - t50), ok & has
            x = x - K.percentile(x[ok], 0.05)
        made = [ratio, 0.0 if span is None else span, 0.0 if t50 is None else sig, corr, row]
        null, nan = [v is None for v in made], [v is not None and v != v for v in made]
        drift = np.empty(n, object)  # every number is finite or flagged
        drift[0] = [0.0 if a or b else float(v) for v, a, b in zip(made, null, nan)] + [float(v) for v in (*null, *nan, detected, applied)]
        return {name: c[name] for name in ["idx", *others]} | {"x": x, "_nan": ok & np.isnan(x), "_drift": drift}

    fields = [(c, samples.schema[c].dataType.simpleString()) for c in ["idx", "x", *others]]
    s = settle(arrow_groups(d, keys, keys, [*fields, ("_nan", "boolean"), ("_drift", "array<double>")], run), by)
    flat = s.select(*[F.when(F.col("_nan"), float("nan")).otherwise(F.col("x")).alias("x") if c == "x" else F.col(c) for c in samples.columns])
    n, at = len(DRIFT), F.col("_drift")
    made = [F.when(at[n + i] == 0, F.when(at[2 * n + i] == 1, float("nan")).otherwise(at[i])).alias(c) for i, c in enumerate(DRIFT)]
    drift = s.where(at.isNotNull() & keyed).select(*keys, *made, (at[3 * n] == 1).alias("drift_detected"), (at[3 * n + 1] == 1).alias("applied"))
    return flat, drift


def dominant_period(samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Dominant autocorrelation period: ``period_s`` (null if none) and ``score``.

    Lagged products are summed per chunk (right halo = longest lag) and added up
    by lag, so no pair of samples is ever a row.
    """
    ship_package(samples.sparkSession)
    if lay.long:
        d = lay.with_quantiles(samples.select(*keys, "idx", "x", "fs"), keys, F.col("x"), {"_m": 0.5})
        d = lay.with_aggs(d, keys, _n=F.count(F.lit(1)), _sd=F.stddev_pop(F.col("x") - F.col("_m")))
        rows, _, group = lay.frame(d.withColumn("x", F.col("x") - F.col("_m")), keys, int(2.0 * lay.max_fs) + 1)
    else:
        rows, group = with_known(samples, *keys, "idx", "fs"), keys

    def whole(c):
        n, fs, ok = len(c["x"]), float(c["fs"][0]), c["_ok"].astype(bool)
        m = K.percentile(c["x"][ok], 0.5)
        x = c["x"] - (np.nan if m is None else m)
        sd = float(x[ok].std()) if ok.any() else np.nan
        return {"n": [n], "fs": [fs], "sd": [sd], "acf": [K.lag_products(x, n, min(n - 1, int(2.0 * fs)))]}

    def sums(c):
        core = c["_core"].astype(bool)
        if not core.any():
            return {}
        n, fs = int(c["_n"][0]), float(c["fs"][0])
        hi = min(n - 1, int(2.0 * fs))
        x = c["x"][int(np.flatnonzero(core)[0]):]
        return {"n": [n], "fs": [fs], "sd": [float(c["_sd"][0])], "acf": [K.lag_products(x, int(core.sum()), hi)]}

    fields = [("n", "int"), ("fs", "double"), ("sd", "double"), ("acf", "array<double>")]
    part = arrow_groups(rows, group, keys, fields, sums if lay.long else whole)
    if lay.long:
        by_lag = part.select(*keys, "n", "fs", "sd", F.posexplode("acf").alias("lag", "v"))
        by_lag = by_lag.groupBy(*keys, "n", "fs", "sd", "lag").agg(F.sum("v").alias("v"))
        part = by_lag.groupBy(*keys, "n", "fs", "sd").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("lag", "v"))), lambda e: e["v"]).alias("acf")
        )

    @F.pandas_udf("period_s double, score double")
    def pick(acf: pd.Series, n: pd.Series, fs: pd.Series, sd: pd.Series) -> pd.DataFrame:
        out, parts, of = [(None, 0.0)] * len(n), [], []
        for i, (a, m, f, s) in enumerate(zip(acf, n, fs, sd)):
            lo, hi = max(2, int(0.15 * f)), min(int(m) - 1, int(2.0 * f))
            if m < int(0.5 * f) or s < TINY or hi <= lo:
                continue
            a = np.asarray(a, dtype=float)
            a = a / max(a[0] / s**2, TINY) / s**2
            if not np.isfinite(a).all():  # by itself, it would reach into the others
                lag, v = K.dominant_lag(a, lo, hi)
                out[i] = (lag / f if lag >= 0 else None, v)
                continue
            parts.append(a[lo : hi + 1])
            of.append((i, lo, f))
        if parts:
            for (i, lo, f), (pos, v) in zip(of, K.dominant_many(parts)):
                if pos >= 0:
                    out[i] = ((pos + lo) / f, v)
        return pd.DataFrame(out, columns=["period_s", "score"]).astype(float)

    got = part.select(*keys, pick("acf", "n", "fs", "sd").alias("r"))
    return got.select(*keys, null_if_nan(F.col("r.period_s")).alias("period_s"), F.col("r.score").alias("score"))


def interbeat_cv(peaks: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Population sd over mean of the gaps between peaks; null below three peaks."""
    d = lay.scan(peaks.select(*keys, "idx", "fs"), keys, ["idx"], _p=Scan("lag", F.col("idx")))
    gap = (F.col("idx") - F.col("_p")) / F.col("fs")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("m"), F.stddev_pop(gap).alias("s"))
    return g.select(*keys, F.when((F.col("n") >= 3) & (F.col("m") > 1e-9), F.col("s") / F.col("m")).alias("ibi_cv"))


def quality_score(prom_snr: Column, n: Column, cv: Column) -> Column:
    q = F.log1p(F.greatest(prom_snr, F.lit(0.0))) + 0.14 * F.least(n, F.lit(12))
    q = q - F.when(cv.isNotNull(), 0.90 * F.greatest(F.lit(0.0), cv - 0.12)).otherwise(F.lit(0.0))
    return q - F.when(n == 0, 1.5).otherwise(F.lit(0.0))


def fs_from_times(samples: DataFrame, keys: list[str], lay: Layout, t: str = "t_s") -> DataFrame:
    """Sampling rate from the median positive time step."""
    d = lay.scan(samples, keys, ["idx"], _pt=Scan("lag", F.col(t)))
    dt = F.when(F.col(t) > F.col("_pt"), F.col(t) - F.col("_pt"))
    q = lay.quantiles(d, keys, dt, {"_dt": 0.5})
    return q.select(*keys, (F.lit(1.0) / F.col("_dt")).alias("fs_est"))


def polarity_score(samples: DataFrame, keys: list[str], lay: Layout, p: DetectorParams = DETECTOR) -> DataFrame:
    """How well peaks of a signal look like beats (null = fewer than three peaks)."""
    s = lay.with_quantiles(samples.select(*keys, "idx", "x", "fs"), keys, F.col("x"), {"_m": 0.5})
    s = s.withColumn("x", F.col("x") - F.col("_m")).drop("_m")
    noise = noise_mad(s, keys, lay)
    s = s.join(noise, keys)
    pk = find_peaks(
        s, keys + ["fs"], lay, min_prom=F.greatest(F.lit(0.002), 2.7 * F.col("noise_mad")),
        distance=F.greatest(F.lit(1), (p.orient_min_sep_s * F.col("fs")).cast("int")), min_width=F.lit(2.0),
    ).withColumn("width_s", F.col("width") / F.col("fs"))
    ok = (F.col("width_s") >= 0.008) & (F.col("width_s") <= 0.90)
    pk = settle(lay.with_aggs(pk, keys, _ok=F.count_if(ok)).where((F.col("_ok") < 3) | ok))
    # the strongest n_events peaks: ranked by value counts, not by collecting the group
    top = pk.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("prom"), F.desc("idx")))).where(F.col("_r") <= p.orient_n_events)
    top = top.groupBy(*keys).agg(F.median("prom").alias("top_prom"))
    width = lay.quantiles(pk, keys, F.col("width_s"), {"med_width_s": 0.5})
    n = s.groupBy(*keys).agg((F.count(F.lit(1)) / F.first("fs")).alias("dur"))
    g = pk.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peaks"))
    per = dominant_period(s, keys, lay).select(*keys, F.col("score").alias("periodicity"))
    out = n.join(noise, keys).join(per, keys).join(g, keys, "left").join(top, keys, "left").join(width, keys, "left")
    out = out.join(interbeat_cv(pk, keys, lay), keys, "left")
    snr = F.col("top_prom") / F.greatest(F.col("noise_mad"), F.lit(TINY))
    rate = F.col("n_peaks") / F.greatest(F.col("dur"), F.lit(1e-9))
    score = (
        1.4 * F.log1p(F.greatest(snr, F.lit(0.0))) + 0.9 * F.col("periodicity")
        + 0.5 * clip(F.col("med_width_s") / 0.22, 0.0, 2.0)
        - 1.6 * F.greatest(F.col("ibi_cv"), F.lit(0.0)) - 0.25 * F.greatest(F.lit(0.0), rate - 3.8)
    )
    return out.select(*keys, F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), F.when(F.col("n_peaks") >= 3, score).alias("polarity_score"))


def choose_polarity(samples: DataFrame, keys: list[str], lay: Layout, p: DetectorParams = DETECTOR) -> DataFrame:
    """Automatic sign: score both polarities; on a narrow margin, vote among the
    largest absolute peaks.  One row per key: ``invert, method, vote_conf`` ..."""
    fs = F.col("fs")
    s = lay.with_aggs(samples.select(*keys, "idx", "x", "fs"), keys, _len=F.count(F.lit(1)))
    edge = (p.orient_edge_s * fs).cast("int")
    edge = F.when(F.col("_len") < 2 * edge + 50, F.least(edge, F.floor(F.col("_len") / 10))).otherwise(edge)
    s = s.withColumn("_e", F.when(F.col("_len") - 2 * edge > 50, edge).otherwise(F.lit(0)))
    s = s.where((F.col("idx") >= F.col("_e")) & (F.col("idx") < F.col("_len") - F.col("_e")))
    s = s.withColumn("idx", (F.col("idx") - F.col("_e")).cast("int"))
    s = lay.with_quantiles(s, keys, F.col("x"), {"_m": 0.5}).withColumn("x", F.col("x") - F.col("_m"))
    ws = clip(F.col("_len") / F.greatest(fs, F.lit(1e-9)) * 0.35, 1.5, 8.0)
    s = rolling_trend(s, keys, lay, ws, 0.20)
    s = lay.with_quantiles(s, keys, F.col("trend"), {"_tm": 0.5})
    s = s.withColumn("x", F.col("x") - F.coalesce(F.col("trend") - F.col("_tm"), F.lit(0.0)))
    s = moving_average(s, keys, lay, p.orient_smooth_ms, 5)
    # read by the scores and the vote; rows of a short segment stay in order
    s = settle(s.withColumn("x", F.col("smooth")).drop("smooth"), None if lay.long else keys)
    both = s.withColumn("sgn", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("x", F.col("x") * F.col("sgn"))
    sc = polarity_score(both, keys + ["sgn"], lay, p)
    sc = sc.groupBy(*keys).pivot("sgn", [1, -1]).agg(F.first("polarity_score").alias("s"), F.first("n_peaks").alias("n"))
    sc = sc.select(*keys, F.col("1_s").alias("score_keep"), F.col("-1_s").alias("score_invert"), F.col("1_n").alias("n_pos"), F.col("-1_n").alias("n_neg"))
    mag = s.withColumn("v", F.col("x")).withColumn("x", F.abs("x"))
    mx = find_peaks(mag, keys + ["fs"], lay, min_prom=F.lit(None), distance=F.greatest(F.lit(1), (p.orient_min_sep_s * fs).cast("int")))
    mx = mx.join(s.select(*keys, "idx", F.col("x").alias("v")), keys + ["idx"])
    mx = lay.with_aggs(mx, keys, _np=F.count(F.lit(1))).where("_np >= 3")
    mx = mx.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("amp"), F.desc("idx")))).where(F.col("_r") <= p.orient_n_events)
    mx = mx.where("v <> 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("nv"), F.avg((F.col("v") > 0).cast("double")).alias("up"))
    med = F.signum(F.col("up") - 0.5)
    mx = mx.where("nv >= 3").select(
        *keys,
        F.when(med > 0, F.col("up")).when(med < 0, 1 - F.col("up")).otherwise(0.0).alias("vote_conf"),
        (med < 0).alias("vote_invert"),
    )
    out = sc.join(mx, keys, "left")
    keep, inv = F.col("score_keep"), F.col("score_invert")
    lo = F.lit(float("-inf"))
    gap = F.abs(F.coalesce(inv, lo) - F.coalesce(keep, lo))
    any_score = keep.isNotNull() | inv.isNotNull()
    better = F.coalesce(inv, lo) > F.coalesce(keep, lo)
    by_score = any_score & (gap >= 0.12)
    by_vote = F.coalesce(F.col("vote_conf") >= p.orient_conf_min, F.lit(False))
    return out.select(
        *keys, "score_keep", "score_invert", "n_pos", "n_neg", "vote_conf", F.when(any_score, gap).alias("score_gap"),
        F.when(by_score, better).when(by_vote, F.col("vote_invert")).when(any_score, better)
        .otherwise(F.coalesce("vote_invert", F.lit(False))).alias("invert"),
        F.when(by_score, "morphology_score").when(by_vote, "vote_tiebreak").when(any_score, "morphology_fallback")
        .otherwise("vote_fallback").alias("method"),
    )


def row_direction_override(choice: DataFrame, directions: DataFrame, keys: list[str]) -> DataFrame:
    """A weak polarity decision yields to a clear majority of trace directions."""
    d = choice.join(directions, keys, "left")
    weak = (F.col("method") != "morphology_score") | F.coalesce(F.col("score_gap") < 0.12, F.lit(False))
    clear = weak & (F.greatest("down_fraction", "up_fraction") >= 0.80)
    clear = F.coalesce(clear, F.lit(False))
    return d.withColumns({
        "invert": F.when(clear, F.col("down_fraction") >= F.col("up_fraction")).otherwise(F.col("invert")),
        "method": F.when(clear, "row_direction_prior").otherwise(F.col("method")),
        "vote_conf": F.when(clear, F.lit(None)).otherwise(F.col("vote_conf")),
    })


def _signed_peaks(c: dict) -> dict:
    """Upward and downward peaks of a whole signal around its median, those of each rate by themselves."""
    n, m = len(c["x"]), K.percentile(c["x"][c["_ok"].astype(bool)], 0.5)
    rows = np.flatnonzero(n >= c["_least"])
    out = {name: [] for name in ("sgn", "fs", "_n", "idx", "prom", "width")}
    c = {k: v[rows] for k, v in c.items()}
    x = c["x"] - (np.nan if m is None else m)
    noise = K.quiet_mad(x[c["_ok"].astype(bool)])
    least = K.or_least(None if noise is None else 2.8 * K.or_least(noise * MAD_SCALE, TINY), 0.010)
    for f in np.unique(c["fs"]):
        own = np.isnan(c["fs"]) if f != f else c["fs"] == f
        for sgn in (1, -1):
            _, at, prom, width = K.find_peaks_many(x[own] * sgn, np.array([0, own.sum()]), np.array([least]), c["_dist"][own][:1].astype(float), np.array([2.0]), np.array([np.nan]))
            made = (np.full(at.size, sgn), np.full(at.size, f), np.full(at.size, n), c["idx"][own][at], prom, width)
            for name, v in zip(out, made):
                out[name].append(v)
    return {k: np.concatenate(v) for k, v in out.items()} if out["idx"] else {}


def mixed_direction_flip(samples: DataFrame, keys: list[str], lay: Layout, p: DetectorParams = DETECTOR) -> DataFrame:
    """Do upward and downward peaks dominate different halves of the signal?"""
    fs = F.col("fs")
    kk = keys + ["sgn"]
    if lay.long:
        s = lay.with_quantiles(samples.select(*keys, "idx", "x", "fs"), keys, F.col("x"), {"_m": 0.5})
        s = settle(lay.with_aggs(s.withColumn("x", F.col("x") - F.col("_m")).drop("_m"), keys, _n=F.count(F.lit(1))))
        every = s.groupBy(*keys).agg(F.first("_n").alias("_n"))
        s = s.where(F.col("_n") >= F.greatest(F.lit(40), (0.8 * fs).cast("int")))
        s = settle(s.join(noise_mad(s, keys, lay), keys)).withColumn("sgn", F.explode(F.array(F.lit(1), F.lit(-1))))
        pk = find_peaks(
            s.withColumn("x", F.col("x") * F.col("sgn")), kk + ["fs", "_n"], lay, min_prom=F.greatest(F.lit(0.010), 2.8 * F.col("noise_mad")),
            distance=samples_of(0.10, fs), min_width=F.lit(2.0),
        )
    else:
        every = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        d = with_known(samples, *keys, "idx", "fs")
        d = d.withColumns({"_least": F.greatest(F.lit(40), (0.8 * fs).cast("int")), "_dist": samples_of(0.10, fs)})
        fields = [("sgn", "int"), ("fs", "double"), ("_n", "bigint"), ("idx", "int"), ("prom", "double"), ("width", "double")]
        pk = arrow_groups(d, keys, keys, fields, _signed_peaks)
    w = F.col("width") / F.greatest(fs, F.lit(1e-9))
    pk = settle(pk.where((w >= 0.014) & (w <= 0.80)))
    mid = F.floor(F.col("_n") / 2)
    g = pk.groupBy(*kk).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("idx") < mid).cast("double")).alias("early"))
    g = g.join(lay.quantile_table(pk, kk, prom=(F.col("prom"), 0.5), pos=(F.col("idx").cast("double"), 0.5)), kk)
    g = g.groupBy(*keys).pivot("sgn", [1, -1]).agg(
        *[F.first(c).alias(c) for c in ("n", "early", "prom", "pos")]
    )
    g = every.join(g, keys, "left")

    def c(sgn, name):
        return F.col(f"{sgn}_{name}")

    both = F.coalesce((c(1, "n") >= 2) & (c(-1, "n") >= 2), F.lit(False))
    rel = F.least(c(1, "prom"), c(-1, "prom")) / F.greatest(F.greatest(c(1, "prom"), c(-1, "prom")), F.lit(TINY))
    trans = F.greatest(c(1, "early") * (1 - c(-1, "early")), c(-1, "early") * (1 - c(1, "early")))
    spread = F.abs(c(1, "pos") - c(-1, "pos")) / F.greatest(F.col("_n").cast("double"), F.lit(1.0))
    zero = F.lit(0.0)
    g = g.select(
        *keys, F.when(both, trans).otherwise(zero).alias("flip_transition"), F.when(both, spread).otherwise(zero).alias("flip_spread"),
        F.when(both, rel).otherwise(zero).alias("flip_rel_strength"),
        F.coalesce(c(1, "n"), F.lit(0)).alias("n_pos"), F.coalesce(c(-1, "n"), F.lit(0)).alias("n_neg"), both.alias("_both"),
    )
    hit = (
        F.col("_both") & (F.col("flip_transition") >= p.qc_mixed_flip_transition_min)
        & (F.col("flip_spread") >= p.qc_mixed_flip_spread_min) & (F.col("flip_rel_strength") >= p.qc_mixed_flip_rel_strength_min)
    )
    return g.withColumn("flip_detected", hit).drop("_both")
