"""Secondary-event review: thresholds, candidates, items, decisions and merges.

Review tables are keyed by segment; parallel time/amplitude lists are only built
at the item boundary (one segment's own peaks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..params import REVIEW, REVIEW_SCHEMA_VERSION, ReviewParams
from ..sources.sessions import CORNERS
from .artifacts import mark_near
from .layout import Layout, Scan, half_even, samples_of
from .peaks import find_peaks, prominence_width
from .stats import fs_from_times

PART = 1 << 17  # rows of beats that are searched for peaks together


def lit(v: float | None) -> Column:
    return F.lit(v).cast("double")


def threshold_line(mode: Column | str, amp: Column, value: Column) -> Column:
    m = F.lower(F.trim(F.lit(mode) if isinstance(mode, str) else mode))
    return (
        F.when(m.isin("absolute", "fixed", "value"), value)
        .when(m.isin("fraction_of_main", "relative_to_main", "relative"), amp * value).otherwise(amp + value)
    )


def sloped_threshold(x: Column, x0: Column, x1: Column, left: Column, right: Column) -> Column:
    """Line between two corner values, clipped to the range; a reversed range swaps
    its ends, a zero-width range is the left value, a null range is null."""
    lo, hi = F.least(x0, x1), F.greatest(x0, x1)
    a = F.when(x1 < x0, right).otherwise(left)
    b = F.when(x1 < x0, left).otherwise(right)
    f = F.greatest(F.least((x - lo) / F.greatest(hi - lo, F.lit(1e-12)), F.lit(1.0)), F.lit(0.0))
    return F.when(x0.isNull() | x1.isNull(), lit(None)).when(x0 == x1, left).otherwise(a + f * (b - a))


def _limits(fs: Column, p: ReviewParams):
    w0 = samples_of(max(p.min_secondary_width_s, 0.0), fs)
    return w0, F.greatest(w0, half_even(F.lit(p.max_secondary_width_s) * fs)), samples_of(max(p.min_secondary_distance_s, 0.0), fs)


def window_candidates(samples: DataFrame, windows: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW, bucket_s: float = 1.0) -> DataFrame:
    """Secondary peaks inside each beat's own window.

    ``samples`` = ``keys, idx, t_s, x, fs``; ``windows`` = ``keys, beat, main_t,
    start_s, end_s, lower, upper``.  Bucketed range join, then peaks per beat.  Buckets
    double in width by level; a window is put on the level of its own width, where it
    meets at most two or three, and samples are keyed once for each level of their segment.
    """
    w = windows.select(
        *keys, "beat", "main_t", F.least("start_s", "end_s").alias("a"), F.greatest("start_s", "end_s").alias("b"),
        F.least("lower", "upper").alias("lo"), F.greatest("lower", "upper").alias("hi"),
    )
    w = w.withColumn("_lv", F.ceil(F.log2(F.greatest((F.col("b") - F.col("a")) / bucket_s, F.lit(1.0)))))
    step = bucket_s * F.pow(F.lit(2.0), F.col("_lv"))
    s = samples.select(*keys, "idx", "t_s", "x", "fs").join(w.select(*keys, "_lv").distinct(), keys)
    s = s.withColumn("_k", F.floor(F.col("t_s") / step))
    w = w.withColumn("_k", F.explode(F.sequence(F.floor(F.col("a") / step), F.floor(F.col("b") / step))))
    j = s.join(w, keys + ["_lv", "_k"]).where("t_s >= a and t_s <= b and t_s > main_t")
    kb = keys + ["beat"]
    w0, w1, dist = _limits(F.col("fs"), p)
    limits = dict(min_prom=F.lit(max(p.min_secondary_prominence, 0.0)), distance=dist, min_width=w0, max_width=w1)
    if lay.long:
        j = lay.with_aggs(j, kb, _n=F.count(F.lit(1))).where("_n >= 3")
        c = find_peaks(j, kb + ["fs"], lay, **limits)
    else:  # many beats share a group, of which the rows before each beat bound the size
        before = W.partitionBy(*keys).orderBy("beat").rangeBetween(W.unboundedPreceding, -1)
        j = j.withColumn("_part", F.floor(F.count(F.lit(1)).over(before) / PART))
        j = lay.with_aggs(j, kb, _n=F.count(F.lit(1))).where("_n >= 3")
        c = find_peaks(j, keys + ["_part", "fs"], lay, within="beat", lone=True, **limits).drop("_part")
    c = c.withColumn("width_s", F.col("width") / F.col("fs"))
    c = c.join(windows.select(*kb, F.least("lower", "upper").alias("lo"), F.greatest("lower", "upper").alias("hi")), kb)
    c = c.join(samples.select(*keys, "idx", "t_s"), keys + ["idx"])
    ok = (F.col("amp") >= F.col("lo")) & (F.col("amp") <= F.col("hi")) & F.col("width_s").between(p.min_secondary_width_s, p.max_secondary_width_s)
    return c.where(ok).select(*kb, "idx", "t_s", "amp", "prom", "width_s")


def beat_windows(mains: DataFrame, span: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW) -> DataFrame:
    """One review window per main peak, clipped to the signal (``span`` = ``keys,
    t_first, t_last``), with its two threshold lines in order."""
    m = lay.scan(mains.where("time_s is not null and amp is not null"), keys, ["time_s"], _r=Scan("rownum")).join(span, keys)
    t = F.col("time_s")
    lower = threshold_line(p.lower_line_mode, F.col("amp"), F.lit(p.default_lower_line_offset))
    upper = threshold_line(p.upper_line_mode, F.col("amp"), F.lit(p.default_upper_line_offset))
    m = m.select(
        *keys, (F.col("_r") - 1).alias("beat"), t.alias("main_t"), F.col("amp").alias("main_amp"),
        F.greatest(t + p.window_start_delay_s, "t_first").alias("start_s"), F.least(t + p.window_end_delay_s, "t_last").alias("end_s"),
        F.least(lower, upper).alias("lower"), F.greatest(lower, upper).alias("upper"),
    )
    return m.where("end_s > start_s")


def beat_items(mains: DataFrame, samples: DataFrame, span: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW) -> DataFrame:
    """Per-beat review items with their candidate lists."""
    w = beat_windows(mains, span, keys, lay, p)
    return refresh_beat_items(w, samples, keys, lay, p, p.only_review_windows_with_candidates or not p.review_all_main_peaks)


def refresh_beat_items(items: DataFrame, samples: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW, only_hits: bool = False) -> DataFrame:
    """Recompute the candidates of existing per-beat items."""
    c = window_candidates(samples, items, keys, lay, p)
    kb = keys + ["beat"]
    lists = c.groupBy(*kb).agg(F.array_sort(F.collect_list(F.struct(F.col("t_s").alias("t"), F.col("amp").alias("a")))).alias("candidates"))
    out = items.drop("candidates", "n_candidates").join(lists, kb, "inner" if only_hits else "left")
    none = F.array().cast("array<struct<t:double,a:double>>")
    out = out.withColumn("candidates", F.coalesce("candidates", none))
    return out.withColumns({"n_candidates": F.size("candidates"), "status": F.lit("pending")})


def segment_candidates(samples: DataFrame, items: DataFrame, mains: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW) -> DataFrame:
    """Secondary peaks of a segment between two sloped thresholds, away from mains.

    ``items`` = ``keys`` + corners and x-range; any null corner yields nothing.
    ``mains`` = ``keys, t_s``.
    """
    i = items.select(*keys, *CORNERS).where(" and ".join(f"{c} is not null" for c in CORNERS[:4]))
    s = lay.with_aggs(samples.select(*keys, "idx", "t_s", "x", "fs"), keys, _t0=F.min("t_s"), _t1=F.max("t_s")).join(i, keys)
    a, b = F.coalesce("x_start_s", "_t0"), F.coalesce("x_end_s", "_t1")
    s = s.withColumns({"_a": F.greatest("_t0", F.least(a, b)), "_b": F.least("_t1", F.greatest(a, b))})
    s = s.where((F.col("_b") > F.col("_a")) & F.col("t_s").between(F.col("_a"), F.col("_b")))
    s = lay.with_aggs(s, keys, _n=F.count(F.lit(1))).where("_n >= 3")
    w0, w1, dist = _limits(F.col("fs"), p)
    c = find_peaks(s, keys + ["fs", "_a", "_b"], lay, min_prom=F.lit(max(p.min_secondary_prominence, 0.0)), distance=dist, min_width=w0, max_width=w1)
    c = c.join(samples.select(*keys, "idx", "t_s"), keys + ["idx"]).join(i, keys).withColumn("width_s", F.col("width") / F.col("fs"))
    t = F.col("t_s")
    c = c.withColumns({
        "lower": sloped_threshold(t, F.col("_a"), F.col("_b"), F.col(CORNERS[0]), F.col(CORNERS[1])),
        "upper": sloped_threshold(t, F.col("_a"), F.col("_b"), F.col(CORNERS[2]), F.col(CORNERS[3])),
    })
    ok = F.col("amp").between(F.least("lower", "upper"), F.greatest("lower", "upper"))
    ok &= F.col("width_s").between(p.min_secondary_width_s, p.max_secondary_width_s)
    c = c.where(ok).select(*keys, "idx", "t_s", "amp", "prom", "width_s", "lower", "upper")
    if p.main_peak_exclusion_window_s <= 0:
        return c
    c = mark_near(c, mains.select(*keys, "t_s"), keys, lay, F.lit(p.main_peak_exclusion_window_s), "t_s", strict=True)
    return c.where(~F.col("near")).drop("near")


def signal_caps(samples: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW, use_config: bool = True) -> DataFrame:
    """Upper cap from the signal: configured value, else its quantile."""
    q = lay.quantiles(samples, keys, F.col("x"), {"_q": min(max(p.default_afc_upper_cap_quantile, 0.0), 1.0)})
    first = lit(p.default_afc_upper_cap_value) if use_config else lit(None)
    return q.select(*keys, F.coalesce(first, "_q", F.lit(p.default_afc_upper_cap_fallback)).alias("signal_cap"))


def upper_cap(metrics: DataFrame, caps: DataFrame, keys: list[str], p: ReviewParams = REVIEW) -> DataFrame:
    """First known of cap / upper line / thresholds, else the signal's cap."""
    names = ["afc_upper_cap", "upper_line", "upper_threshold", "strong_thr", "weak_thr"]
    known = [F.col(n) for n in names if n in metrics.columns] if p.prefer_report_upper_line else []
    d = metrics.join(caps, keys, "left")
    return d.select(*keys, F.coalesce(*known, "signal_cap", F.lit(p.default_afc_upper_cap_fallback)).alias("upper_cap"))


def normalize_range(items: DataFrame, span: DataFrame, caps: DataFrame, keys: list[str]) -> DataFrame:
    """Clamp and order the x-range to the signal and fill missing upper corners."""
    d = items.join(span, keys, "left").join(caps, keys, "left")
    a, b = F.coalesce("x_start_s", "t_first"), F.coalesce("x_end_s", "t_last")
    lo, hi = F.greatest("t_first", F.least(a, b)), F.least("t_last", F.greatest(a, b))
    known, empty = F.col("t_first").isNotNull(), hi <= lo
    ul = F.coalesce("afc_upper_left_value", "signal_cap")
    return d.withColumns({
        "x_start_s": F.when(~known, F.col("x_start_s")).when(empty, F.col("t_first")).otherwise(lo),
        "x_end_s": F.when(~known, F.col("x_end_s")).when(empty, F.col("t_last")).otherwise(hi),
        "afc_upper_left_value": F.when(known, ul).otherwise(F.col("afc_upper_left_value")),
        "afc_upper_right_value": F.when(known, F.coalesce("afc_upper_right_value", ul)).otherwise(F.col("afc_upper_right_value")),
    }).drop("t_first", "t_last", "signal_cap")


def refresh_segment_items(items: DataFrame, samples: DataFrame, mains: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW) -> DataFrame:
    """Normalise items and recompute their helper candidates (``helper`` list)."""
    span = time_span(samples, keys)
    d = normalize_range(items, span, signal_caps(samples, keys, lay, p), keys)
    c = segment_candidates(samples, d, mains, keys, lay, p)
    h = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("t_s").alias("t"), F.col("amp").alias("a")))).alias("helper"))
    none = F.array().cast("array<struct<t:double,a:double>>")
    return d.drop("helper").join(h, keys, "left").withColumn("helper", F.coalesce("helper", none))


def time_span(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.min("t_s").alias("t_first"), F.max("t_s").alias("t_last"))


def peaks_of_type(events: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """Peaks of one event type with a time, as rows ``keys, time_s, amp``."""
    return events.where((F.col("type") == kind) & F.col("time_s").isNotNull()).select(*keys, "time_s", "amp")


def peak_lists(events: DataFrame, keys: list[str], kind: str, name: str) -> DataFrame:
    p = peaks_of_type(events, keys, kind)
    return p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("time_s").alias("t"), F.col("amp").alias("a")))).alias(name))


def segment_items(events: DataFrame, metrics: DataFrame, samples: DataFrame, keys: list[str], lay: Layout, p: ReviewParams = REVIEW) -> DataFrame:
    """One review item per passing segment with at least one main peak."""
    m = metrics.where("qc_pass")
    cap = upper_cap(m, signal_caps(samples, keys, lay, p), keys, p)
    d = m.select(*keys).join(peak_lists(events, keys, "Main Beat", "main_peaks"), keys)
    d = d.join(peak_lists(events, keys, "Rescue", "rescue_peaks"), keys, "left").join(time_span(samples, keys), keys).join(cap, keys)
    none = F.array().cast("array<struct<t:double,a:double>>")
    return d.select(
        *keys,
        F.coalesce(lit(p.default_afc_lower_left_value), lit(p.default_afc_left_value)).alias(CORNERS[0]),
        F.coalesce(lit(p.default_afc_lower_right_value), lit(p.default_afc_right_value)).alias(CORNERS[1]),
        F.coalesce(lit(p.default_afc_upper_left_value), F.col("upper_cap")).alias(CORNERS[2]),
        F.coalesce(lit(p.default_afc_upper_right_value), F.col("upper_cap")).alias(CORNERS[3]),
        F.col("t_first").alias("x_start_s"), F.col("t_last").alias("x_end_s"), "main_peaks",
        F.coalesce("rescue_peaks", none).alias("rescue_peaks"), F.lit("pending").alias("status"),
    )


def assign_previous_main(points: DataFrame, mains: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """As-of join: 0-based ordinal of the last main at or before ``t_s``, else -1."""
    m = lay.scan(mains.where("t_s is not null").select(*keys, "t_s"), keys, ["t_s"], _r=Scan("rownum"))
    good = lay.neighbours(points.where("t_s is not null"), m, keys, ["_r"], "t_s")
    good = good.withColumn("main_peak_index", F.coalesce(F.col("prev._r") - 1, F.lit(-1))).drop("prev", "next")
    return good.unionByName(points.where("t_s is null").withColumn("main_peak_index", F.lit(-1)), allowMissingColumns=True)


def nearest_sample(points: DataFrame, samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Nearest join on time: adds ``near_idx, near_amp`` (first sample on ties)."""
    s = samples.select(*keys, "t_s", F.col("idx").alias("i"), F.col("x").alias("v"), F.col("t_s").alias("t"))
    d = lay.neighbours(points, s, keys, ["t", "i", "v"], "t_s")
    left = F.coalesce(F.col("t_s") - F.col("prev.t") <= F.col("next.t") - F.col("t_s"), F.col("prev").isNotNull())
    pick = F.when(left, F.col("prev")).otherwise(F.col("next"))
    return d.withColumns({"near_idx": pick["i"], "near_amp": pick["v"]}).drop("prev", "next")


def nearest_peak_features(points: DataFrame, samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Adds nearest amplitude, and ``prominence, width_s`` of that sample (null at the
    signal's ends)."""
    d = nearest_sample(points, samples, keys, lay)
    n = samples.groupBy(*keys).agg(F.max("idx").alias("_last"))
    at = d.where("near_idx is not null").select(*keys, F.col("near_idx").alias("idx"), F.col("near_amp").alias("amp")).distinct()
    at = at.join(n, keys).where("idx > 0 and idx < _last").drop("_last")
    shape = prominence_width(at, samples, keys, lay).join(fs_from_times(samples, keys, lay), keys)
    shape = shape.select(*keys, F.col("idx").alias("near_idx"), F.col("prom").alias("prominence"), (F.col("width") / F.col("fs_est")).alias("width_s"))
    return d.join(shape, keys + ["near_idx"], "left")


def time_key(t: Column) -> Column:
    return F.bround(t, 6)


def dedup_times(points: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Distinct on time rounded to six digits; the first occurrence stays."""
    d = points.where(F.col("t_s").isNotNull() & ~F.isnan("t_s")).withColumn("_k", time_key(F.col("t_s")))
    rest = [c for c in d.columns if c not in keys + ["_k"]]
    g = d.groupBy(*keys, "_k").agg(F.min_by(F.struct(*rest), order).alias("r"))
    return g.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def apply_point_log(log: DataFrame, keys: list[str]) -> DataFrame:
    """Replay point edits (``pos, op upsert|remove, t_s, amp``): last write per rounded
    time wins, removals delete it."""
    d = log.where(F.col("t_s").isNotNull() & ~F.isnan("t_s")).withColumn("_k", time_key(F.col("t_s")))
    g = d.groupBy(*keys, "_k").agg(F.max_by(F.struct("op", "t_s", "amp"), "pos").alias("r"))
    return g.where("r.op <> 'remove'").select(*keys, "r.t_s", "r.amp")


def align_amplitudes(points: DataFrame, samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Distinct points; missing amplitudes come from the nearest sample."""
    d = points.withColumn("_k", time_key(F.col("t_s")))
    known = d.where("amp is not null").groupBy(*keys, "_k").agg(F.max_by("amp", "pos").alias("_amp"))
    u = dedup_times(points.select(*keys, "t_s", "pos"), keys).withColumn("_k", time_key(F.col("t_s")))
    u = nearest_sample(u.join(known, keys + ["_k"], "left"), samples, keys, lay)
    return u.select(*keys, "t_s", F.coalesce("_amp", "near_amp").alias("amp"))


def point_rows(decisions: DataFrame, keys: list[str], column: Column, source: str) -> DataFrame:
    d = decisions.select(*keys, "review_id", "beat", F.posexplode(column).alias("pos", "t_s")) if "beat" in decisions.columns else \
        decisions.select(*keys, F.posexplode(column).alias("pos", "t_s"))
    return d.withColumn("source", F.lit(source))


def with_secondary(events: DataFrame, afc: DataFrame, keys: list[str]) -> DataFrame:
    """The event table with secondary events added; they carry source, review id and beat."""
    return events.unionByName(afc.select(
        *keys, "time_s", F.lit("AFC").alias("type"), F.col("amplitude").alias("amp"), F.col("prominence").alias("prom"), "width_s", "source",
        "review_id", "main_peak_index",
    ), allowMissingColumns=True)


def merge_beat_decisions(segments: DataFrame, decisions: DataFrame, events: DataFrame, samples: DataFrame, keys: list[str], lay: Layout):
    """Per-beat decisions -> ``(afc_events, events_with_afc, review_log)``.

    Matches segments by number, then by name.  Accepted and manually added times
    become events unless the decision is skipped.
    """
    s = segments.select(*keys, F.col("segment_name").alias("_name"))
    by_no = decisions.withColumn("_own", F.col("segment_index")).withColumnRenamed("segment_index", keys[-1]).join(s, keys, "left")
    unmatched = by_no.where("_name is null").drop("_name", keys[-1])
    alt = unmatched.join(s.withColumn("segment_name", F.col("_name")), keys[:-1] + ["segment_name"])
    d = by_no.where("_name is not null").unionByName(alt).withColumn("segment_name", F.col("_name")).drop("_name")
    d = d.withColumns({"review_id": F.concat_ws(":", "_own", "main_peak_index"), "beat": F.col("main_peak_index")}).drop("_own")
    lists = {}
    pieces = []
    for col, src in (("accepted_times_s", "auto_accepted"), ("manual_added_times_s", "manual_added"), ("rejected_times_s", "rejected")):
        pts = dedup_times(point_rows(d, keys, F.col(col), src), keys + ["review_id", "beat"])
        lists[col] = pts.groupBy(*keys, "review_id").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list("t_s")), lambda v: F.format_string("%.6f", v)), ",").alias(col)
        )
        pieces.append(pts)
    log = d.drop(*lists)
    for col, t in lists.items():
        log = log.join(t, keys + ["review_id"], "left").fillna("", [col])
    live = d.where(F.lower("status") != "skipped").select(*keys, "review_id", "segment_name")
    pts = pieces[0].unionByName(pieces[1]).join(live, keys + ["review_id"])
    e = nearest_peak_features(pts, samples, keys, lay)
    e = e.select(
        *keys, "segment_name", F.col("beat").alias("main_peak_index"), F.col("t_s").alias("time_s"), F.col("near_amp").alias("amplitude"),
        "source", "prominence", "width_s", "review_id",
    )
    return e, with_secondary(events, e, keys), log


def curated_times(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Manual points of segment decisions: the current list, else the older two."""
    empty = F.array().cast("array<double>")
    now = F.coalesce("manual_afc_times_s", empty)
    old = F.concat(F.coalesce("manual_added_times_s", empty), F.coalesce("accepted_times_s", empty))
    return dedup_times(point_rows(decisions, keys, F.when(F.size(now) > 0, now).otherwise(old), "manual_curated"), keys)


def merge_segment_decisions(segments: DataFrame, decisions: DataFrame, events: DataFrame, samples: DataFrame, keys: list[str], lay: Layout):
    """Segment decisions -> ``(afc_events, events_with_afc, review_log)``."""
    d = decisions.join(segments.select(*keys, F.col("segment_name").alias("_n")), keys)
    d = d.withColumn("segment_name", F.col("_n")).drop("_n")
    pts = curated_times(d, keys)
    empty = F.array().cast("array<double>")
    pairs = [(c + "_times_s", c + "_amps") for c in ("manual_afc", "manual_added", "accepted")]
    known = None
    for rank, (tc, ac) in enumerate(pairs):
        z = F.arrays_zip(F.coalesce(tc, empty).alias("t"), F.coalesce(ac, empty).alias("a"))
        k = d.select(*keys, F.posexplode(z).alias("pos", "z")).select(
            *keys, F.struct(F.lit(rank).alias("r"), "pos").alias("o"), time_key(F.col("z.t")).alias("_k"), F.col("z.a").alias("a"))
        known = k if known is None else known.unionByName(k)
    known = known.where("_k is not null and a is not null and not isnan(a) and abs(a) < double('infinity')").groupBy(*keys, "_k").agg(F.max_by("a", "o").alias("a"))
    logged = pts.withColumn("_k", time_key(F.col("t_s"))).join(known, keys + ["_k"], "left")
    item = F.array_sort(F.collect_list(F.struct("t_s", "a")))
    logged = logged.groupBy(*keys).agg(item.alias("z")).select(
        *keys, F.array_join(F.transform("z", lambda e: F.format_string("%.6f", e["t_s"])), ",").alias("manual_afc_times_s"),
        F.array_join(F.transform("z", lambda e: F.coalesce(F.when(e["a"].isNotNull(), F.format_string("%.6f", e["a"])), F.lit(""))), ",").alias("manual_afc_amps"),
    )
    log = d.select(*keys, "segment_name", *CORNERS, "status").join(logged, keys, "left").fillna("", ["manual_afc_times_s", "manual_afc_amps"])
    live = d.where(F.lower("status") != "skipped").select(*keys, "segment_name")
    mains = peaks_of_type(events, keys, "Main Beat").select(*keys, F.col("time_s").alias("t_s"))
    a = assign_previous_main(pts.join(live, keys).select(*keys, "segment_name", "t_s", "source"), mains, keys, lay)
    a = nearest_peak_features(a, samples, keys, lay)
    afc = a.select(
        *keys, "segment_name", "main_peak_index", F.col("t_s").alias("time_s"), F.col("near_amp").alias("amplitude"), "source",
        "prominence", "width_s", F.col(keys[-1]).cast("string").alias("review_id"),
    )
    return afc, with_secondary(events, afc, keys), log


def resume_items(current: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Current peaks win; reviewer lists and status come from the saved session;
    thresholds only when its schema version is the current one."""
    lists = [c for c in saved.columns if c.startswith(("helper_", "auto_", "manual_")) and c in current.columns]
    sv = saved.select(*keys, "schema_version", *[F.col(c).alias(f"_s_{c}") for c in lists + CORNERS + ["status"]])
    d = current.join(sv, keys, "left")
    has, same = F.col("schema_version").isNotNull(), F.trim("schema_version") == REVIEW_SCHEMA_VERSION
    out = {c: F.when(has, F.col(f"_s_{c}")).otherwise(F.col(c)) for c in lists + ["status"]}
    out |= {c: F.when(F.coalesce(same, F.lit(False)), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in CORNERS}
    return d.withColumns(out).select(*current.columns)


def resume_decisions(saved: DataFrame) -> DataFrame:
    """Saved decisions lose their thresholds when the schema version differs."""
    same = F.trim("schema_version") == REVIEW_SCHEMA_VERSION
    return saved.withColumns({c: F.when(same, F.col(c)) for c in CORNERS})


def apply_status(items: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """pending without a decision, else skipped or completed."""
    d = decisions.groupBy(*keys).agg(F.max_by(F.lower("status"), F.col("pos") if "pos" in decisions.columns else F.lit(0)).alias("_d"))
    st = F.when(F.col("_d").isNull(), "pending").when(F.col("_d") == "skipped", "skipped").otherwise("completed")
    return items.join(d, keys, "left").withColumn("status", st).drop("_d")
