"""Every operator bound to the given tables, as ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators import artifacts as V, events as E, peaks as P, quality as Q, report as G, review as R, select as S, stats as A, stitch as T
from ..operators.layout import Layout, Scan, scratch_root, settle
from ..params import DETECTOR, REVIEW
from ..sources import sessions as J, tables as IO
from .bindings import SEG, embedding_traces, events_signal, lineitem_signal, table
from .detect import analyze_traces, split_valid

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- shared inputs --------------------------------------------------------------
def spiky(spark, sf):
    """A heavy-tailed signal: reciprocal prices, so single samples stick out."""
    s, lay = lineitem_signal(spark, sf)
    return s.withColumn("x", 0.001 / (F.col("x") - 0.0089)), lay


def with_tid(s: DataFrame) -> DataFrame:
    return s.withColumn("tid", F.floor(F.col("idx") / 100).cast("int"))


def li_bounds(s: DataFrame) -> DataFrame:
    b = with_tid(s).groupBy("segment_no", "tid").agg((F.max("idx") + 1).alias("e"))
    return b.select("segment_no", "tid", (F.col("tid") + 1).alias("tr_no"), (F.col("tid") * 100).alias("s"), F.col("e").cast("int").alias("e"))


def li_raw(spark, sf, valleys=False):
    s, lay = lineitem_signal(spark, sf)
    s = settle(s)
    raw = P.peaks_per_transient(with_tid(s), SEG, lay)
    if valleys:
        raw = settle(raw)
        raw = settle(S.with_valleys(raw, s, SEG, lay))
    return s, raw, lay


def li_mains(spark, sf, valleys=False):
    """Raw peaks and those with prominence >= 0.5 as a stand-in for main peaks."""
    s, raw, lay = li_raw(spark, sf, valleys)
    raw = settle(raw) if not valleys else raw
    return s, raw, raw.where("prom >= 0.5"), lay


def seg_const(s: DataFrame, **cols) -> DataFrame:
    return s.select("segment_no").distinct().withColumns({n: F.lit(v) for n, v in cols.items()})


def review_signal(spark, sf):
    """Events with their time: mains = purchase, candidates = error."""
    s, lay = events_signal(spark, sf, ("event_type",))
    return s.withColumn("t_s", F.unix_micros("ts") / 1e6).drop("ts"), lay


def user_features(spark, sf) -> DataFrame:
    """One feature row per user, derived from its events."""
    e = table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").alias("segment_no")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("ne"),
        F.count_if(F.col("event_type") == "view").alias("nv"), F.count_if(F.col("event_type") == "click").alias("nc"),
        F.count_if(F.col("event_type") == "purchase").alias("np"), F.max("value").alias("mx"),
    )
    down = F.col("nv") / (F.col("nv") + F.col("nc"))
    return g.select(
        "segment_no", (F.col("n") % 15).cast("bigint").alias("n_rows"),
        F.when(F.col("segment_no") % 7 != 0, F.col("np") / 20.0).alias("corr_med"),
        (F.col("ne") / 4.0).alias("snr"), (F.col("nc") / 40.0).alias("periodicity"), ((F.col("n") % 11) / 100.0).alias("spike_fraction"),
        (F.col("mx") / 10.0).alias("early_strength"), (F.col("nv") / 8.0).alias("late_strength"), (F.col("np") / 80.0).alias("late_periodicity"),
        down.alias("down_fraction"), (1 - down).alias("up_fraction"), (F.col("ne") / 30.0).alias("transition"),
        (F.col("segment_no") % 5 == 0).alias("flip_detected"), (F.col("ne") / 30.0).alias("flip_transition"), (F.col("nv") / 60.0).alias("flip_spread"),
        (F.col("np") / 20.0).alias("flip_rel_strength"), (F.col("n") % 13).cast("bigint").alias("n_vertical"),
        (F.col("n") % 23).cast("bigint").alias("n_main"), (F.col("ne") / 20.0).alias("ibi_cv"), (F.col("nv") / 200.0).alias("main_amp_med"),
        (F.col("nc") / 300.0).alias("main_prom_med"), (F.col("n") % 4).cast("bigint").alias("n_rescue_only"), F.col("mx").alias("mx"),
    )


def user_events(spark, sf) -> DataFrame:
    """Events renamed to the event table's columns: purchase = main, signup = rescue."""
    s, lay = review_signal(spark, sf)
    kind = F.when(F.col("event_type") == "purchase", "Main Beat").when(F.col("event_type") == "signup", "Rescue")
    e = s.withColumn("type", kind).where("type is not null")
    return e.select("segment_no", "idx", F.col("t_s").alias("time_s"), "type", F.col("x").alias("amp"), (F.col("x") / 2).alias("prom"),
                    (F.col("x") / 100).alias("width_s"), (F.col("idx") % 7).cast("int").alias("transient")), s, lay


def user_segments(spark, sf) -> DataFrame:
    f = user_features(spark, sf)
    return f.select(
        "segment_no", F.concat(F.lit("PixelCorrelation Segment "), F.col("segment_no")).alias("segment"), (F.col("n_main") % 3 != 0).alias("qc_pass"),
        F.when(F.col("n_main") % 3 != 0, "pass").otherwise("too_few_rows").alias("qc_reason"), "n_main", (F.col("n_main") - F.col("n_rescue_only")).alias("n_main_primary"),
        F.col("n_rescue_only").alias("n_rescue"), F.concat(F.lit(" "), (F.col("segment_no") % 9).cast("string"), F.lit(".0 ")).alias("sample_id"),
    )


def user_decisions(spark, sf) -> DataFrame:
    """One review decision per user: manual points are its 'error' times."""
    s, lay = review_signal(spark, sf)
    err = s.where("event_type = 'error'")
    z = err.groupBy("segment_no").agg(F.array_sort(F.collect_list(F.struct(F.col("t_s"), F.col("x")))).alias("z"))
    t, a = F.transform("z", lambda e: e["t_s"]), F.transform("z", lambda e: e["x"])
    odd = F.col("segment_no") % 2 == 1
    none = F.array().cast("array<double>")
    return z.select(
        "segment_no", F.concat(F.lit("PixelCorrelation Segment "), F.col("segment_no")).alias("segment_name"),
        *[F.lit(v).alias(c) for c, v in zip(J.CORNERS[:4], (1.0, 2.0, 30.0, 40.0))],
        F.lit(0.0).alias("x_start_s"), F.lit(10.0).alias("x_end_s"),
        F.when(odd, t).otherwise(none).alias("manual_afc_times_s"), F.when(odd, a).otherwise(none).alias("manual_afc_amps"),
        F.when(odd, none).otherwise(t).alias("manual_added_times_s"), F.when(odd, none).otherwise(a).alias("manual_added_amps"),
        none.alias("accepted_times_s"), none.alias("accepted_amps"),
        F.when(F.col("segment_no") % 5 == 0, "skipped").otherwise("saved").alias("status"),
    ), s, lay


# ---- sources and sinks ------------------------------------------------------------
def sheet_rows(spark, sf) -> DataFrame:
    """Embeddings exported as wide sheets (trace ids as text, one missing cell)."""
    t = embedding_traces(spark, sf)
    cols = [F.when((F.lit(i) != 3) | (F.col("row_no") % 4 != 0), F.element_at("y", i + 1)).alias(f"y {i}") for i in range(64)]
    return t.select(
        F.lit("emb").alias("recording_id"), F.concat(F.lit(" PixelCorrelation Segment "), F.col("segment_no"), F.lit(" ")).alias("sheet_name"),
        "row_no", *cols, F.when(F.col("row_no") > 1, F.lit("250")).otherwise("n/a").alias("Sampling Frequency"),
        F.col("begin_s").alias("Begin"), F.concat(F.lit("T-"), F.col("tid"), F.lit("b")).alias("Transientnumber"),
    )


@query
def s1_trace_scan(spark, sf):
    t = IO.scan_traces(settle(sheet_rows(spark, sf)))
    t = T.compact(t)
    return t.select("segment_no", "row_no", "tid", "fs", "t0", F.round("begin_s", 6).alias("begin_s"), F.size("y").alias("n"),
                    F.round(F.array_max("y"), 6).alias("y_max"), F.round(F.element_at("y", 4), 6).alias("y4"))


@query
def s2_segment_catalogue(spark, sf):
    e = table(spark, sf, "events").select("user_id").distinct()
    kind = F.when(F.col("user_id") % 3 == 0, "Summary ").otherwise(" PixelCorrelation  Segment ")
    d = IO.catalogue(e.select(F.concat(kind, F.col("user_id"), F.lit(" ")).alias("sheet_name")))
    return d.select("sheet_name", "kind", "segment_no")


def _id_rows(spark, sf):
    s, _ = events_signal(spark, sf, ("props",))
    k = F.get_json_object("props", "$.k").cast("int")
    sid = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("  ")).when(k % 2 == 0, F.concat((k % 10).cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("S"), k % 10))
    return s.select("segment_no", F.col("idx").alias("row_no"), sid.alias(" Sample ID "))


@query
def s3a_first_sample_id(spark, sf):
    return IO.first_sample_id(_id_rows(spark, sf), SEG)


@query
def s3b_frequent_sample_id(spark, sf):
    return IO.frequent_sample_id(_id_rows(spark, sf), SEG)


def _fresh(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _session_rows(spark, sf):
    d, s, lay = user_decisions(spark, sf)
    d = d.withColumn("segment_index", F.col("segment_no").cast("int"))
    return d


@query
def s4_session_json(spark, sf):
    d = _session_rows(spark, sf)
    path = _fresh(spark, "session")
    items = d.select("segment_no", "segment_index", "segment_name", *J.CORNERS, "status", F.col("manual_afc_times_s").alias("manual_added_times_s"))
    doc = J.session_documents(items, d.drop("segment_no").withColumn("segment_no", F.col("segment_index")), F.lit("events"), ["segment_no"])
    J.write_sessions(doc, path)
    back = J.read_sessions(spark, path, multi_line=False)
    out = None
    for kind, rows in (("item", J.upgrade_items(back, [])), ("decision", J.upgrade_decisions(back, []))):
        one = rows.select(
            F.lit(kind).alias("kind"), "segment_index", "segment_name", "status", "schema_version", *J.CORNERS,
            *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("manual_afc_times_s", "manual_afc_amps", "manual_added_times_s")],
        )
        out = one if out is None else out.unionByName(one)
    return out


@query
def s5_afc_events_csv(spark, sf):
    s, lay = review_signal(spark, sf)
    e = s.where("event_type = 'error'").select(
        F.concat(F.lit("Segment "), F.col("segment_no")).alias("segment_name"), F.col("segment_no").alias("segment_index"), F.lit(0).alias("main_peak_index"),
        F.col("t_s").alias("time_s"), F.col("x").alias("amplitude"), F.lit("manual_curated").alias("source"), F.col("segment_no").cast("string").alias("review_id"))
    path = _fresh(spark, "afc")
    IO.write_afc_events(e, path)
    return spark.read.schema(e.schema).csv(path, header=True)


@query
def s6_review_log_csv(spark, sf):
    d = _session_rows(spark, sf).drop("afc_lower_left_value", "afc_upper_left_value", "afc_upper_right_value")
    d = d.withColumns({"lower_line": F.lit(1.5), "afc_upper_cap": F.lit(9.0)})
    path = _fresh(spark, "log")
    IO.write_review_log(d, path)
    cols = "segment_name string, segment_index int, afc_lower_left_value double, afc_lower_right_value double, afc_upper_left_value double, " \
           "afc_upper_right_value double, x_start_s double, x_end_s double, manual_afc_times_s string, manual_afc_amps string, status string"
    return spark.read.schema(cols).csv(path, header=True)


@query
def s7_peak_trace_tables(spark, sf):
    tr = _audit_rows(spark, sf)
    root = _fresh(spark, "trace")
    IO.write_peak_trace(tr, G.peak_trace_summary(tr, SEG), root, None)
    rows, total = spark.read.parquet(f"{root}/peak_debug"), spark.read.parquet(f"{root}/peak_debug_summary")
    rows = rows.select("segment_no", "peak_index_raw", F.round("time_s", 8).alias("time_s"), F.round("amplitude", 8).alias("amplitude"), "transient_index", "stage_first_seen", "final_label", "rejection_reason")
    return rows.join(total, "segment_no")


@query
def s8_result_set(spark, sf):
    e, s, lay = user_events(spark, sf)
    d, _, _ = user_decisions(spark, sf)
    seg = user_segments(spark, sf)
    root = _fresh(spark, "results")
    IO.write_result_set(root, G.segment_summary(seg, 1.0, 10.0), e, e.where("type = 'Rescue'"), d.select("segment_no", "manual_afc_times_s", "status"))
    back = IO.read_result_set(spark, root)
    none, name = F.lit(0.0), F.concat(F.lit("PixelCorrelation Segment "), F.col("segment_no"))
    one = F.count(F.lit(1))
    parts = {
        "summary": back["summary"].select("segment", F.col("total_detected_events").alias("n"), F.round("bpm_user", 6).alias("total"), F.concat_ws(" ", "qc", "qc_reason").alias("label")),
        "main_events": back["main_events"].groupBy(name.alias("segment"), F.col("type").alias("label")).agg(one.alias("n"), F.round(F.sum("amp"), 6).alias("total")),
        "afc_events": back["afc_events"].groupBy(name.alias("segment"), F.col("type").alias("label")).agg(one.alias("n"), F.round(F.sum("prom"), 6).alias("total")),
        "review_log": back["review_log"].groupBy(name.alias("segment"), F.concat(F.col("status"), F.lit(" "), F.lit(len(back["review_log"].columns))).alias("label")).agg(one.alias("n"), none.alias("total")),
    }
    out = None
    for n, df in parts.items():
        df = df.select(F.lit(n).alias("table_name"), "segment", "n", "total", "label")
        out = df if out is None else out.unionByName(df)
    return out


@query
def s9_failure_routing(spark, sf):
    t = embedding_traces(spark, sf)
    seg = F.col("segment_no")
    t = t.withColumns({
        "y": F.when(seg == 1, F.lit(None)).when(seg == 2, F.array().cast("array<double>")).otherwise(F.col("y")),
        "fs": F.when(seg == 3, 0.0).otherwise(F.col("fs")),
    })
    good, bad = split_valid(t, SEG)
    return bad.unionByName(good.select("segment_no").distinct().withColumn("qc_reason", F.lit("ok")))


# ---- stitching ------------------------------------------------------------------
def traces(spark, sf, begin=True):
    t = embedding_traces(spark, sf, begin)
    return t, Layout.measure(t, SEG, weight=F.size("y"))


@query
def t1_compaction(spark, sf):
    t, _ = traces(spark, sf)
    y = F.transform("y", lambda v: F.when(v > 0.1, F.lit(float("nan"))).when(v > 0.05, F.lit(None)).otherwise(v))
    d = T.compact(t.withColumn("y", y))
    return d.select("segment_no", "row_no", F.posexplode("y").alias("pos", "v")).withColumn("v", F.round("v", 7))


@query
def t2_trace_direction(spark, sf):
    return T.trace_direction(traces(spark, sf)[0]).select("segment_no", "row_no", "direction")


@query
def t3_direction_stats(spark, sf):
    t, lay = traces(spark, sf)
    d = T.direction_stats(t, SEG, lay)
    return rounded(d, 6, "down_fraction", "up_fraction", "row_direction_transition_score")


@query
def t4_both_polarities(spark, sf):
    s, _ = events_signal(spark, sf)
    return T.both_polarities(s).groupBy("segment_no", "polarity").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"), F.max("x").alias("top"))


@query
def t5_align_by_begin(spark, sf):
    t, lay = traces(spark, sf)
    return T.align(t, SEG, lay).select("segment_no", "row_no", "start", "end")


@query
def t6_align_by_overlap(spark, sf):
    t, lay = traces(spark, sf, False)
    return T.align(t, SEG, lay, overlap=14).select("segment_no", "row_no", "start", "end")


@query
def t6_sheet_overlap(spark, sf):
    """Segments of two kinds of sheets: the overlap comes with the traces."""
    t, lay = traces(spark, sf, False)
    t = t.withColumn("overlap", F.when(F.col("segment_no") % 3 == 0, 5).otherwise(14))
    return T.align(t, SEG, lay).select("segment_no", "row_no", "start", "end")


@query
def t7_partition_bounds(spark, sf):
    t, lay = traces(spark, sf)
    return T.partition_bounds(T.align(t, SEG, lay), SEG, lay).select("segment_no", "tid", "tr_no", "s", "e", "overlap")


def levelled(spark, sf):
    t, lay = traces(spark, sf)
    return T.level_offsets(T.align(t, SEG, lay), SEG, lay), lay


@query
def t8_level_offsets(spark, sf):
    return levelled(spark, sf)[0].select("segment_no", "row_no", F.round("delta", 6).alias("delta"))


@query
def t9_blend(spark, sf):
    return T.blend(levelled(spark, sf)[0], SEG).select("segment_no", "idx", F.round("x", 6).alias("x"))


def covered(spark, sf):
    d, lay = levelled(spark, sf)
    return settle(T.blend(d, SEG)), lay


@query
def t10_gap_ranges(spark, sf):
    c, lay = covered(spark, sf)
    return T.gap_ranges(c, SEG, lay)


@query
def t11_gap_fill(spark, sf):
    c, lay = covered(spark, sf)
    return T.fill_gaps(c, SEG, lay).select("segment_no", "idx", "in_gap", F.round("x", 6).alias("x"))


@query
def t12_baseline_shift(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(A.baseline_shift(s, SEG, lay), 10, "x").drop("fs")


@query
def t13_stitch(spark, sf):
    st = T.stitch(traces(spark, sf)[0], SEG)
    return rounded(st.metrics, 6, "max_offset", "median_offset", "time_origin_s").drop("fs", "t0")


@query
def t14_map_transients(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    b = li_bounds(s).where("tid % 4 <> 2")
    return T.map_transients(s, b, SEG, lay).select("segment_no", "idx", "tid")


@query
def t15_map_noise(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    s = settle(s)
    b = settle(T.transient_noise(s, li_bounds(s).where("tid % 4 <> 2"), SEG, lay))
    return T.map_noise(s, b, SEG, lay).select("segment_no", "idx", F.round("noise", 8).alias("noise"))


@query
def t16_time_axis(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return s.select("segment_no", "idx", F.round(12.5 + F.col("idx") / F.col("fs"), 6).alias("t_s"))


@query
def t17_segment_number(spark, sf):
    d = table(spark, sf, "supplier")
    name = F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")).otherwise(F.concat(F.lit("x Segment  "), F.col("s_suppkey"), F.lit(" Segment 9")))
    return d.select("s_suppkey", IO.segment_number(name).alias("segment_index"))


# ---- statistics -----------------------------------------------------------------
@query
def a1_noise_mad(spark, sf):
    s, lay = events_signal(spark, sf)
    return rounded(A.noise_mad(s, SEG, lay), 6, "noise_mad")


@query
def a2_global_snr(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(A.global_snr(s, SEG, lay), 6, "snr", "noise_mad", "signal_mad")


@query
def a3_spike_fraction(spark, sf):
    s, lay = spiky(spark, sf)
    return rounded(A.spike_fraction(s, SEG, lay), 9, "spike_fraction")


@query
def a4_moving_average(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return A.moving_average(s, SEG, lay, 28.0).select("segment_no", "idx", F.round("smooth", 9).alias("smooth"))


@query
def a5_rolling_trend(spark, sf):
    s, lay = events_signal(spark, sf)
    return A.rolling_trend(s, SEG, lay).select("segment_no", "idx", F.round("trend", 6).alias("trend"))


@query
def a6_remove_drift(spark, sf):
    s, lay = events_signal(spark, sf)
    s = s.withColumn("x", F.col("x") + F.when(F.col("segment_no") % 3 == 0, 0).otherwise(4 * F.col("idx")))
    d, m = A.remove_drift(s, SEG, lay)
    m = m.select("segment_no", "drift_detected", "applied", F.round("drift_ratio", 6).alias("drift_ratio"), F.round("trend_time_corr", 6).alias("trend_time_corr"))
    return d.select("segment_no", "idx", F.round("x", 6).alias("x")).join(m, "segment_no")


@query
def a7_dominant_period(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(A.dominant_period(s, SEG, lay), 6, "period_s", "score")


@query
def a8_trace_correlation(spark, sf):
    return rounded(Q.trace_correlation(traces(spark, sf)[0], SEG), 6, "corr_med")


@query
def a9_mixed_direction_flip(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    s = s.withColumn("x", F.when(F.col("idx") < 300, F.col("x")).otherwise(-F.col("x")) * 0.5 + 0.5)
    return rounded(A.mixed_direction_flip(s, SEG, lay), 6, "flip_transition", "flip_spread", "flip_rel_strength")


@query
def a10_structure_features(spark, sf):
    t, _ = traces(spark, sf)
    st = T.stitch(t, SEG)
    tl = Layout.measure(t, SEG)
    s = settle(T.stitched_signal(st, SEG))
    f = Q.structure_features(s, t, T.direction_stats(t, SEG, tl), Q.trace_correlation(t, SEG), SEG, st.layout, tl)
    return rounded(f, 5, "snr", "noise_mad", "signal_mad", "periodicity", "period_s", "early_strength", "late_strength", "late_periodicity", "corr_med",
                   "transition", "flip_transition", "flip_spread", "flip_rel_strength", "spike_fraction", "down_fraction", "up_fraction")


@query
def a11_interbeat_cv(spark, sf):
    s, lay = review_signal(spark, sf)
    return rounded(A.interbeat_cv(s.where("event_type = 'purchase'"), SEG, lay), 6, "ibi_cv")


@query
def a12_quality_score(spark, sf):
    f = user_features(spark, sf)
    return f.select("segment_no", F.round(A.quality_score(F.col("snr"), F.col("n_main"), F.col("corr_med")), 6).alias("quality_score"))


@query
def a13_fs_from_times(spark, sf):
    s, lay = review_signal(spark, sf)
    s = s.withColumn("t_s", F.col("t_s") - 1704067200)
    return rounded(A.fs_from_times(s, SEG, lay), 9, "fs_est")


@query
def a14_polarity_score(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(A.polarity_score(s, SEG, lay), 6, "polarity_score")


@query
def a15_choose_polarity(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(A.choose_polarity(s, SEG, lay), 6, "score_keep", "score_invert", "score_gap", "vote_conf")


@query
def a16_row_direction_override(spark, sf):
    f = user_features(spark, sf)
    c = f.select("segment_no", "flip_detected", F.when(F.col("n_main") % 3 == 0, "morphology_score").otherwise("vote_fallback").alias("method"),
                 (F.col("n_main") % 2 == 0).alias("invert"), F.col("snr").alias("score_gap"), F.col("ibi_cv").alias("vote_conf")).drop("flip_detected")
    d = f.select("segment_no", F.least(F.col("n_main") / 20.0, F.lit(1.0)).alias("down_fraction"))
    d = d.withColumn("up_fraction", 1 - F.col("down_fraction"))
    return A.row_direction_override(c, d, SEG).select("segment_no", "invert", "method", F.round("vote_conf", 6).alias("vote_conf"))


@query
def a17_orientation_sanity(spark, sf):
    f = user_features(spark, sf).withColumns({"qc_pass": F.col("n_rows") > 3, "quality_score": F.col("snr"), "n_rescue": F.col("n_rescue_only")})
    return f.select("segment_no", F.round(Q.orientation_sanity(f), 6).alias("sanity_score"))


# ---- artifacts --------------------------------------------------------------------
@query
def v1_vertical_lines(spark, sf):
    s, lay = spiky(spark, sf)
    return V.vertical_lines(s, SEG, lay)


@query
def v2_vertical_repair(spark, sf):
    s, lay = spiky(spark, sf)
    s = settle(s)
    return V.repair_vertical_lines(s, V.vertical_lines(s, SEG, lay), SEG, lay).select("segment_no", "idx", "repaired", F.round("x", 9).alias("x"))


@query
def v3_discontinuities(spark, sf):
    s, lay = spiky(spark, sf)
    return V.discontinuities(s, SEG, lay)


@query
def v4_exclude_near_discontinuities(spark, sf):
    s, lay = spiky(spark, sf)
    s = settle(s)
    pk = P.local_maxima(s, SEG, lay).withColumn("fs", F.lit(250.0))
    return V.drop_near_discontinuities(pk, V.discontinuities(s, SEG, lay), SEG, lay).select("segment_no", "idx")


@query
def v5_exclude_in_gaps(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    g = li_bounds(s).where("tid % 3 = 1").select("segment_no", (F.col("s") + 10).alias("s"), (F.col("e") - 20).alias("e")).where("e > s")
    return V.drop_in_gaps(P.local_maxima(s, SEG, lay), g, SEG, lay).select("segment_no", "idx")


@query
def v6_needle_spikes(spark, sf):
    s, lay = spiky(spark, sf)
    s = settle(s)
    pk = P.local_maxima(s, SEG, lay).select("segment_no", "idx", F.col("amp").alias("prom"), F.lit(0.01).alias("width_s"))
    return V.mark_needles(pk, s, SEG, lay).select("segment_no", "idx", "needle")


# ---- quality control ----------------------------------------------------------------
@query
def q1_mixed_orientation(spark, sf):
    d = Q.mixed_orientation(user_features(spark, sf))
    terms = ["mixed_minor", "mixed_minor_term", "mixed_transition_term", "mixed_periodicity_term", "mixed_corr_term", "mixed_score"]
    return rounded(d, 6, *terms).select("segment_no", *terms, "mixed_gate", "mixed_reject")


@query
def q2_segment_qc(spark, sf):
    return Q.segment_qc(user_features(spark, sf)).select("segment_no", "qc_reason", "qc_pass")


@query
def q3_late_gates(spark, sf):
    return Q.late_gates(user_features(spark, sf)).select("segment_no", "late_reason")


@query
def q4_early_exit(spark, sf):
    f = user_features(spark, sf)
    n = F.col("n_main")
    f = f.select(
        "segment_no", n.alias("n_samples"), F.when(n > 1, n).alias("n_raw"), F.when(n > 3, n).alias("n_after_spike"), F.when(n > 5, n).alias("n_survivors"),
        F.when(n > 7, n).alias("n_candidates"), n.alias("n_main_dedup"), (F.col("n_rows") % 4).alias("n_transients"), (n != 9).alias("qc_pass"),
        F.when(n == 9, "too_few_rows").otherwise("pass").alias("qc_reason"))
    return Q.early_exit(f).select("segment_no", "exit_reason")


@query
def q5_plausibility(spark, sf):
    f = user_features(spark, sf)
    return f.select("segment_no", Q.plausible(F.col("n_rows") > 3, F.col("n_main"), F.col("snr")).alias("plausible"))


@query
def q6_select_polarity(spark, sf):
    f = user_features(spark, sf)
    c = f.select("segment_no", F.explode(F.array(F.lit(1), F.lit(-1))).alias("polarity"), "n_rows", "snr", "n_main", "n_vertical")
    up = F.col("polarity") == 1
    c = c.select("segment_no", "polarity", F.when(up, F.col("n_rows") > 5).otherwise(F.col("n_rows") > 8).alias("qc_pass"),
                 F.when((up & (F.col("n_main") % 3 > 0)) | (~up & (F.col("n_main") % 4 > 0)), F.when(up, F.col("n_main")).otherwise(F.col("n_vertical")).cast("double")).alias("quality_score"),
                 "n_main", "snr")
    return Q.select_polarity(c, SEG)


# ---- peaks -------------------------------------------------------------------------
@query
def p1a_local_maxima(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    s = s.withColumn("x", F.round("x", 1))
    return P.local_maxima(s, SEG, lay)


@query
def p1b_distance(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(P.thin_peaks(P.local_maxima(s, SEG, lay), SEG, lay, F.lit(5.0)), 7, "amp")


@query
def p1c_prominence(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    d = P.find_peaks(s, SEG, lay, min_prom=F.lit(None), distance=F.lit(1))
    return d.select("segment_no", "idx", F.round("prom", 7).alias("prom"))


@query
def p1d_half_width(spark, sf):
    s, lay = events_signal(spark, sf)
    d = P.find_peaks(s, SEG, lay, min_prom=F.lit(None), distance=F.lit(1))
    return d.select("segment_no", "idx", F.round("width", 6).alias("width"))


@query
def p2_raw_peaks(spark, sf):
    s, lay = lineitem_signal(spark, sf)
    return rounded(P.raw_peaks(s, SEG, lay), 7, "amp", "prom", "width_s").drop("fs")


@query
def p3_peaks_per_transient(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    return rounded(raw, 7, "amp", "prom", "width_s").drop("fs")


@query
def p4_thresholds(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    return rounded(S.thresholds(raw, SEG, lay), 10, "strong_thr", "weak_thr", "p95", "p50", "small_med", "small_mad")


def _adjusted(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    raw = settle(raw)
    m = A.noise_mad(s, SEG, lay).withColumns({
        "noise_mad": F.when(F.col("segment_no") % 3 == 0, 0.6).otherwise(F.col("noise_mad") / 10), "drift_ratio": (F.col("segment_no") % 50) / 47.3,
        "applied": F.col("segment_no") % 2 == 0})
    return raw, S.adjust_thresholds(S.thresholds(raw, SEG, lay), raw, m, SEG, lay)


@query
def p5_adjust_thresholds(spark, sf):
    return rounded(_adjusted(spark, sf)[1].select("segment_no", "strong_thr", "weak_thr", "retried"), 10, "strong_thr", "weak_thr")


@query
def p6_main_candidates(spark, sf):
    raw, t = _adjusted(spark, sf)
    return raw.join(t.select("segment_no", "strong_thr"), "segment_no").where("prom >= strong_thr").select("segment_no", "idx")


@query
def p7_refractory_dedup(spark, sf):
    s, raw, m, lay = li_mains(spark, sf, True)
    return S.refractory_dedup(raw, raw.where("prom >= 0.3"), SEG, lay)


@query
def p8_cluster_dedup(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    return S.cluster_dedup(raw, SEG, lay)


@query
def p9_prune_short_gaps(spark, sf):
    s, raw, m, lay = li_mains(spark, sf, True)
    return S.prune_short_gaps(raw, raw.where("prom >= 0.2"), SEG, lay)


@query
def p10_prune_local_weak(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    return S.prune_local_weak(raw, SEG, lay)


@query
def p11_prune_interbeat_tiny(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    return S.prune_interbeat_tiny(raw, SEG, lay)


@query
def p12_mains_replaced_by_rescue(spark, sf):
    s, raw, m, c, b, lay = _rescue_inputs(spark, sf, "prom >= 0.94 and tid % 3 <> 1")
    rescues = settle(S.rescue_peaks(c, m, b, SEG, lay))
    f = F.when(F.col("idx") % 2 == 0, 0.4).otherwise(1.0)  # every other main is weak
    return S.mains_replaced_by_rescue(m.withColumns({n: F.col(n) * f for n in ("amp", "prom", "width_s")}), rescues, SEG, lay)


@query
def p13_fill_large_gaps(spark, sf):
    s, raw, m, lay = li_mains(spark, sf)
    raw = raw.withColumn("width_s", F.col("width_s") * 6)
    seg = seg_const(raw, strong_thr=0.5, periodicity=0.8, corr_med=None).withColumn("corr_med", F.when(F.col("segment_no") % 4 != 0, F.col("segment_no") / 60.0))
    return S.fill_large_gaps(raw, raw.where("prom >= 0.5 and tid % 5 not in (2, 3)"), seg, SEG, lay)


@query
def p14_second_lobes(spark, sf):
    s, raw, m, lay = li_mains(spark, sf, True)
    raw = raw.withColumn("width_s", F.col("width_s") * 6)
    return S.second_lobes(raw, raw.where("prom >= 0.7"), seg_const(raw, strong_thr=0.7), SEG, lay)


@query
def p15_transient_coherence(spark, sf):
    s, raw, m, lay = li_mains(spark, sf)
    raw = raw.withColumn("width_s", F.col("width_s") * 6)
    mains = S.refractory_dedup(S.with_valleys(raw, s, SEG, lay), raw.where("prom >= 0.5 and tid % 5 <> 3"), SEG, lay)
    seg = seg_const(raw, strong_thr=0.5, periodicity=0.8).withColumn("corr_med", F.lit(None).cast("double"))
    return S.transient_coherence(raw, raw.join(settle(mains), ["segment_no", "idx"], "left_semi"), li_bounds(s), seg, SEG, lay).select("segment_no", "idx", "change")


def _rescue_inputs(spark, sf, main="prom >= 0.5 and tid % 3 <> 1"):
    s, raw, m, lay = li_mains(spark, sf)
    return s, raw, raw.where(main), raw.where(f"not ({main})"), li_bounds(s), lay


@query
def p16_rescue_peaks(spark, sf):
    s, raw, m, c, b, lay = _rescue_inputs(spark, sf)
    d = S.rescue_peaks(c, m, b, SEG, lay)
    return rounded(d, 8, "amp", "prom", "width_s", "amp_rel", "prom_rel", "width_rel", "gap_before_s", "gap_after_s").drop("fs")


@query
def p16a_rescue_windows(spark, sf):
    s, raw, m, c, b, lay = _rescue_inputs(spark, sf)
    pace = S.rescue_pace(m, b, SEG, lay)
    g = S.rescue_gap_windows(m, pace, SEG, lay).select("segment_no", F.lit("large_gap").alias("type"), *[F.col(c).cast("bigint").alias(c) for c in ("l", "r", "center")])
    n = s.groupBy("segment_no").agg(F.count(F.lit(1)).alias("n"))
    bb = b.join(b.groupBy("segment_no").agg(F.max("tr_no").alias("t")), "segment_no").where("tr_no < t").join(n, "segment_no").join(pace, "segment_no")
    bb = bb.select("segment_no", F.lit("boundary").alias("type"), F.greatest(F.lit(0), F.col("e") - F.col("win_n")).cast("bigint").alias("l"),
                   F.least(F.col("n") - 1, F.col("e") + F.col("win_n")).cast("bigint").alias("r"), F.col("e").cast("bigint").alias("center"))
    return g.unionByName(bb)


@query
def p16b_rescue_candidates(spark, sf):
    s, raw, lay = li_raw(spark, sf)
    s = settle(s)
    return rounded(S.rescue_candidates(s, raw, SEG, lay), 7, "amp", "prom", "width_s").drop("fs")


def _assigned(spark, sf):
    s, raw, m, c, b, lay = _rescue_inputs(spark, sf)
    pace = settle(S.rescue_pace(m, b, SEG, lay))
    return S.assign_windows(c, b, S.rescue_gap_windows(m, pace, SEG, lay), pace, m, SEG, lay), m, lay


@query
def p16c_assign_windows(spark, sf):
    return _assigned(spark, sf)[0].select("segment_no", "idx", F.col("win.type").alias("type"), F.col("win.center").alias("center"), F.col("win.d").alias("dist"))


@query
def p16d_local_reference(spark, sf):
    c, m, lay = _assigned(spark, sf)
    d = S.local_reference(settle(c), m, SEG)
    return rounded(d, 9, "ref_prom", "ref_amp", "ref_width").select("segment_no", "idx", "ref_prom", "ref_amp", "ref_width")


def _scored(spark, sf):
    c, m, lay = _assigned(spark, sf)
    return settle(S.acceptable_rescues(S.local_reference(settle(c), m, SEG))), lay


@query
def p16e_acceptable_rescues(spark, sf):
    d, _ = _scored(spark, sf)
    return rounded(d, 6, "amp_rel", "prom_rel", "width_rel", "gap_before_s", "gap_after_s", "score").select(
        "segment_no", "idx", "amp_rel", "prom_rel", "width_rel", "gap_before_s", "gap_after_s", "score")


@query
def p16f_greedy_accept(spark, sf):
    d, lay = _scored(spark, sf)
    return S.greedy_accept(d, SEG, lay).select("segment_no", "idx")


@query
def p17_build_events(spark, sf):
    s, raw, m, c, b, lay = _rescue_inputs(spark, sf)
    r = settle(S.rescue_peaks(c, m, b, SEG, lay))
    e = E.build_events(m, r, raw, seg_const(raw, time_origin_s=2.5), SEG)
    return rounded(e, 8, "time_s", "amp", "prom", "width_s", *[c for c in E.EVENT_COLS if c.startswith("rescue_") and c != "rescue_type"]).drop("idx")


def _audit_rows(spark, sf):
    s, raw, m, lay = li_mains(spark, sf)
    i = F.col("idx")
    raw = raw.withColumns({"time_s": i / 250.0, "survived": i % 7 != 0, "in_gap": i % 14 == 0, "strong_thr": F.lit(0.5)})

    def st(cond, name):
        return raw.where(cond).select("segment_no", "idx", F.lit(name).alias("stage"))

    stages = st("prom >= 0.45 and idx % 7 <> 0", "candidate")
    for cond, name in (("prom >= 0.55 and idx % 7 <> 0", "dedup"), ("prom >= 0.6 and idx % 7 <> 0", "final_main"), ("idx % 11 = 1", "rescue"),
                       ("idx % 13 = 2", "removed"), ("idx % 17 = 3", "promoted_gap"), ("idx % 19 = 4", "promoted_transient")):
        stages = stages.unionByName(st(cond, name))
    return E.peak_trace(raw, stages, SEG, lay)


@query
def p18_peak_trace(spark, sf):
    return rounded(_audit_rows(spark, sf), 8, "time_s", "amplitude", "prominence", "width_s").drop("idx")


@query
def p19_beat_totals(spark, sf):
    s, raw, m, c, b, lay = _rescue_inputs(spark, sf)
    t = E.beat_totals(m, settle(S.rescue_peaks(c, m, b, SEG, lay)), SEG, lay)
    t = E.score_totals(t.withColumns({"noise_mad": F.lit(0.05), "duration_s": F.lit(2.4)}))
    return rounded(t, 9, "ibi_cv", "main_prom_med", "main_amp_med", "bpm", "prom_snr", "quality_score")


@query
def p20_detection_candidates(spark, sf):
    r = analyze_traces(beating_embedding_traces(spark, sf), SEG)
    return rounded(r.candidates, 6, "quality_score", "periodicity", "ibi_cv", "prom_snr")


def beating_embedding_traces(spark, sf):
    """Embedding traces on top of one smooth bump per trace (something to detect)."""
    t = embedding_traces(spark, sf)
    bump = F.transform("y", lambda v, i: v * 0.02 + 0.3 * F.exp(-(i - 25.0) * (i - 25.0) / 60.0))
    return t.withColumns({"y": bump, "fs": F.lit(50.0), "begin_s": F.col("begin_s") * 5})


@query
def p21_segment_analysis(spark, sf):
    r = analyze_traces(beating_embedding_traces(spark, sf), SEG)
    return r.segments.select("segment_no", "polarity", "qc_pass", "qc_reason", "n_main", "n_main_primary", "n_rescue", F.round("bpm", 6).alias("bpm"))


# ---- whole jobs ------------------------------------------------------------------
def beating_sheets(spark, sf):
    """The same traces as exported sheets, half of the segments in another recording."""
    t = beating_embedding_traces(spark, sf)
    cols = [F.element_at("y", i + 1).alias(f"y {i}") for i in range(64)]
    return t.select(
        F.when(F.col("segment_no") % 2 == 0, "even").otherwise("odd").alias("recording_id"), F.concat(F.lit("PixelCorrelation Segment "), F.col("segment_no")).alias("sheet_name"),
        "row_no", *cols, F.col("fs").alias("Sampling Frequency"), F.col("begin_s").alias("Begin"), F.col("tid").alias("Transientnumber"), (F.col("segment_no") % 7).cast("string").alias("Sample ID"),
    )


@query
def w1_automatic_job(spark, sf):
    from .jobs import analyze_sheets

    return rounded(analyze_sheets(settle(beating_sheets(spark, sf)), _fresh(spark, "job"), 1.0, 60.0, with_trace=True), 6, "bpm_user", "detected_total_expected_ratio", "average_prom", "average_amp")


@query
def w2_review_job(spark, sf):
    """The reviewer marked a point a quarter second after the start of every third trace."""
    from .jobs import review_sheets

    sheets = settle(beating_sheets(spark, sf))
    marks = sheets.where("row_no % 3 = 1").groupBy("recording_id", IO.segment_number(F.col("sheet_name")).alias("segment_index")).agg(F.array_sort(F.collect_list(F.col("Begin") + 0.25)).alias("t"))
    d = marks.select("recording_id", F.struct(
        "segment_index", F.lit(0.0).alias("x_start_s"), F.lit(60.0).alias("x_end_s"), F.col("t").alias("manual_afc_times_s"),
        F.when(F.col("segment_index") % 5 == 0, "skipped").otherwise("saved").alias("status")).alias("d"))
    docs = d.groupBy("recording_id").agg(F.collect_list("d").alias("decisions"))
    docs = docs.select(F.to_json(F.struct(F.lit("afc_segment_manual_v3").alias("schema_version"), F.col("recording_id").alias("input_workbook"), "decisions")).alias("doc"))
    session = docs.select(F.from_json("doc", J.SESSION_SCHEMA).alias("d")).select("d.*")
    root = _fresh(spark, "review")
    review_sheets(sheets, root, session, 1.0, 60.0)
    back = IO.read_result_set(spark, root)
    n = back["afc_events"].groupBy("recording_id", "segment_no").agg(F.count(F.lit(1)).alias("n_afc"), F.sum("time_s").alias("t_sum"))
    return rounded(back["summary"].select("recording_id", "segment_no", "segment", "qc", "qc_reason", "sample_id").join(n, ["recording_id", "segment_no"], "left"), 6, "t_sum")


# ---- review ----------------------------------------------------------------------
@query
def r1_threshold_line(spark, sf):
    e = table(spark, sf, "events")
    mode = F.when(F.col("event_type") == "view", " Absolute").when(F.col("event_type") == "click", "relative").otherwise("offset_from_main")
    return e.select("event_id", F.round(R.threshold_line(mode, F.col("value"), F.lit(0.35)), 6).alias("line"))


@query
def r2_sloped_threshold(spark, sf):
    s, lay = events_signal(spark, sf)
    a = F.when(F.col("segment_no") % 4 == 0, F.lit(None)).otherwise((F.col("segment_no") % 30).cast("double"))
    b = (F.col("segment_no") % 7 * 10).cast("double")
    return s.select("segment_no", "idx", F.round(R.sloped_threshold(F.col("idx").cast("double"), a, b, F.lit(2.0), F.col("x")), 6).alias("thr"))


def _review_samples(spark, sf):
    """Lineitem signal on a 250/s time axis with mains every 60 samples."""
    s, lay = lineitem_signal(spark, sf)
    s = s.withColumn("t_s", F.col("idx") / 250.0)
    return s, s.where("idx % 60 = 7"), lay


def _windows(spark, sf):
    s, m, lay = _review_samples(spark, sf)
    m = m.select("segment_no", F.col("t_s").alias("time_s"), F.col("x").alias("amp"))
    span = R.time_span(s, SEG)
    return s, m, span, lay


@query
def r3_window_candidates(spark, sf):
    s, m, span, lay = _windows(spark, sf)
    s = settle(s)
    c = R.window_candidates(s, R.beat_windows(m, span, SEG, lay).withColumn("lower", F.lit(0.1)), SEG, lay)
    return rounded(c, 7, "t_s", "amp", "prom", "width_s")


@query
def r4_beat_items(spark, sf):
    s, m, span, lay = _windows(spark, sf)
    s = settle(s)
    d = R.beat_items(m, s, span, SEG, lay)
    return rounded(d, 9, "main_t", "main_amp", "start_s", "end_s", "lower", "upper").drop("candidates")


@query
def r5_refresh_beat_items(spark, sf):
    s, m, span, lay = _windows(spark, sf)
    s = settle(s)
    w = R.beat_windows(m, span, SEG, lay).withColumns({"lower": F.lit(0.2), "upper": F.lit(0.95)})
    d = R.refresh_beat_items(w, s, SEG, lay)
    return d.select("segment_no", "beat", "n_candidates", F.round(F.aggregate("candidates", F.lit(0.0), lambda acc, c: acc + c["t"]), 6).alias("t_sum"))


def _segment_corners(s):
    seg = s.select("segment_no").distinct()
    k = F.col("segment_no")
    return seg.select(
        "segment_no", F.lit(0.2).alias(J.CORNERS[0]), F.when(k % 6 != 0, 0.4).alias(J.CORNERS[1]), F.lit(0.9).alias(J.CORNERS[2]), F.lit(1.05).alias(J.CORNERS[3]),
        F.when(k % 3 == 0, 2.0).when(k % 3 == 1, 0.1).alias("x_start_s"), F.when(k % 3 == 0, 0.3).alias("x_end_s"))


@query
def r6_segment_candidates(spark, sf):
    s, m, lay = _review_samples(spark, sf)
    s = settle(s)
    c = R.segment_candidates(s, _segment_corners(s), s.where("idx % 60 = 7"), SEG, lay)
    return rounded(c, 7, "t_s", "amp", "prom", "width_s", "lower", "upper")


@query
def r7_refresh_segment_items(spark, sf):
    s, m, lay = _review_samples(spark, sf)
    s = settle(s)
    i = _segment_corners(s).withColumn(J.CORNERS[2], F.when(F.col("segment_no") % 2 == 0, 0.9)).withColumn(J.CORNERS[1], F.lit(0.4))
    d = R.refresh_segment_items(i, s, s.where("idx % 60 = 7"), SEG, lay)
    return d.select("segment_no", *[F.round(c, 10).alias(c) for c in J.CORNERS], F.size("helper").alias("n_helper"))


@query
def r8_segment_items(spark, sf):
    e, s, lay = user_events(spark, sf)
    m = user_segments(spark, sf).select("segment_no", "qc_pass", F.when(F.col("n_main") % 2 == 0, F.col("n_main") / 10.0).alias("strong_thr"))
    d = R.segment_items(e, m, s, SEG, lay)
    return d.select("segment_no", F.round(J.CORNERS[2], 6).alias("upper_left"), F.round("x_start_s", 6).alias("x_start_s"), F.round("x_end_s", 6).alias("x_end_s"),
                    F.size("main_peaks").alias("n_main"), F.size("rescue_peaks").alias("n_rescue"), F.round(F.element_at("main_peaks", 1)["a"], 6).alias("first_amp"))


@query
def r9_upper_cap(spark, sf):
    s, lay = events_signal(spark, sf)
    m = user_features(spark, sf).select("segment_no", F.when(F.col("n_main") % 3 == 0, F.col("snr")).alias("upper_line"), F.when(F.col("n_main") % 3 == 1, F.col("mx")).alias("weak_thr"))
    return rounded(R.upper_cap(m, R.signal_caps(s, SEG, lay), SEG), 6, "upper_cap")


@query
def r10_peaks_of_type(spark, sf):
    e, s, lay = user_events(spark, sf)
    return R.peaks_of_type(e, SEG, "Main Beat").select("segment_no", F.round("time_s", 6).alias("time_s"), "amp")


@query
def r11_previous_main(spark, sf):
    s, lay = review_signal(spark, sf)
    p = s.where("event_type = 'error'").select("segment_no", "t_s", F.col("idx").alias("point"))
    return R.assign_previous_main(p, s.where("event_type = 'purchase'"), SEG, lay).select("segment_no", "point", "main_peak_index")


def _probe(spark, sf):
    s, lay = review_signal(spark, sf)
    s = settle(s)
    p = s.where("event_type = 'error'").select("segment_no", (F.col("t_s") + 777.25).alias("t_s"), F.col("idx").alias("point"))
    return s, p, lay


@query
def r12_nearest_sample(spark, sf):
    s, p, lay = _probe(spark, sf)
    return R.nearest_sample(p, s, SEG, lay).select("segment_no", "point", "near_idx", "near_amp")


@query
def r13_nearest_peak_features(spark, sf):
    s, p, lay = _probe(spark, sf)
    d = R.nearest_peak_features(p, s, SEG, lay)
    return d.select("segment_no", "point", "near_idx", F.round("prominence", 6).alias("prominence"))


@query
def r14_dedup_times(spark, sf):
    s, lay = review_signal(spark, sf)
    p = s.select("segment_no", F.col("idx").alias("pos"), F.when(F.col("idx") % 9 != 0, F.round(F.col("x"), 0) + F.col("idx") * 1e-9).alias("t_s"))
    return R.dedup_times(p, SEG).select("segment_no", "pos", F.round("t_s", 6).alias("t_s"))


@query
def r15_point_log(spark, sf):
    s, lay = review_signal(spark, sf)
    p = s.select("segment_no", F.col("idx").alias("pos"), F.round(F.col("x"), 0).alias("t_s"), F.col("x").alias("amp"),
                 F.when(F.col("event_type") == "error", "remove").otherwise("upsert").alias("op"))
    return R.apply_point_log(p, SEG)


@query
def r15_align_amplitudes(spark, sf):
    s, lay = review_signal(spark, sf)
    s = settle(s)
    p = s.where("event_type = 'error'").select("segment_no", F.col("idx").alias("pos"), F.col("t_s"), F.when(F.col("idx") % 2 == 0, F.col("x") + 1).alias("amp"))
    d = R.align_amplitudes(p, s, SEG, lay)
    return rounded(d, 6, "t_s", "amp")


def _beat_decisions(spark, sf):
    s, lay = review_signal(spark, sf)
    s = settle(s)
    t = F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", F.col("t_s"))))
    u = F.array_sort(F.collect_list(F.when(F.col("event_type") == "view", F.col("t_s"))))
    v = F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("t_s"))))
    d = s.groupBy(F.col("segment_no").alias("segment_index")).agg(t.alias("accepted_times_s"), u.alias("manual_added_times_s"), v.alias("rejected_times_s"))
    k = F.col("segment_index")
    d = d.withColumns({
        "segment_name": F.concat(F.lit("PixelCorrelation Segment "), k), "main_peak_index": (k % 4).cast("int"),
        "status": F.when(k % 5 == 0, "Skipped").otherwise("saved"), "segment_index": F.when(k % 9 == 0, -k).otherwise(k)})
    return d, s, lay


@query
def r16_merge_beat_decisions(spark, sf):
    d, s, lay = _beat_decisions(spark, sf)
    seg = user_segments(spark, sf).select("segment_no", F.col("segment").alias("segment_name"))
    e, _, log = R.merge_beat_decisions(seg, d, user_events(spark, sf)[0], s, SEG, lay)
    return e.select("segment_no", "segment_name", "main_peak_index", F.round("time_s", 6).alias("time_s"), "amplitude", "source", "review_id",
                    F.round("prominence", 6).alias("prominence"))


@query
def r16_merged_events(spark, sf):
    """The event table after the merge: mains and rescues with the secondary events added."""
    d, s, lay = _beat_decisions(spark, sf)
    seg = user_segments(spark, sf).select("segment_no", F.col("segment").alias("segment_name"))
    _, merged, _ = R.merge_beat_decisions(seg, d, user_events(spark, sf)[0].drop("idx"), s, SEG, lay)
    return merged.select("segment_no", F.round("time_s", 6).alias("time_s"), "type", "amp", F.round("prom", 6).alias("prom"), "transient",
                         "source", "review_id", "main_peak_index")


@query
def r17_merge_segment_decisions(spark, sf):
    d, s, lay = user_decisions(spark, sf)
    s = settle(s)
    e, _, _ = user_events(spark, sf)
    seg = user_segments(spark, sf).select("segment_no", F.col("segment").alias("segment_name"))
    afc, merged, log = R.merge_segment_decisions(seg, settle(d), e, s, SEG, lay)
    return afc.select("segment_no", "segment_name", "main_peak_index", F.round("time_s", 6).alias("time_s"), "amplitude", "source", "review_id",
                      F.round("prominence", 6).alias("prominence"))


def _documents(spark, sf):
    """Session documents of three field generations, one per user, as JSON text."""
    f = user_features(spark, sf)
    k = F.col("segment_no")
    name = F.concat(F.lit("Segment "), k)
    v = F.round(F.col("mx"), 2)
    now = F.to_json(F.struct(name.alias("segment_name"), k.alias("segment_index"), v.alias("afc_lower_left_value"), F.lit(0.0).alias("x_start_s"), F.lit(9.0).alias("x_end_s"),
                             F.array(v).alias("manual_afc_times_s"), F.lit("completed").alias("status")))
    mid = F.to_json(F.struct(name.alias("segment_name"), k.alias("segment_index"), v.alias("lower_line"), (v + 1).alias("afc_upper_cap"), F.lit(1.0).alias("x_start_s"),
                             F.array(v, v + 1).alias("accepted_times_s")))
    old = F.to_json(F.struct(name.alias("segment_name"), k.alias("segment_index"), v.alias("lower_line"), (v + 2).alias("upper_line"), v.alias("main_peak_time_s"),
                             F.lit(3.0).alias("window_start_s"), F.array(v).alias("manual_added_times_s")))
    item = F.when(k % 3 == 0, now).when(k % 3 == 1, mid).otherwise(old)
    ver = F.when(k % 3 == 0, "afc_segment_manual_v3").otherwise("old")
    return f.select(F.concat(F.lit('{"schema_version":"'), ver, F.lit('","items":['), item, F.lit('],"decisions":['), item, F.lit("]}")).alias("doc"))


def _parsed(spark, sf):
    return _documents(spark, sf).select(F.from_json("doc", J.SESSION_SCHEMA).alias("d")).select("d.*")


@query
def r18_upgrade_items(spark, sf):
    d = J.upgrade_items(_parsed(spark, sf), [])
    return d.select("segment_index", "segment_name", "status", *J.CORNERS, F.size("main_peak_times_s").alias("n_main"), F.size("manual_afc_times_s").alias("n_manual"),
                    F.size("accepted_times_s").alias("n_accepted"))


@query
def r18_upgrade_decisions(spark, sf):
    d = J.upgrade_decisions(_parsed(spark, sf), [])
    return d.select("segment_index", "status", *J.CORNERS, F.size("manual_afc_times_s").alias("n_manual"), F.size("accepted_times_s").alias("n_accepted"))


@query
def r19_resume_session(spark, sf):
    saved = J.upgrade_items(_parsed(spark, sf), []).where("segment_index % 4 <> 1")
    cur = user_features(spark, sf).select(F.col("segment_no").cast("int").alias("segment_index"), *[F.lit(float(i)).alias(c) for i, c in enumerate(J.CORNERS)],
                                          F.array(F.lit(5.0)).alias("main_peak_times_s"), F.array().cast("array<double>").alias("manual_afc_times_s"), F.lit("pending").alias("status"))
    d = R.resume_items(cur, saved, ["segment_index"])
    return d.select("segment_index", *J.CORNERS, "status", F.size("manual_afc_times_s").alias("n_manual"), F.size("main_peak_times_s").alias("n_main"))


@query
def r19_resume_decisions(spark, sf):
    d = R.resume_decisions(J.upgrade_decisions(_parsed(spark, sf), []))
    return d.select("segment_index", "status", *J.CORNERS, F.size("manual_afc_times_s").alias("n_manual"), F.size("accepted_times_s").alias("n_accepted"))


@query
def r20_apply_status(spark, sf):
    i = user_features(spark, sf).select("segment_no")
    d = i.where("segment_no % 3 <> 0").withColumn("status", F.when(F.col("segment_no") % 2 == 0, "Skipped").otherwise("saved"))
    return R.apply_status(i, d, SEG)


@query
def r21_normalize_range(spark, sf):
    s, m, lay = _review_samples(spark, sf)
    i = _segment_corners(s).withColumn(J.CORNERS[2], F.when(F.col("segment_no") % 2 == 0, 0.9)).withColumn("x_end_s", F.when(F.col("segment_no") % 5 == 0, -3.0).otherwise(F.col("x_end_s")))
    d = R.normalize_range(i, R.time_span(s, SEG), R.signal_caps(s, SEG, lay, use_config=False), SEG)
    return rounded(d, 10, *J.CORNERS)


# ---- reports ----------------------------------------------------------------------
@query
def g1_segment_summary(spark, sf):
    return rounded(G.segment_summary(user_segments(spark, sf), 1.5, 10.0), 9, "bpm_user", "detected_total_expected_ratio")


@query
def g2_main_events(spark, sf):
    e, s, lay = user_events(spark, sf)
    r = e.where("type = 'Rescue'").select("segment_no", "time_s", "type", "amp", F.lit(0.5).alias("prom"), F.lit(0.25).alias("width_s"))
    d = G.main_events_table(e, r, user_segments(spark, sf), SEG)
    return rounded(d, 6, "time_s", "prom", "width_s")


@query
def g3_rescue_rows(spark, sf):
    s, m, lay = _review_samples(spark, sf)
    s = settle(s)
    d = G.rescue_rows(P.local_maxima(s, SEG, lay), s, SEG, lay)
    return rounded(d, 7, "time_s", "amp", "prom", "width_s")


@query
def g4_afc_events(spark, sf):
    e, s, lay = user_events(spark, sf)
    k = F.col("segment_no")
    a = e.where("type = 'Rescue'").select(F.when(k % 6 != 0, k).alias("segment_index"), F.concat(F.lit("PixelCorrelation Segment "), k).alias("segment_name"), F.round("time_s", 6).alias("time_s"), "amp")
    seg = user_segments(spark, sf).select(F.col("segment_no").alias("segment_index"), F.col("segment").alias("segment_name"), "sample_id")
    return G.afc_events_table(a, seg)


@query
def g5_clean_summary(spark, sf):
    seg = user_segments(spark, sf)
    e, s, lay = user_events(spark, sf)
    ev = e.withColumn("segment", F.concat(F.lit("PixelCorrelation Segment "), F.col("segment_no")))
    d = G.clean_summary(G.segment_summary(seg, 1.5, 10.0), ev, seg)
    return rounded(d, 9, "bpm_user", "detected_total_expected_ratio", "average_prom", "average_amp")


@query
def g6_peak_trace_table(spark, sf):
    d = G.peak_trace_table(_audit_rows(spark, sf), F.concat(F.lit("Segment "), F.col("segment_no")))
    return d.select("segment_no", "segment_name", "peak_index_raw", F.round("time_s", 6).alias("time_s"), "final_label", "rejection_reason", "notes")


@query
def g7_peak_trace_summary(spark, sf):
    return G.peak_trace_summary(_audit_rows(spark, sf), SEG)


@query
def g8_label_counts(spark, sf):
    return G.label_counts(_audit_rows(spark, sf), SEG)


@query
def g9_report_rows(spark, sf):
    e, s, lay = user_events(spark, sf)
    e = e.withColumns({"time_s": F.col("idx") / 8, "prom": F.when(F.col("idx") % 5 != 0, F.col("prom")), "transient": F.when(F.col("idx") % 4 != 0, F.col("transient"))})
    return G.report_rows(e, SEG)


@query
def g10_review_counts(spark, sf):
    d, _, _ = user_decisions(spark, sf)
    return G.review_counts(d)


@query
def g10_source_counts(spark, sf):
    s, lay = review_signal(spark, sf)
    return G.afc_source_counts(s.withColumn("source", F.col("event_type")), SEG)


@query
def g11_review_rows(spark, sf):
    s, lay = review_signal(spark, sf)
    log = s.where("event_type = 'error' and segment_no % 4 <> 0").select("segment_no", F.col("idx").alias("pos"), F.col("x").alias("x_start_s"), F.concat(F.lit("r"), F.col("idx")).alias("status"))
    return G.review_row_per_segment(user_segments(spark, sf), log, SEG)


@query
def g12_sample_id(spark, sf):
    d = _id_rows(spark, sf)
    return d.select("segment_no", "row_no", IO.normal_sample_id(F.col("` Sample ID `")).alias("sample_id"))


@query
def g13_number_text(spark, sf):
    e = table(spark, sf, "events")
    v = F.when(F.col("event_id") % 6 == 0, "x").when(F.col("event_id") % 6 == 1, F.lit(None)).otherwise((F.col("event_id") / 8).cast("string"))
    return e.select("event_id", G.fixed_text(v, 3).alias("text"), G.finite_or(v, -1.0).alias("number"))


@query
def g14_candidate_metrics(spark, sf):
    f = user_features(spark, sf)
    c = f.select("segment_no", F.explode(F.array(F.lit(1), F.lit(-1))).alias("polarity"), "n_main", "snr", "n_rescue_only", "periodicity", "ibi_cv")
    up = F.col("polarity") == 1
    c = c.select("segment_no", "polarity", (F.col("n_main") % 2 == F.when(up, 0).otherwise(1)).alias("qc_pass"), F.lit("pass").alias("qc_reason"),
                 F.col("snr").alias("quality_score"), F.col("n_main").alias("n_main_primary"), F.col("n_rescue_only").alias("n_rescue"), "periodicity", "ibi_cv",
                 F.col("snr").alias("prom_snr"), (F.col("snr") >= 1.8).alias("plausible"), (F.when(up, 0).otherwise(1) == F.col("n_main") % 2).alias("selected"))
    d = G.candidate_metrics(c, SEG)
    m = F.col("candidate_metrics")
    return d.select("segment_no", "candidate_selected", F.map_keys(m)[0].alias("first_label"), F.size(m).alias("n_tested"),
                    m["invert_true"]["qc_pass"].alias("inverted_pass"), m["invert_false"]["n_main_primary"].alias("n_as_is"))
