"""Numbers that are no numbers, gaps, and limits that must not drop rows."""

import math

import numpy as np


def test_nan_rate_is_no_rate(spark):
    from beatframe.plans.detect import split_valid

    rows = [("a", 1, 0, 0, None, math.nan, 0.0, [1.0, 2.0]), ("a", 2, 0, 0, None, 250.0, 0.0, [1.0, 2.0]), ("a", 3, 0, 0, None, math.inf, 0.0, [1.0])]
    t = spark.createDataFrame(rows, "recording_id string, segment_no int, row_no int, tid int, begin_s double, fs double, t0 double, y array<double>")
    good, bad = split_valid(t, ["recording_id", "segment_no"])
    assert [r.segment_no for r in good.collect()] == [2]
    assert sorted((r.segment_no, r.qc_reason) for r in bad.collect()) == [(1, "runtime_error_ZeroDivisionError"), (3, "runtime_error_ZeroDivisionError")]


def test_begin_must_be_finite(spark):
    from beatframe.operators.layout import Layout
    from beatframe.operators.stitch import align

    rows = [(s, i, i, b, 10.0, [0.0] * 5) for s, bs in ((1, (0.0, 0.5)), (2, (0.0, math.nan)), (3, (math.inf, 1.0))) for i, b in enumerate(bs)]
    t = spark.createDataFrame(rows, "segment_no int, row_no int, tid int, begin_s double, fs double, y array<double>")
    got = {(r.segment_no, r.tid): (r.start, r.used_begin) for r in align(t, ["segment_no"], Layout(max_fs=10.0)).collect()}
    assert got == {(1, 0): (0, True), (1, 1): (5, True), (2, 0): (0, False), (2, 1): (5, False), (3, 0): (0, False), (3, 1): (5, False)}


def test_trend_bridges_gaps(spark):
    from beatframe.operators.layout import Layout
    from beatframe.operators.stats import rolling_trend

    x = [math.sin(i / 9) for i in range(200)]
    gap = [None if i == 50 else v for i, v in enumerate(x)]
    bridged = [(x[49] + x[51]) / 2 if i == 50 else v for i, v in enumerate(x)]
    run = lambda v: [r.trend for r in rolling_trend(spark.createDataFrame([(1, i, y, 20.0) for i, y in enumerate(v)], "segment_no int, idx int, x double, fs double"), ["segment_no"], Layout(max_fs=20.0)).orderBy("idx").collect()]
    assert np.allclose(run(gap), run(bridged))


def test_report_has_all_rows(spark):
    from beatframe.operators.report import report_rows

    e = spark.createDataFrame([(1, i, i / 2, 1.0, 1.0, 1.0, i) for i in range(300)], "segment_no int, idx int, time_s double, amp double, prom double, width_s double, transient int")
    assert report_rows(e, ["segment_no"]).count() == 300 and report_rows(e, ["segment_no"], 120).count() == 120


def test_times_are_split_into_chunks(spark):
    from beatframe.operators.layout import Layout

    p = spark.createDataFrame([(1, i * 0.5) for i in range(200)], "k int, t_s double")
    m = spark.createDataFrame([(1, i * 7.0 + 0.1, i) for i in range(12)], "k int, t_s double, n int")
    run = lambda lay: [(r.t_s, r.prev and r.prev.n, r.next and r.next.n) for r in lay.neighbours(p, m, ["k"], ["n"], "t_s").orderBy("t_s").collect()]
    assert run(Layout(size=16, long=True, max_fs=4.0)) == run(Layout(max_fs=4.0))


def test_windows_follow_each_segments_own_rate(spark):
    from beatframe.operators.layout import Layout
    from beatframe.operators.stats import choose_polarity, moving_average

    wave = [(k, i, math.sin(i * f) ** 9 + 0.01 * (i * 7 % 11), fs) for k, f, fs in ((1, 0.05, 100.0), (2, 0.02, 400.0)) for i in range(900)]
    s = spark.createDataFrame(wave, "segment_no int, idx int, x double, fs double")
    K = ["segment_no"]
    run = lambda d, lay: {(r.segment_no, r.idx): round(r.smooth, 12) for r in moving_average(d, K, lay, 50.0).collect()}
    both = run(s, Layout(max_fs=400.0))
    assert both == run(s.where("segment_no = 1"), Layout(max_fs=100.0)) | run(s.where("segment_no = 2"), Layout(max_fs=400.0))
    assert both == run(s, Layout(size=100, long=True, max_fs=400.0))
    x = [w[2] for w in wave[:900]]
    assert abs(both[1, 100] - sum(x[98:103]) / 5) < 1e-9 and abs(both[1, 0] - sum(x[:3]) / 5) < 1e-9
    pick = lambda d, fs: [tuple(r) for r in choose_polarity(d, K, Layout(max_fs=fs)).orderBy("segment_no").collect()]
    assert pick(s, 400.0) == pick(s.where("segment_no = 1"), 100.0) + pick(s.where("segment_no = 2"), 400.0)


def test_review_windows_of_any_width(spark):
    from beatframe.operators.layout import Layout
    from beatframe.operators.review import window_candidates

    s = spark.createDataFrame([(1, i, i / 20, math.sin(i * 0.9), 20.0) for i in range(1200)], "segment_no int, idx int, t_s double, x double, fs double")
    w = [(1, b, a - 0.01, a, a + n, -2.0, 2.0) for b, (a, n) in enumerate(((0.5, 0.9), (3.0, 5.0), (2.5, 50.0), (1.0, 58.0), (59.0, 1.0)))]
    w = spark.createDataFrame(w, "segment_no int, beat int, main_t double, start_s double, end_s double, lower double, upper double")
    run = lambda step: sorted((r.beat, r.idx, r.amp) for r in window_candidates(s, w, ["segment_no"], Layout(max_fs=20.0), bucket_s=step).collect())
    got = run(1.0)
    assert got == run(1000.0) and {b for b, *_ in got} == {0, 1, 2, 3, 4}


def test_corpus_operators_are_optional():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['beatframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0


def test_dominant_period_takes_every_segment_whole(spark, tmp_path):
    """Segments whose number ends in 0 or 1 are neither cut nor flattened; too short and constant ones have no period."""
    import datetime

    from beatframe.plans.queries import a7_dominant_period

    day = datetime.date(1994, 1, 1)
    price = {10: lambda i: 2e4 + 1e4 * math.sin(2 * math.pi * i / 80), 11: lambda i: 2e4 + 1e4 * math.sin(2 * math.pi * i / 120), 12: lambda i: 2e4}
    rows = [(k, day + datetime.timedelta(i), i, 1, f(i)) for k, f in price.items() for i in range(600)] + [(13, day, i, 1, 1e4 + i) for i in range(60)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_shipdate date, l_orderkey bigint, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.segment_no: r for r in a7_dominant_period(spark, str(tmp_path)).collect()}
    assert abs(got[10].period_s - 0.32) < 0.01 and abs(got[11].period_s - 0.48) < 0.01
    assert [(got[k].period_s, got[k].score) for k in (12, 13)] == [(None, 0.0)] * 2


def test_short_groups_share_a_kernel_call(spark):
    """Beats are signals of one call, not groups of their own; a NaN in one segment leaves the others alone."""
    from pyspark.sql import functions as F

    from beatframe.functions import kernels as K
    from beatframe.operators import peaks as P, review as R
    from beatframe.operators.layout import Layout

    def wave(k, i):
        return math.nan if (k, i) == (2, 333) else math.sin(i * 0.37) + 0.3 * math.cos(i * i * 0.05 + k)

    rows = [(k, i, i / 250.0, wave(k, i), 250.0) for k in range(1, 41) for i in range(700)]
    s = spark.createDataFrame(rows, "segment_no int, idx int, t_s double, x double, fs double")
    mains = s.where("idx % 60 = 7").selectExpr("segment_no", "t_s as time_s", "1.0D as amp")
    run = lambda lay: R.window_candidates(s, R.beat_windows(mains, R.time_span(s, ["segment_no"]), ["segment_no"], lay).withColumn("lower", R.lit(-1.0)), ["segment_no"], lay)
    got = run(Layout())
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString()
    key = lambda r: (r.segment_no, r.beat, r.idx, round(r.prom, 9), round(r.width_s, 9))
    assert {key(r) for r in got.collect() if r.segment_no != 2} == {key(r) for r in run(Layout(size=128, long=True)).collect() if r.segment_no != 2}
    s = s.fillna(0.5, ["x"])  # the beat with the NaN aside, segment 2 has the peaks of a whole signal
    beats = {r.beat for r in R.beat_windows(mains, R.time_span(s, ["segment_no"]), ["segment_no"], Layout()).collect() if r.segment_no == 2 and not r.start_s <= 333 / 250 <= r.end_s}
    assert len(beats) >= 9 and {key(r) for r in run(Layout()).collect() if r.segment_no == 2 and r.beat in beats} == {key(r) for r in got.collect() if r.segment_no == 2 and r.beat in beats}
    found = {}
    for r in P.find_peaks(s, ["segment_no", "fs"], Layout(), min_prom=F.lit(0.1), distance=F.lit(5), min_width=F.lit(2.0)).collect():
        found.setdefault(r.segment_no, []).append(r.idx)
    for k in range(1, 41):
        assert sorted(found[k]) == K.find_peaks(np.array([0.5 if math.isnan(wave(k, i)) else wave(k, i) for i in range(700)]), 0.1, 5, 2.0)[0].tolist()
