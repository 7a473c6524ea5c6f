"""Chunked (long) segments give the same rows as whole segments."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from beatframe.operators import artifacts as V, peaks as P, select as S, stats as A
from beatframe.operators.layout import Jobs, Layout, Scan, drop, private, settle, steady

K = ["segment_no"]
WHOLE, CUT = Layout(max_fs=20.0), Layout(size=25, long=True, max_fs=20.0)


def same(make, *by):
    a, b = make(WHOLE).toPandas(), make(CUT).toPandas()
    cols = sorted(a.columns)
    by = ["segment_no", *by]
    a, b = (d[cols].sort_values(by).reset_index(drop=True) for d in (a, b))
    assert len(a) > 0
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_scans(signal):
    cols = dict(
        a=Scan("lag", F.col("x")), b=Scan("lead", F.col("x")), c=Scan("ffill", F.when(F.col("x") > 1.2, F.col("idx"))),
        d=Scan("bfill", F.when(F.col("x") > 1.2, F.col("idx"))), e=Scan("cumsum", F.col("x")), f=Scan("rownum"), g=Scan("cummax", F.col("x")),
    )
    same(lambda lay: lay.scan(signal, K, ["idx"], **cols), "idx")


def test_quantiles(signal):
    same(lambda lay: lay.quantiles(signal, K, F.col("x"), {"q0": 0.0, "q30": 0.3, "q999": 0.999}))


def test_neighbours(signal):
    pts, marks = signal.where("idx % 3 = 0"), signal.where("idx % 17 = 4").withColumn("at", F.col("idx"))
    same(lambda lay: lay.neighbours(pts, marks, K, ["at"]).select("segment_no", "idx", F.col("prev.at").alias("p"), F.col("next.at").alias("n")), "idx")


def test_index_rows(spark, signal):
    want = signal.toPandas().set_index(["segment_no", "idx"])["x"]
    got = CUT.index_rows(signal.withColumnRenamed("idx", "o"), K, ["o"], F.floor(F.col("o") / 13)).toPandas()
    assert all(want[(r.segment_no, r.idx)] == r.x for r in got.itertuples())


@pytest.mark.parametrize("distance", [1, 4])
def test_find_peaks(signal, distance):
    same(lambda lay: P.find_peaks(signal, K, lay, min_prom=F.lit(0.05), distance=F.lit(distance), min_width=F.lit(1.0)), "idx")


def test_trend_and_period(signal):
    same(lambda lay: A.rolling_trend(signal, K, lay, 2.0, 0.2), "idx")
    same(lambda lay: A.dominant_period(signal, K, lay))


def test_trend_bridges_gaps_wider_than_a_chunk(signal):
    """Chunks of 25 samples; gaps of 60 and at both ends, null and infinite samples."""
    hole = F.col("idx").between(40, 99) | (F.col("idx") < 7) | (F.col("idx") > 125)
    gappy = settle(signal.withColumn("x", F.when(hole & (F.col("idx") % 2 == 0), F.lit(None)).when(hole, F.lit(float("nan"))).when(F.col("idx") == 20, F.lit(float("inf"))).otherwise(F.col("x"))))
    same(lambda lay: A.rolling_trend(gappy, K, lay, 2.0, 0.2).select("segment_no", "idx", "trend"), "idx")
    assert A.rolling_trend(gappy, K, CUT, 2.0, 0.2).where("trend is null or isnan(trend)").count() == 0


def test_artifacts(spark, signal):
    spiked = settle(signal.withColumn("x", F.when((F.col("idx") == 50) & (F.col("segment_no") == 1), 90.0).otherwise(F.col("x"))))
    same(lambda lay: V.vertical_lines(spiked, K, lay), "idx")
    assert [(r.segment_no, r.idx) for r in V.vertical_lines(spiked, K, WHOLE).collect()] == [(1, 50)]
    # 50 and 53 touch: the second repair reads the first one's result
    lines = spark.createDataFrame([(1, 24), (1, 50), (1, 53), (1, 179), (2, 0)], "segment_no int, idx int")
    same(lambda lay: V.repair_vertical_lines(spiked, lines, K, lay), "idx")
    fixed = {r.idx: r.x for r in V.repair_vertical_lines(spiked, lines, K, WHOLE).where("segment_no = 1").collect()}
    x = {r.idx: r.x for r in spiked.where("segment_no = 1").collect()}
    assert fixed[51] == pytest.approx(x[48] + 0.75 * (x[52] - x[48]))
    assert fixed[52] == pytest.approx(fixed[51] + 0.25 * (x[55] - fixed[51]))


def test_refractory_dedup(signal):
    raw = P.find_peaks(signal, K, WHOLE, min_prom=F.lit(0.05), distance=F.lit(1)).withColumns({
        "width_s": F.col("width") / 20, "fs": F.lit(20.0), "tid": F.lit(0)})
    raw = settle(S.with_valleys(settle(raw), signal, K, WHOLE))
    same(lambda lay: S.refractory_dedup(raw, raw.where("prom > 0.3"), K, lay), "idx")


def test_measure_switches(signal):
    assert not Layout.measure(signal, K).long
    assert Layout.measure(signal, K, 100).long


@pytest.fixture(scope="module")
def odd(signal):
    """Nulls, NaN and an infinite sample among the samples of one segment, nothing but nulls in another."""
    from functools import reduce

    i = F.col("idx")
    x = F.when(i % 23 == 5, F.lit(None)).when(i == 60, F.lit(float("nan"))).when(i == 90, F.lit(float("inf"))).when(i % 31 == 9, F.col("x") + 9).otherwise(F.col("x"))
    kinds = [F.col("x"), F.when(i % 23 != 5, F.col("x")), x, F.lit(None).cast("double"), F.lit(1.0), F.when(i % 31 == 9, F.col("x") + 9).otherwise(F.col("x"))]
    parts = [signal.where("segment_no = 1").select(F.lit(n).alias("segment_no"), "idx", v.alias("x"), "fs") for n, v in enumerate(kinds)]
    return settle(reduce(lambda a, b: a.unionByName(b), parts))


@pytest.mark.parametrize("make", [A.global_snr, A.spike_fraction, V.discontinuity_candidates, V.vertical_line_candidates])
def test_whole_segments_are_measured_by_kernels(odd, make):
    """No percentile over the rows of a segment (the cost of p21), the same rows as from cut ones."""
    assert "percentile" not in make(odd, K, WHOLE)._jdf.queryExecution().optimizedPlan().toString()
    if make is not V.vertical_line_candidates:  # none in signals this short
        same(lambda lay: make(odd.where("segment_no <> 3"), K, lay), *(["idx"] if make is V.discontinuity_candidates else []))


def test_segments_without_samples_keep_their_row(odd):
    r = {x.segment_no: x for x in A.global_snr(odd, K, WHOLE).join(A.spike_fraction(odd, K, WHOLE), K).collect()}
    assert len(r) == 6 and r[3].snr is None and r[3].signal_mad is None and r[3].noise_mad == 1e-12 and r[3].spike_fraction == 0.0


def test_needles_of_whole_segments(odd):
    peaks = odd.where("x is not null and x = x").select(*K, "idx", F.abs("x").alias("prom"), (F.col("idx") % 5 / 100).alias("width_s"))
    assert "percentile" not in V.mark_needles(peaks, odd, K, WHOLE)._jdf.queryExecution().optimizedPlan().toString()
    assert V.mark_needles(peaks, odd, K, WHOLE).where("needle").count() > 0
    same(lambda lay: V.mark_needles(peaks, odd, K, lay), "idx")


def test_flips_and_periods_of_whole_segments(odd, monkeypatch):
    fair = odd.where("segment_no in (0, 4, 5)")
    written = []
    monkeypatch.setattr(A, "settle", lambda *a: written.append(1) or settle(*a))
    assert A.mixed_direction_flip(fair, K, WHOLE) is not None and len(written) == 1
    same(lambda lay: A.mixed_direction_flip(fair, K, lay))
    same(lambda lay: A.dominant_period(fair, K, lay))


def test_drift_of_whole_segments(odd, monkeypatch):
    """One table is written; nulls stay null, a constant signal has no correlation."""
    slow = settle(odd.where("segment_no not in (2, 3)").withColumns({"x": F.col("x") + F.col("idx") * 0.05 * (F.col("segment_no") % 2), "tag": F.col("idx").cast("string")}))
    written = []
    monkeypatch.setattr(A, "settle", lambda *a: written.append(1) or settle(*a))
    assert len(A.remove_drift(slow, K, WHOLE)) == 2 and len(written) == 1
    same(lambda lay: A.remove_drift(slow, K, lay)[0], "idx")
    same(lambda lay: A.remove_drift(slow, K, lay)[1])
    assert {r.applied for r in A.remove_drift(slow, K, WHOLE)[1].collect()} == {True, False}


def _files(spark):
    from pathlib import Path

    from beatframe.operators.layout import scratch_root

    return {p for p in Path(scratch_root(spark)).glob("beatframe_*")}


def test_tables_on_the_way_are_dropped(spark, signal):
    """Cut segments write tables in every step; only the result stays, with the tables that others read."""
    before = _files(spark)
    out = settle(lambda: A.spike_fraction(signal, K, CUT))
    assert len(_files(spark) - before) == 1 and out.count() == 2 and signal.count() == 311
    before = _files(spark)
    a, b, rest = private(lambda: (settle(signal, K), settle(settle(signal).limit(3)), signal))
    assert len(_files(spark) - before) == 2 and (a.count(), b.count(), rest.count()) == (311, 3, 311)
    drop(a, b)
    assert _files(spark) == before


def test_jobs_drop_what_they_wrote(spark, signal):
    before = _files(spark)
    with Jobs() as jobs:
        a, b = private(lambda: tuple(jobs.all(lambda: settle(lambda: settle(signal).where("idx < 9")), lambda: settle(signal.where("idx < 5"), K))))
        jobs.narrow()
        later = jobs.start(lambda: settle(signal.limit(2)))
    assert (a.count(), b.count(), later().count()) == (18, 10, 2) and len(_files(spark) - before) == 3


def test_plain_selections_are_not_written_again(spark, signal):
    before = _files(spark)
    assert steady(signal.where("idx > 3").select("idx", (F.col("x") * 2).alias("y"))).count() == 303
    assert _files(spark) == before
    assert steady(signal.groupBy("segment_no").count()).count() == 2 and len(_files(spark) - before) == 1


def test_shuffles_of_a_write_go_with_it(spark, signal):
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    d = signal.groupBy("segment_no").agg(F.sum("idx").alias("n"))
    assert sorted(d.collect()) == sorted(d.collect())  # a frame can be read again
