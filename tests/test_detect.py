"""Whole analysis on waveforms with known beats."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from beatframe.operators.layout import settle
from beatframe.plans.detect import analyze_traces
from beatframe.plans.waveforms import beating_traces


@pytest.fixture(scope="module")
def result(spark):
    def seg(n, **kw):
        return beating_traces(spark, 1, **kw).withColumn("segment_no", F.lit(n))

    lobes = [(i + 0.75, 0.24, 0.05) for i in range(10)]
    parts = [
        seg(0), seg(1, sign=-1.0), seg(2, drift=0.2), seg(3).where("row_no <> 4"), seg(4, extra=lobes), seg(5).where("row_no < 2"),
        seg(6).withColumn("y", F.transform("y", lambda v: F.lit(None).cast("double"))), seg(7).withColumn("y", F.lit(None).cast("array<double>")),
        seg(8).withColumn("y", F.transform("y", lambda v: F.lit(1.0))),
    ]
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    t = settle(t.orderBy(F.rand(7)))
    r = analyze_traces(t)
    return r, {x.segment_no: x for x in r.segments.collect()}, t


def test_beats_recovered(result):
    r, seg, _ = result
    for n in (0, 1, 2):
        assert seg[n].qc_pass and seg[n].n_main == 10
    assert seg[0].polarity == 1 and seg[1].polarity == -1
    assert seg[2].applied and not seg[0].applied


def test_inversion_gives_the_same_events(result):
    r = result[0]
    t = [[(round(e.time_s, 6), round(e.amp, 9)) for e in r.events.where(f"segment_no = {n}").orderBy("time_s").collect()] for n in (0, 1)]
    assert t[0] == t[1] and [round(v, 1) for v, _ in t[0]] == [i + 0.5 for i in range(10)]


def test_missing_trace_leaves_a_gap(result):
    r, seg, _ = result
    assert seg[3].n_main == 9 and seg[3].gap_samples > 0
    assert r.samples.where("segment_no = 3 and in_gap").count() == seg[3].gap_samples


def test_double_lobes_are_kept(result):
    assert result[1][4].n_main == 20


def test_rejections(result):
    seg = result[1]
    assert seg[5].qc_reason == "too_few_rows" and seg[6].qc_reason == "empty_signal" and seg[7].qc_reason == "runtime_error_ValueError"
    assert not seg[8].qc_pass
    assert all(seg[n].n_main == 0 for n in (5, 6, 7, 8))


def test_audit_adds_up(result):
    r = result[0]
    for x in r.peak_trace.groupBy("segment_no").agg(
        F.count("*").alias("n"), F.count_if(F.col("final_label").isin("main", "rescue", "dropped", "raw_only")).alias("k"),
        F.count_if((F.col("final_label") == "main") & (F.col("rejection_reason") != "")).alias("bad"),
    ).collect():
        assert x.n == x.k and x.bad == 0
    assert r.candidates.where("selected").count() == r.candidates.select("segment_no").distinct().count()


def test_cut_segments_give_the_same_tables(result):
    """The whole analysis with segments cut into chunks of 200 samples, row by row."""
    whole, _, traces = result
    cut = analyze_traces(traces, size=200)
    for name in ("segments", "events", "peak_trace", "candidates", "gaps", "samples"):
        a, b = getattr(whole, name).toPandas(), getattr(cut, name).toPandas()
        cols = sorted(a.columns)
        by = [c for c in ("segment_no", "polarity", "idx", "peak_index_raw", "time_s", "s") if c in cols]
        a, b = (d[cols].sort_values(by).reset_index(drop=True) for d in (a, b))
        assert len(a) > 0
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-7, atol=1e-9)
