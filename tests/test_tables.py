import json

import pytest
from pyspark.sql import functions as F

from beatframe.operators import report as G, review as R
from beatframe.operators.layout import Layout
from beatframe.sources import sessions as J, tables as IO

K = ["segment_no"]


def test_sheet_scan(spark):
    rows = [
        ("r", "PixelCorrelation Segment 3", 0, "x", 1.0, 2.0, "T7", None), ("r", "PixelCorrelation Segment 3", 1, "125", 3.0, None, "none", 0.5),
        ("r", "Overview", 0, "10", 0.0, 0.0, "1", 0.0),
    ]
    d = spark.createDataFrame(rows, "recording_id string, sheet_name string, row_no int, `Sampling Frequency` string, `y -1` double, `y 0` double, Transientnumber string, `Begin (seconds)` double")
    got = IO.scan_traces(d).orderBy("row_no").collect()
    assert [(g.segment_no, g.tid, g.fs, g.t0, g.y) for g in got] == [(3, 7, 125.0, 0.5, [1.0, 2.0]), (3, 1, 125.0, 0.5, [3.0, None])]
    assert IO.sheet_overlap(["y -14", "y 0", "y 30"]) == 14
    # sheets of different shapes in one table: each has the overlap of the columns that it fills
    two = d.unionByName(d.withColumns({"recording_id": F.lit("q"), "y -1": F.lit(None).cast("double"), "y -3": F.col("y 0")}), allowMissingColumns=True)
    assert {(g.recording_id, g.overlap) for g in IO.scan_traces(two).collect()} == {("r", 1), ("q", 3)}
    assert {g.overlap for g in IO.scan_traces(d.drop("y -1")).collect()} == {0}
    with pytest.raises(ValueError):
        IO.scan_traces(d.drop("y -1", "y 0"))


def test_sample_ids(spark):
    d = spark.createDataFrame([(" 7.0 ",), ("",), ("A1 ",), (None,), ("2.5",)], "v string")
    assert [r[0] for r in d.select(IO.normal_sample_id(F.col("v"))).collect()] == ["7", None, "A1", None, "2.5"]


def test_session_generations(spark, tmp_path):
    doc = {
        "schema_version": "old", "items": [
            {"segment_index": 1, "afc_lower_left_value": 1.0, "x_start_s": 0.0, "x_end_s": 5.0, "manual_afc_times_s": [1.0]},
            {"segment_index": 2, "afc_left_value": 2.0, "afc_upper_cap": 9.0, "x_start_s": 0.0, "accepted_times_s": [1.0, 2.0]},
            {"segment_index": 3, "main_peak_time_s": 4.0, "main_peak_amp": 0.5, "lower_line": 0.1, "upper_line": 0.7, "window_start_s": 4.1, "window_end_s": 4.5},
        ], "decisions": [{"segment_index": 3, "lower_line": 0.1, "upper_line": 0.7, "accepted_times_s": [4.2]}],
    }
    f = tmp_path / "s.json"
    f.write_text(json.dumps(doc, indent=2))
    s = J.read_sessions(spark, str(f))
    i = {r.segment_index: r for r in J.upgrade_items(s, []).collect()}
    assert i[1].manual_afc_times_s == [1.0] and i[2].afc_lower_left_value == 2.0 and i[2].afc_upper_right_value == 9.0
    assert i[2].manual_afc_times_s == [1.0, 2.0]
    assert i[3].main_peak_times_s == [4.0] and i[3].afc_lower_right_value == 0.7 and i[3].x_end_s == 4.5
    d = J.upgrade_decisions(s, []).first()
    assert d.manual_afc_times_s == [4.2] and d.status == "saved"
    assert R.resume_decisions(J.upgrade_decisions(s, [])).first().afc_lower_left_value is None


def test_empty_sinks_keep_their_schema(spark, tmp_path):
    cols = "segment_name string, segment_index int, main_peak_index int, time_s double, amplitude double, source string, review_id string"
    IO.write_afc_events(spark.createDataFrame([], cols), str(tmp_path / "e"))
    assert spark.read.schema(cols).csv(str(tmp_path / "e"), header=True).count() == 0


def test_sloped_threshold(spark):
    d = spark.createDataFrame([(0.0, 10.0), (10.0, 0.0), (5.0, 5.0), (None, 1.0)], "a double, b double")
    v = [r[0] for r in d.select(R.sloped_threshold(F.lit(2.5), F.col("a"), F.col("b"), F.lit(1.0), F.lit(5.0))).collect()]
    assert v == [2.0, 4.0, 1.0, None]


def test_previous_main_and_nearest(spark):
    p = spark.createDataFrame([(1, 0.5), (1, 1.0), (1, 2.2), (2, 1.0), (1, None)], "segment_no int, t_s double")
    m = spark.createDataFrame([(1, 1.0), (1, 2.0)], "segment_no int, t_s double")
    for lay in (Layout(), Layout(size=1, long=True)):
        got = sorted((r.segment_no, r.t_s or -1, r.main_peak_index) for r in R.assign_previous_main(p, m, K, lay).collect())
        assert got == [(1, -1, -1), (1, 0.5, -1), (1, 1.0, 0), (1, 2.2, 1), (2, 1.0, -1)]
    s = spark.createDataFrame([(1, i, i * 1.0, float(i * i)) for i in range(4)], "segment_no int, idx int, t_s double, x double")
    q = spark.createDataFrame([(1, 0.5), (1, 1.6), (1, -3.0), (1, 9.0)], "segment_no int, t_s double")
    got = {r.t_s: r.near_idx for r in R.nearest_sample(q, s, K, Layout()).collect()}
    assert got == {0.5: 0, 1.6: 2, -3.0: 0, 9.0: 3}


def test_points(spark):
    log = spark.createDataFrame(
        [(1, 0, "upsert", 1.0, 5.0), (1, 1, "upsert", 1.0000001, 6.0), (1, 2, "upsert", 2.0, 7.0), (1, 3, "remove", 2.0, None)],
        "segment_no int, pos int, op string, t_s double, amp double")
    assert [(r.t_s, r.amp) for r in R.apply_point_log(log, K).collect()] == [(1.0000001, 6.0)]


def test_report_text(spark):
    d = spark.createDataFrame([("1.23456",), ("x",), (None,), ("nan",)], "v string")
    assert [tuple(r) for r in d.select(G.fixed_text(F.col("v"), 3), G.finite_or(F.col("v"), -1.0)).collect()] == [("1.235", 1.23456), ("", -1.0), ("", -1.0), ("", -1.0)]
