"""Whole jobs from sheets to result tables, and errors of kernels."""

import json

import pytest
from pyspark.sql import functions as F

from beatframe.operators.layout import settle
from beatframe.operators.peaks import arrow_groups, collected_errors
from beatframe.params import DETECTOR
from beatframe.plans import detect, jobs
from beatframe.plans.jobs import analyze_sheets, review_sheets
from beatframe.plans.waveforms import beating_traces
from beatframe.sources import sessions as J, tables as IO


@pytest.fixture(scope="module")
def sheets(spark):
    """Two recordings: beats, inverted beats, beats with a secondary wave, no samples."""
    waves = [(i + 0.80, 0.12, 0.03) for i in range(8)]
    parts = [("a", 1, {}), ("a", 2, {"sign": -1.0}), ("b", 1, {"extra": waves}), ("b", 3, {})]
    t = None
    for rec, seg, kw in parts:
        one = beating_traces(spark, 1, beats=8, fs=100.0, **kw).withColumns({"recording_id": F.lit(rec), "segment_no": F.lit(seg)})
        if (rec, seg) == ("b", 3):
            one = one.withColumn("y", F.transform("y", lambda v: F.lit(None).cast("double")))
        t = one if t is None else t.unionByName(one)
    cols = [F.element_at("y", i + 1).alias(f"y {i}") for i in range(120)]
    return settle(t.select("recording_id", F.concat(F.lit(" PixelCorrelation Segment "), "segment_no").alias("sheet_name"), "row_no", *cols,
                           F.col("fs").alias("Sampling Frequency"), F.col("begin_s").alias("Begin"), F.lit("7.0").alias("Sample ID")))


def test_automatic_and_review_jobs(spark, sheets, tmp_path, monkeypatch):
    prepared = jobs._prepare(sheets, 1.0, 8.0, DETECTOR)  # one analysis for the three jobs below
    monkeypatch.setattr(jobs, "_prepare", lambda *a: prepared)
    auto = {(r.recording_id, r.segment_no): r for r in analyze_sheets(sheets, str(tmp_path / "auto"), 1.0, 8.0, with_trace=True).collect()}
    assert set(auto) == {("a", 1), ("a", 2), ("b", 1), ("b", 3)}
    for k in (("a", 1), ("a", 2)):
        assert auto[k].qc == "PASS" and auto[k].total_detected_events == 8 and auto[k].bpm_user == 60 and auto[k].detected_total_expected_ratio == 1 and auto[k].sample_id == "7"
    assert auto["b", 3].qc == "REJECT" and auto["b", 3].qc_reason == "empty_signal" and auto["b", 3].average_amp is None
    events = spark.read.parquet(str(tmp_path / "auto/main_events"))
    assert events.where("recording_id = 'a' and type = 'Main Beat'").count() == 16
    trace = spark.read.parquet(str(tmp_path / "auto/peak_debug")).groupBy("recording_id", "segment_no").count().count()
    assert trace == spark.read.parquet(str(tmp_path / "auto/peak_debug_summary")).count() == 3

    # first sitting: nothing decided yet; the session lists items with helper candidates
    first = str(tmp_path / "first")
    review_sheets(sheets, first, None, 1.0, 8.0)
    session = J.read_sessions(spark, f"{first}/session", multi_line=False)
    docs = {r.input_workbook: r for r in session.collect()}
    assert {k: sorted(i.segment_index for i in d["items"]) for k, d in docs.items()} == {"a": [1, 2], "b": [1]}
    item = docs["a"]["items"][0]
    assert item.status == "pending" and len(item.main_peak_times_s) == 8 and docs["a"].decisions is None
    assert spark.read.parquet(f"{first}/afc_events").count() == 0

    # second sitting: one segment marked, one skipped

    texts = [json.loads(x) for x in session.toJSON().collect()]
    for d in texts:
        d["decisions"] = [{**i, "manual_afc_times_s": [i["main_peak_times_s"][2] + 0.3, i["main_peak_times_s"][4] + 0.3], "status": "skipped" if (d["input_workbook"], i["segment_index"]) == ("a", 2) else "saved"} for i in d["items"]]
    saved = tmp_path / "saved.json"
    saved.write_text("\n".join(json.dumps(d) for d in texts))
    second = str(tmp_path / "second")
    review_sheets(sheets, second, J.read_sessions(spark, str(saved), multi_line=False), 1.0, 8.0)
    afc = {(r.recording_id, r.segment_no): r for r in spark.read.parquet(f"{second}/afc_events").groupBy("recording_id", "segment_no").agg(F.sort_array(F.collect_list("main_peak_index")).alias("after"), F.first("sample_id").alias("sample_id")).collect()}
    assert set(afc) == {("a", 1), ("b", 1)} and afc["a", 1].after == [2, 4] and afc["a", 1].sample_id == "7"
    again = {(r.input_workbook, i.segment_index): i for r in J.read_sessions(spark, f"{second}/session", multi_line=False).collect() for i in r["items"]}
    assert {k: i.status for k, i in again.items()} == {("a", 1): "completed", ("a", 2): "skipped", ("b", 1): "completed"}
    back = IO.read_result_set(spark, second)
    assert back["review_log"].count() == 3
    assert back["main_events"].where("type not in ('Main Beat', 'Rescue')").count() == 4
    assert spark.read.csv(f"{second}/afc_events_csv", header=True).count() == 4 and spark.read.csv(f"{second}/review_log_csv", header=True).count() == 3


def test_kernel_error_is_a_row(spark):
    df = spark.createDataFrame([(s, i) for s in (1, 2, 3) for i in range(4)], "segment_no int, idx int")

    def fn(c):
        if c["idx"].sum() and c["_s"][0] == 2:
            raise ZeroDivisionError("segment 2")
        return {"idx": c["idx"][:2]}

    df = df.withColumn("_s", F.col("segment_no"))
    with collected_errors(["segment_no"]) as errors:
        out = arrow_groups(df, ["segment_no"], ["segment_no"], [("idx", "int")], fn)
    assert sorted({r.segment_no for r in out.collect()}) == [1, 3] and out.columns == ["segment_no", "idx"]
    assert [tuple(r) for r in errors.table(spark, df.select("segment_no").schema).collect()] == [(2, "ZeroDivisionError")]
    with pytest.raises(Exception, match="segment 2"):
        arrow_groups(df, ["segment_no"], ["segment_no"], [("idx", "int")], fn).collect()


def test_failing_segment_leaves_the_others(spark, monkeypatch):
    traces = beating_traces(spark, 2, beats=8, fs=100.0)
    def failing(t, keys):
        def fn(c):
            if c["_n"][0] == 1:
                raise KeyError("broken segment")
            return {"corr_med": [0.99]}

        d = t.select(*keys, F.col("row_no").alias("idx"), F.col("segment_no").alias("_n"))
        return arrow_groups(d, keys, keys, [("corr_med", "double")], fn)

    monkeypatch.setattr(detect.Q, "trace_correlation", failing)
    r = detect.analyze_traces(traces, isolate=True)
    seg = {x.segment_no: x for x in r.segments.collect()}
    assert seg[0].qc_pass and seg[0].n_main == 8 and not seg[1].qc_pass and seg[1].qc_reason == "runtime_error_KeyError" and seg[1].n_main == 0
    assert r.events.where("segment_no = 1").count() == 0 and r.events.where("segment_no = 0").count() == 8
