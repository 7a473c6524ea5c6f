"""Summary, event and review tables for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.tables import normal_sample_id
from .layout import Layout, Scan
from .peaks import prominence_width


def segment_summary(segments: DataFrame, stim_hz: float, recording_s: float, keys: list[str] | None = None) -> DataFrame:
    """``segments`` = ``segment, qc_pass, qc_reason, n_main, n_main_primary, n_rescue``
    (and ``keys``).  Expected counts are null unless a stimulation rate is given."""
    expected = float(stim_hz * recording_s) if stim_hz > 0 and recording_s > 0 else None
    n = F.col("n_main")
    return segments.select(
        *(keys or []), "segment", F.when(F.col("qc_pass"), "PASS").otherwise("REJECT").alias("qc"), F.coalesce("qc_reason", F.lit("unknown")).alias("qc_reason"),
        (n / F.lit(float(recording_s)) * 60.0 if recording_s > 0 else F.lit(0.0)).alias("bpm_user"),
        F.col("n_main_primary").alias("primary_main_beats"), F.col("n_rescue").alias("rescue_peaks"), n.alias("total_detected_events"),
        F.lit(expected).cast("double").alias("expected_beats"),
        (n / F.nullif(F.lit(expected).cast("double"), F.lit(0.0))).alias("detected_total_expected_ratio"),
    )


def rescue_rows(rescue_idx: DataFrame, samples: DataFrame, keys: list[str], lay: Layout) -> DataFrame:
    """Rescue peaks with shape recomputed on the full signal (``idx`` in range only)."""
    s = samples.select(*keys, "idx", "t_s", "fs", F.col("x").alias("amp"))
    p = rescue_idx.select(*keys, "idx").join(s, keys + ["idx"])
    d = prominence_width(p, samples, keys, lay)
    return d.select(*keys, F.col("t_s").alias("time_s"), F.lit("Rescue").alias("type"), "amp", "prom", (F.col("width") / F.col("fs")).alias("width_s"))


def main_events_table(events: DataFrame, rescues: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Events of all segments with sample ids; rescue rows (shape from the full signal)
    replace the pipeline's own, so each rescue peak appears once."""
    cols = [*keys, "time_s", "type", "amp", "prom", "width_s", "transient"]
    m = events.where("type <> 'Rescue'").select(*cols)
    u = m.unionByName(rescues.select(*[c for c in cols if c in rescues.columns]), allowMissingColumns=True)
    return with_sample_id(u, segments, keys)


def with_sample_id(rows: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    s = segments.select(*keys, normal_sample_id(F.col("sample_id")).alias("sample_id"))
    return rows.join(s, keys, "left")


def afc_events_table(afc: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds the sample id by segment number, else by name."""
    sid = normal_sample_id(F.col("sample_id"))
    by_no = segments.groupBy("segment_index").agg(F.max(sid).alias("_a"))
    by_name = segments.groupBy("segment_name").agg(F.max(sid).alias("_b"))
    d = afc.join(by_no, "segment_index", "left").join(by_name, "segment_name", "left")
    return d.withColumn("sample_id", F.coalesce("_a", "_b")).drop("_a", "_b")


def clean_summary(summary: DataFrame, main_events: DataFrame, sample_ids: DataFrame, blank_rejects: bool = True) -> DataFrame:
    """Summary plus mean prominence and amplitude per segment; rejected rows keep only
    their identity and reason."""
    avg = main_events.groupBy("segment").agg(F.avg("prom").alias("average_prom"), F.avg("amp").alias("average_amp"))
    d = summary.join(sample_ids.select("segment", normal_sample_id(F.col("sample_id")).alias("sample_id")), "segment", "left").join(avg, "segment", "left")
    if not blank_rejects:
        return d
    gone = F.upper("qc") == "REJECT"
    cols = [
        "bpm_user", "primary_main_beats", "rescue_peaks", "total_detected_events", "detected_total_expected_ratio", "average_prom", "average_amp"
    ]
    return d.withColumns({c: F.when(~gone, F.col(c)) for c in cols})


def peak_trace_table(trace: DataFrame, name: Column) -> DataFrame:
    """Audit rows of all segments in one typed table."""
    return trace.withColumns({"segment_name": name, "rejection_reason": F.coalesce("rejection_reason", F.lit("")), "notes": F.lit("")})


def peak_trace_summary(trace: DataFrame, keys: list[str]) -> DataFrame:
    label = F.lower("final_label")
    return trace.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_peaks"), F.count_if("survived_main_candidate_stage").alias("main_candidates"),
        F.count_if(label == "main").alias("final_main"), F.count_if(label == "rescue").alias("final_rescue"),
        F.count_if(label == "dropped").alias("dropped"), F.count_if(label == "raw_only").alias("raw_only"),
    )


def label_counts(trace: DataFrame, keys: list[str]) -> DataFrame:
    return trace.groupBy(*keys, "final_label").agg(F.count(F.lit(1)).alias("n"))


def fixed_text(c: Column, digits: int) -> Column:
    """Fixed-decimal text, blank for null or text that is not a number."""
    v = c.try_cast("double")
    return F.coalesce(F.when(v.isNotNull() & ~F.isnan(v), F.format_string(f"%.{digits}f", v)), F.lit(""))


def finite_or(c: Column, default: float | None = None) -> Column:
    v = c.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, v).otherwise(F.lit(default).cast("double"))


def report_rows(events: DataFrame, keys: list[str], max_rows: int | None = None, with_transient: bool = True) -> DataFrame:
    """The events of each segment (the first ``max_rows`` if given) as numbered report text."""
    w = W.partitionBy(*keys).orderBy("time_s", "idx")
    d = events.withColumn("row", F.row_number().over(w))
    d = d if max_rows is None else d.where(F.col("row") <= max_rows)
    out = [fixed_text(F.col("time_s"), 3).alias("time_s"), *[fixed_text(F.col(c), 5).alias(c) for c in ("amp", "prom", "width_s")]]
    if with_transient:
        out.append(F.coalesce(F.col("transient").cast("int").cast("string"), F.lit("")).alias("transient"))
    return d.select(*keys, "row", *out)


def afc_source_counts(afc: DataFrame, keys: list[str] = ()) -> DataFrame:
    return afc.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))


def review_counts(log: DataFrame, keys: list[str] = ()) -> DataFrame:
    skipped = F.lower("status") == "skipped"
    return log.groupBy(*keys).agg(F.count_if(~skipped).alias("reviewed"), F.count_if(skipped).alias("skipped"))


def review_row_per_segment(segments: DataFrame, log: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """First log row of every segment, ``not_reviewed`` where there is none."""
    cols = [c for c in log.columns if c not in keys + [order]]
    first = log.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("r"))
    d = segments.select(*keys).join(first, keys, "left")
    out = [finite_or(F.col("r")[c]).alias(c) for c in cols if c != "status"]
    return d.select(*keys, *out, F.coalesce("r.status", F.lit("not_reviewed")).alias("status"))


def candidate_metrics(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per segment: metrics of every tested polarity, the selected one and why."""
    label = F.when(F.col("polarity") == -1, "invert_true").otherwise("invert_false")
    q = F.coalesce("quality_score", F.lit(float("-inf")))
    rank = F.format_string("(%d, %s, %d)", F.col("qc_pass").cast("int"), q.cast("string"), F.col("plausible").cast("int"))
    d = candidates.withColumns({"label": label, "rank": rank})
    metrics = F.struct("qc_pass", "qc_reason", "quality_score", "n_main_primary", "n_rescue", "periodicity", "ibi_cv", "prom_snr", "rank")
    return d.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label"), metrics.alias("m"))))).alias("candidate_metrics"),
        F.max(F.when(F.col("selected"), F.col("label"))).alias("candidate_selected"),
        F.max(F.when(F.col("selected"), F.concat(F.lit("max_rank="), "rank"))).alias("candidate_selection_reason"),
    )
