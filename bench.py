"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "t11_gap_fill", "t13_stitch", "t14_map_transients", "a2_global_snr", "a5_rolling_trend", "a6_remove_drift", "a7_dominant_period",
    "a8_trace_correlation", "a10_structure_features", "a14_polarity_score", "v2_vertical_repair", "v4_exclude_near_discontinuities",
    "q2_segment_qc", "p2_raw_peaks", "p3_peaks_per_transient", "p6_main_candidates", "p7_refractory_dedup", "p14_second_lobes",
    "p15_transient_coherence", "p16_rescue_peaks", "p21_segment_analysis", "r6_segment_candidates", "r11_previous_main", "r12_nearest_sample",
    "r17_merge_segment_decisions", "g5_clean_summary", "g7_peak_trace_summary",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from beatframe.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("beatframe-bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # call sites in error messages cost several calls to the JVM for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    out = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        out[n] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
