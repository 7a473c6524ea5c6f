"""Closed-form waveforms for tests and the scale bench (no random state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def bumps(t: Column, centers: list[tuple[float, float, float]]) -> Column:
    """Sum of ``(centre, height, width)`` Gaussian bumps at time ``t``."""
    x = F.lit(0.0)
    for c, a, w in centers:
        x = x + a * F.exp(-(t - c) * (t - c) / (2 * w * w))
    return x


def beating_traces(
    spark: SparkSession, segments: int = 1, beats: int = 10, fs: float = 250.0, height: float = 0.3, width: float = 0.06,
    trace_s: float = 1.2, extra: list[tuple[float, float, float]] = (), sign: float = 1.0, drift: float = 0.0, with_begin: bool = True,
) -> DataFrame:
    """One bump per second; traces of ``trace_s`` starting every second."""
    n = int(trace_s * fs)
    rows = spark.range(segments * beats).select(
        F.lit("generated").alias("recording_id"), F.floor(F.col("id") / beats).cast("int").alias("segment_no"),
        (F.col("id") % beats).cast("int").alias("row_no"),
    )
    t = lambda i: F.col("row_no") + i / F.lit(fs)

    def value(i):
        at = t(i)
        near = F.lit(0.0)
        for d in (-1, 0, 1):
            c = F.floor(at) + d + 0.5
            inside = (c > 0) & (c < beats)
            near = near + F.when(inside, height * F.exp(-(at - c) * (at - c) / (2 * width * width))).otherwise(0.0)
        ripple = 0.0005 * F.sin(at * 91.0) + 0.0005 * F.sin(at * 57.3)
        return sign * (near + bumps(at, list(extra)) + ripple) + drift * at / beats

    y = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)
    begin = F.col("row_no").cast("double") if with_begin else F.lit(None).cast("double")
    return rows.select(
        "recording_id", "segment_no", "row_no", F.col("row_no").alias("tid"), begin.alias("begin_s"),
        F.lit(fs).alias("fs"), F.lit(0.0).alias("t0"), y.alias("y"),
    )
