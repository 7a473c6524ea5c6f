"""The given tables as signals (the engine's input contract, see README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.layout import Layout, tune

SEG = ["segment_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events_signal(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, Layout]:
    """``events`` as one signal per user, one sample per row, fs = 1."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("segment_no"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("x"), F.lit(1.0).alias("fs"), *extra
    )
    lay = Layout.measure(e.select("segment_no", "fs"), SEG)
    s = lay.index_rows(e, SEG, ["ts", "event_id"], F.date_trunc("day", "ts"))
    return s.select("segment_no", F.col("idx").cast("int").alias("idx"), "x", "fs", *extra, *(["ts"] if extra else [])), lay


def lineitem_signal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Layout]:
    """``lineitem`` as one signal per supplier, x = price / 1e5, fs = 250."""
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("segment_no"), "l_shipdate", "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / 1e5).alias("x"), F.lit(250.0).alias("fs"),
    )
    lay = Layout.measure(e.select("segment_no", "fs"), SEG)
    s = lay.index_rows(e, SEG, ["l_shipdate", "l_orderkey", "l_linenumber"], F.date_trunc("day", "l_shipdate"))
    return s.select("segment_no", F.col("idx").cast("int").alias("idx"), "x", "fs"), lay


def embedding_traces(spark: SparkSession, sf_dir: str, with_begin: bool = True) -> DataFrame:
    """``embeddings`` as traces: one segment per label, 64 samples per trace,
    starting every 50 samples with one gap after each fifth trace."""
    v = table(spark, sf_dir, "embeddings")
    counted = v.select(F.col("label").cast("bigint").alias("segment_no"), "vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("y"))
    lay = Layout.measure(counted.select("segment_no"), SEG)
    t = lay.index_rows(counted, SEG, ["vec_id"], F.floor(F.col("vec_id") / 1_000_000), "tid")
    t = t.withColumn("tid", F.col("tid").cast("int"))
    begin = (F.col("tid") * 50 + F.floor(F.col("tid") / 5) * 50) / 250.0
    return t.select(
        "segment_no", F.col("tid").alias("row_no"), "tid",
        (begin if with_begin else F.lit(None).cast("double")).alias("begin_s"),
        F.lit(250.0).alias("fs"), F.lit(0.0).alias("t0"), "y",
    )
