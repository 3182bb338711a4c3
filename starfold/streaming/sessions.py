"""Gap segments of a live stream of points: session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def point_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def star_sessions(points: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Per star and session: start, stop, points, and sums of exact integer flux; points later than ``late`` are left out by the watermark."""
    timed = points.select(F.col("user_id").alias("tic_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("f")).withWatermark("ts", late)
    g = timed.groupBy("tic_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("sum_f"), F.max("f").alias("max_f"))
    return g.select("tic_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "sum_f", "max_f")
