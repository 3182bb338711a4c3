"""Light curves and star attributes as bound to the relational tables.

A star is a user of ``events``; flux is the value in hundredths, an exact
integer, so sums agree whatever their order.  Attributes come from ``customer``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US, DAY_US = 1704067200000000, 86400000000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``; only where that is unset, in local runs, in one of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="starfold-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a ``kept_folder`` and read again, for what is used more than once."""
    path = kept_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tic_id, us, time (days), f (integer flux), quality, kind, and the ephemeris period, t0, duration."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    return e.select(
        F.col("user_id").cast("long").alias("tic_id"), us.alias("us"), (us / F.lit(DAY_US)).alias("time"), F.round(F.col("value") * 100).cast("long").alias("f"),
        F.get_json_object("props", "$.k").cast("int").alias("quality"), F.col("event_type").alias("kind"),
        (F.lit(1.0) + F.lit(0.5) * (F.col("user_id") % 7)).alias("period"), F.lit(0.25).alias("t0"), F.lit(0.3).alias("duration"),
    )


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    share = (F.col("c_acctbal") + 1000.0) / 11000.0
    return c.select(
        F.col("c_custkey").cast("long").alias("tic_id"), (F.lit(0.2) + F.lit(0.8) * F.col("c_nationkey") / 24.0).alias("crowdsap"), (F.lit(0.3) + F.lit(2.2) * share).alias("radius"), (F.lit(0.3) + F.lit(1.5) * share).alias("mass"),
        F.pmod(F.col("c_custkey") * F.lit(137.508), F.lit(360.0)).alias("ra"), (F.pmod(F.col("c_custkey") * F.lit(57.3), F.lit(180.0)) - 90).alias("dec"), (F.lit(6.0) + F.col("c_nationkey") / 4.0).alias("tmag"),
    )


LC_SQL = """
lc AS (SELECT user_id::BIGINT AS tic_id, (epoch_us(ts) - 1704067200000000)::BIGINT AS us, (epoch_us(ts) - 1704067200000000)::DOUBLE / 86400000000.0::DOUBLE AS time,
  round(value * 100)::BIGINT AS f, regexp_extract(props, '[0-9]+')::INT AS quality, event_type AS kind, 1.0::DOUBLE + 0.5::DOUBLE * (user_id % 7) AS period, 0.25::DOUBLE AS t0, 0.3::DOUBLE AS duration FROM events)"""
STARS_SQL = """
stars AS (SELECT c_custkey::BIGINT AS tic_id, 0.2::DOUBLE + 0.8::DOUBLE * c_nationkey / 24.0::DOUBLE AS crowdsap, 0.3::DOUBLE + 2.2::DOUBLE * ((c_acctbal + 1000.0) / 11000.0::DOUBLE) AS radius, 0.3::DOUBLE + 1.5::DOUBLE * ((c_acctbal + 1000.0) / 11000.0::DOUBLE) AS mass,
  (c_custkey * 137.508::DOUBLE) % 360.0::DOUBLE AS ra, (c_custkey * 57.3::DOUBLE) % 180.0::DOUBLE - 90 AS dec, 6.0::DOUBLE + c_nationkey / 4.0::DOUBLE AS tmag FROM customer)"""
