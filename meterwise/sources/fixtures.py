"""Readings derived from the given tables (events, orders).

``hourly_by_type`` is the evenly spaced main fixture: one series per event
type on an hourly grid from the type's first to last hour, with the hourly
mean as value and NULL in hours without events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.time import trunc_hour


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resample_hourly(readings: DataFrame) -> DataFrame:
    """Hourly grid per sensor (first to last hour) left-joined with the hourly
    mean.  The mean is a partial aggregate, the grid one row per hour."""
    hourly = (readings.groupBy("sensor_id", trunc_hour("timestamp").alias("timestamp"))
              .agg(F.avg("value").alias("value")))
    bounds = hourly.groupBy("sensor_id").agg(F.min("timestamp").alias("lo"),
                                             F.max("timestamp").alias("hi"))
    grid = bounds.select(
        "sensor_id",
        F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("timestamp"))
    return (grid.join(hourly, ["sensor_id", "timestamp"], "left")
                .select("sensor_id", "timestamp", "value",
                        F.lit(None).cast("bigint").alias("row_id")))


def raw_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("sensor_id"), F.col("ts").alias("timestamp"),
                     F.col("value").cast("double").alias("value"),
                     F.col("event_id").alias("row_id"))


def raw_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("sensor_id"),
                     F.col("ts").alias("timestamp"),
                     F.col("value").cast("double").alias("value"),
                     F.col("event_id").alias("row_id"))


def hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_hourly(raw_by_type(spark, sf_dir))


def orders_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-ish series over 1995-2001 (all months), keyed by order priority."""
    o = load_table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("sensor_id"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
                    F.col("o_totalprice").cast("double").alias("value"),
                    F.col("o_orderkey").alias("row_id"))
