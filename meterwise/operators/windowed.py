"""Event-time window statistics per sensor (tumbling or sliding), a
partial aggregate keyed by (sensor_id, window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_stats(readings: DataFrame, duration: str = "1 hour", slide: str | None = None,
                   watermark: str | None = None) -> DataFrame:
    df = readings
    ts = "timestamp"
    if watermark:  # watermarks need an instant type (wall clock read as UTC)
        df = df.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", watermark)
        ts = "event_time"
    win = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    g = df.groupBy("sensor_id", win.alias("w")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"), F.max("value").alias("max"),
        F.min("value").alias("min"))
    return g.select("sensor_id", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "n", "mean", "stddev", "max", "min")
