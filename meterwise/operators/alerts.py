"""A1-A3: alert rows.  One lazy plan: detections + per-sensor expected range
+ per-sensor attribution (computed once per sensor, not once per alert)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DetectionConfig
from ..functions.text import severity
from .rootcause import past_columns, root_cause_summary, temporal_context


def processing_time(cfg: DetectionConfig):
    if cfg.processing_time:
        return F.lit(cfg.processing_time).cast("timestamp_ntz")
    return F.localtimestamp()


def assemble_alerts(det: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """``det``: ensemble rows carrying value, value_scaled, mean, std_pop,
    value__mean / value__scale (scaler), lags, feature_attribution,
    attribution_ranked, n."""
    scale = F.when(F.col("value__scale") == 0, F.lit(1.0)).otherwise(F.col("value__scale"))
    lo = F.col("mean") - 2.0 * F.col("std_pop")
    hi = F.col("mean") + 2.0 * F.col("std_pop")
    temporal = temporal_context(F.col("value"), past_columns(cfg))
    return det.select(
        "timestamp", "sensor_id", "anomaly_type",
        severity(F.col("ensemble_confidence")).alias("severity"),
        "value", "value_scaled",
        F.struct(lo.alias("lower"), hi.alias("upper")).alias("expected_range"),
        F.struct(((lo - F.col("value__mean")) / scale).alias("lower"),
                 ((hi - F.col("value__mean")) / scale).alias("upper")).alias("expected_range_scaled"),
        F.col("ensemble_confidence").alias("confidence_score"),
        root_cause_summary(F.col("attribution_ranked"), F.col("timestamp"), temporal)
        .alias("root_cause_summary"),
        "feature_attribution",
        F.struct(processing_time(cfg).alias("processing_time"),
                 F.col("n").cast("bigint").alias("data_points_used")).alias("metadata"),
    )
