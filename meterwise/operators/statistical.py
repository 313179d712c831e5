"""D1 statistical detector and D2 correlation importance.

D1 flags a row when its z-score (population deviation) exceeds the
threshold or the value falls outside the IQR fences; confidence is
``min(z / threshold, 1)`` for both kinds.  The test is affine-invariant, so it
runs on the raw value and does not depend on the scaler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import ENGINEERED_FEATURES, DetectionConfig
from .layout import attach_per_sensor
from .stats import safe_corr, series_stats


def statistical_columns(df: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Needs ``mean, std_pop, q1, q3`` on the rows (see ``series_stats``)."""
    z = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std_pop")))
    iqr = F.col("q3") - F.col("q1")
    lo = F.col("q1") - F.lit(cfg.iqr_multiplier) * iqr
    hi = F.col("q3") + F.lit(cfg.iqr_multiplier) * iqr
    z_flag = F.coalesce(z > F.lit(cfg.z_threshold), F.lit(False))
    iqr_flag = (F.col("value") < lo) | (F.col("value") > hi)
    out = df.withColumns({"z": z, "iqr_lower": lo, "iqr_upper": hi})
    out = out.withColumns({"z_flag": z_flag, "iqr_flag": F.coalesce(iqr_flag, F.lit(False))})
    conf = F.least(F.col("z") / F.lit(cfg.z_threshold), F.lit(1.0))
    return out.withColumn("conf_statistical",
                          F.when(F.col("z_flag") | F.col("iqr_flag"), conf))


def statistical_detect(frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Series frame -> frame with D1 columns (z, fences, flags, confidence)."""
    stats = series_stats(frame, cfg)
    return statistical_columns(attach_per_sensor(frame, stats, cfg), cfg)


def correlation_importance(frame: DataFrame, features=ENGINEERED_FEATURES) -> DataFrame:
    """|corr(feature, value)| per sensor, 0 where undefined.  One grouped
    pass for all features; long output ``(sensor_id, feature, importance)``."""
    wide = frame.groupBy("sensor_id").agg(
        *[safe_corr(F.col(f).cast("double"), F.col("value")).alias(f) for f in features])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("importance"),
                                 F.lit(i).alias("ordinal")) for i, f in enumerate(features)])
    return wide.select("sensor_id", F.inline(entries))
