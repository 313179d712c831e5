"""Additive seasonal decomposition and the residual
detector, as windows + grouped aggregates (no per-series solver).

trend    = centred moving average (computed in the positional pass)
seasonal = mean of (value - trend) by phase = pos mod period, centred so
           the phase means sum to zero
resid    = value - trend - seasonal
flag     = |resid| > threshold * stddev_samp(resid), for series with at
           least 2 * period rows; confidence min(|resid| / (k sigma), 1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SEASONAL_IMPORTANCE, DetectionConfig
from .layout import attach_per_sensor


def phase_means(frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(sensor_id, phase, phase_mean, seasonal) — seasonal is the phase
    mean minus the mean of the phase means."""
    d = (frame.filter(F.col("trend").isNotNull())
              .withColumn("phase", F.pmod(F.col("pos"), F.lit(cfg.period)))
              .groupBy("sensor_id", "phase")
              .agg(F.avg(F.col("value") - F.col("trend")).alias("phase_mean")))
    from pyspark.sql import Window
    centre = F.avg("phase_mean").over(Window.partitionBy("sensor_id"))
    return d.withColumn("seasonal", F.col("phase_mean") - centre)


def seasonal_profile(frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """One row per sensor: ``seasonal_map`` phase -> seasonal component."""
    pm = phase_means(frame, cfg)
    return pm.groupBy("sensor_id").agg(
        F.map_from_entries(F.collect_list(F.struct("phase", "seasonal"))).alias("seasonal_map"))


def decompose(frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Trend / seasonal / resid columns on every row."""
    prof = seasonal_profile(frame, cfg)
    j = attach_per_sensor(frame, prof)
    seas = F.element_at(F.col("seasonal_map"), F.pmod(F.col("pos"), F.lit(cfg.period)).cast("int"))
    out = j.withColumn("seasonal", seas).withColumn(
        "resid", F.col("value") - F.col("trend") - F.col("seasonal"))
    if cfg.legacy_shift:
        lead_seas = F.element_at(
            F.col("seasonal_map"),
            F.pmod(F.col("pos") + cfg.half_period, F.lit(cfg.period)).cast("int"))
        out = out.withColumn("resid_lead", F.col("lead_value") - F.col("lead_trend") - lead_seas)
    return out.drop("seasonal_map")


def seasonal_detect(frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """D5 (+F7): adds ``resid_std`` and ``conf_seasonal``."""
    d = decompose(frame, cfg)
    rs = d.groupBy("sensor_id").agg(F.max("n").alias("n"), F.stddev_samp("resid").alias("resid_std"))
    j = attach_per_sensor(d, rs, cfg)
    r = F.col("resid_lead") if cfg.legacy_shift else F.col("resid")
    k = F.lit(cfg.residual_threshold)
    bound = k * F.col("resid_std")
    flag = (F.col("n") >= 2 * cfg.period) & (F.abs(r) > bound)
    conf = F.least(F.coalesce(F.try_divide(F.abs(r), bound), F.lit(1.0)), F.lit(1.0))
    return j.withColumn("conf_seasonal", F.when(F.coalesce(flag, F.lit(False)), conf))
