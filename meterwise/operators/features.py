"""P2 feature engineering and the other positional columns.

All positional expressions are evaluated in ONE window pass over the
``(sensor_id, blk)`` layout: the 12/24/168-row frames, the first difference,
the 24/168-row lags, and the centred moving average share the same partition
and order, so Spark sorts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import ROLLING_WINDOWS, TEMPORAL_LOOKBACKS, DetectionConfig
from ..functions.time import calendar_columns
from .layout import block_window, clean_series, core_rows, min_points_guard, to_blocks


def centred_trend(cfg: DetectionConfig, w, value: str = "value"):
    """Additive decomposition's moving average.  Even period p: 2x(p)
    filter with half weights at +-p/2; odd: plain mean of p rows.  NULL for
    the first and last p//2 rows."""
    p, h = cfg.period, cfg.period // 2
    v = F.col(value)
    if p % 2 == 0:
        inner = F.sum(v).over(w.rowsBetween(-(h - 1), h - 1)) if h > 1 else v
        t = (inner + 0.5 * F.lag(v, h).over(w) + 0.5 * F.lead(v, h).over(w)) / F.lit(float(p))
    else:
        t = F.sum(v).over(w.rowsBetween(-h, h)) / F.lit(float(p))
    inside = (F.col("pos") >= h) & (F.col("pos") <= F.col("n") - 1 - h)
    return F.when(inside, t)


def positional_columns(blocks: DataFrame, cfg: DetectionConfig) -> DataFrame:
    w = block_window()
    v = F.col("value")
    cols = dict(calendar_columns("timestamp"))
    for k in ROLLING_WINDOWS:
        fr = w.rowsBetween(-(k - 1), 0)
        cols[f"rolling_mean_{k}"] = F.avg(v).over(fr)
        cols[f"rolling_std_{k}"] = F.stddev_samp(v).over(fr)
    prev = F.lag(v, 1).over(w)
    cols["rate_of_change"] = v - prev
    cols["rate_of_change_abs"] = F.abs(v - prev)
    for k, _ in TEMPORAL_LOOKBACKS:
        cols[f"lag_{k}"] = F.lag(v, k).over(w)
    cols["trend"] = centred_trend(cfg, w)
    out = blocks.withColumns(cols)
    if cfg.legacy_shift:
        h = cfg.half_period
        out = out.withColumns({
            "lead_value": F.lead(v, h).over(w),
            "lead_trend": F.lead(F.col("trend"), h).over(w),
        })
    return out


def series_frame(readings: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Cleaned, guarded rows with every positional column; one row per kept
    reading.  Columns: sensor_id, timestamp, row_id, value, value_raw,
    imputed, pos, n, blk, the 11 engineered features, lag_24, lag_168, trend."""
    clean = min_points_guard(clean_series(readings, cfg.validate()), cfg)
    return core_rows(positional_columns(to_blocks(clean, cfg), cfg))

