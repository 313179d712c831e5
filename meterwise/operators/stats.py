"""Per-sensor statistics (G2-G5, G7, G11): partial aggregates, so a hot sensor
is combined map-side and never travels as one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DetectionConfig
from .quantiles import exact_quantiles

QUARTILES = (0.25, 0.75)


def quartiles(col: Column, cfg: DetectionConfig) -> Column:
    """[q1, q3] with linear interpolation as an aggregate.  ``exact`` keeps a
    value->count map per sensor (small for repetitive meter values); ``approx``
    uses the bounded-memory quantile sketch."""
    if cfg.quantiles == "approx":
        return F.percentile_approx(col, [0.25, 0.75], cfg.quantile_accuracy)
    return F.percentile(col, F.array(F.lit(0.25), F.lit(0.75)))


def value_stats_aggs(cfg: DetectionConfig, col: str = "value") -> list[Column]:
    c = F.col(col)
    return [
        F.count(c).alias("n_values"),
        F.avg(c).alias("mean"),
        F.stddev_pop(c).alias("std_pop"),
        F.stddev_samp(c).alias("std_samp"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    ]


def with_quartiles(rows: DataFrame, aggs: list[Column], cfg: DetectionConfig, col: str = "value") -> DataFrame:
    """Per sensor the aggregates, q1 and q3; with ``quantiles="selection"`` the quartiles are selected in passes of their own."""
    if cfg.quantiles == "selection":
        found = exact_quantiles(rows, QUARTILES, col).withColumnRenamed("quantiles", "_q")
        s = rows.groupBy("sensor_id").agg(*aggs).join(found, "sensor_id", "left")
    else:
        s = rows.groupBy("sensor_id").agg(*aggs, quartiles(F.col(col), cfg).alias("_q"))
    return s.withColumns({"q1": F.get("_q", F.lit(0)), "q3": F.get("_q", F.lit(1))}).drop("_q")


def series_stats(rows: DataFrame, cfg: DetectionConfig, col: str = "value") -> DataFrame:
    """Per sensor: n_values, mean, std_pop, std_samp, min, max, q1, q3 (and the
    sensor's row count ``n`` when the rows carry it)."""
    extra = [F.max("n").alias("n")] if "n" in rows.columns else []
    return with_quartiles(rows, [*extra, *value_stats_aggs(cfg, col)], cfg, col)


def safe_corr(x: Column, y: Column) -> Column:
    """|Pearson r| over pairwise-complete rows, 0 where undefined (constant
    column, fewer than two pairs).  Built from covariance and deviations with
    try_divide because ``corr`` raises on a zero variance under ANSI mode."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
    return F.coalesce(F.abs(r), F.lit(0.0))
