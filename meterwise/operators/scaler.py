"""Per-sensor standard scaler as a model table.

``fit_scaler`` -> ``(sensor_id, feature, mean, scale, n, fitted_at)``: mean
and population deviation of each scaled feature over its non-missing values,
scale 1 where the deviation is 0.  ``apply_scaler`` standardises the rows
with a model fitted earlier (fit once, reuse afterwards) or just now.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import SCALED_FEATURES, DetectionConfig
from ..functions.numeric import standardise
from .layout import attach_per_sensor


def _fitted_at(cfg: DetectionConfig):
    if cfg.processing_time:
        return F.lit(cfg.processing_time).cast("timestamp_ntz")
    return F.localtimestamp()


def scaler_wide(rows: DataFrame, cfg: DetectionConfig, features=SCALED_FEATURES) -> DataFrame:
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std"),
                 F.count(f).alias(f"{f}__n")]
    return rows.groupBy("sensor_id").agg(*aggs)


def fit_scaler(rows: DataFrame, cfg: DetectionConfig, features=SCALED_FEATURES) -> DataFrame:
    wide = scaler_wide(rows, cfg, features)
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"),
                 F.col(f"{f}__std").alias("std"), F.col(f"{f}__n").alias("n"))
        for f in features])
    long = wide.select("sensor_id", F.inline(entries))
    scale = F.when(F.col("std").isNull() | (F.col("std") == 0), F.lit(1.0)).otherwise(F.col("std"))
    return long.select("sensor_id", "feature", "mean", scale.alias("scale"),
                       F.col("n").cast("bigint").alias("n"), _fitted_at(cfg).alias("fitted_at"))


def model_wide(model: DataFrame, features=SCALED_FEATURES) -> DataFrame:
    aggs = []
    for f in features:
        aggs += [F.max(F.when(F.col("feature") == f, F.col("mean"))).alias(f"{f}__mean"),
                 F.max(F.when(F.col("feature") == f, F.col("scale"))).alias(f"{f}__scale")]
    return model.groupBy("sensor_id").agg(*aggs)


def apply_scaler(rows: DataFrame, model: DataFrame, features=SCALED_FEATURES,
                 suffix: str = "_scaled") -> DataFrame:
    """Adds ``<feature>_scaled`` columns; sensors missing from the model keep
    NULL scaled values.  Missing inputs stay missing."""
    wide = model_wide(model, features)
    j = attach_per_sensor(rows, wide)
    return j.withColumns({
        f"{f}{suffix}": standardise(f, f"{f}__mean", f"{f}__scale") for f in features
    }).drop(*[f"{f}__mean" for f in features], *[f"{f}__scale" for f in features])


def fit_new_sensors(rows: DataFrame, existing: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Fit-once semantics: the models of the sensors in ``rows`` that ``existing`` has no model of."""
    return fit_scaler(rows, cfg).join(existing.select("sensor_id").distinct(), "sensor_id", "left_anti")
