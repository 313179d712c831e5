"""A versioned table of detection models for the continuous mode.

A version holds, per sensor, what the statistical and the seasonal detector need
of the whole series: mean, deviation and quartiles, phase means, the spread of
the residuals.  It is fitted by the batch job and published by the commit log;
``detections`` applies it to continuous features, a join on the sensor, with the
rules of the batch detectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DetectionConfig
from ..sources.commits import CommitLog
from .seasonal import decompose, seasonal_profile
from .statistical import statistical_columns
from .stats import with_quartiles

SCHEMA = ("sensor_id string, n bigint, mean double, std_pop double, q1 double, q3 double, seasonal_map map<int,double>, "
          "resid_std double, version bigint")


def fit_models(frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(sensor_id, n, mean, std_pop, q1, q3, seasonal_map, resid_std) of a series frame."""
    stats = with_quartiles(frame, [F.max("n").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop")], cfg)
    spread = decompose(frame, cfg).groupBy("sensor_id").agg(F.stddev_samp("resid").alias("resid_std"))
    return stats.join(seasonal_profile(frame, cfg), "sensor_id", "left").join(spread, "sensor_id", "left")


class DetectionModels:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, self.path)

    def publish(self, frame: DataFrame, cfg: DetectionConfig) -> int:
        """Fit and publish a new version; its number."""
        while True:
            versions = self.log.batches()
            version = versions[-1] + 1 if versions else 0
            folder = f"{self.path}/models/version-{version}-{uuid.uuid4().hex}"
            fit_models(frame, cfg).withColumn("version", F.lit(version).cast("bigint")).write.parquet(folder)
            if self.log.commit(version, folder=folder):
                return version

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self.log.entry(version)["folder"])

    def latest(self) -> tuple[int | None, DataFrame]:
        """The newest version and its models; none yet: no version and no models."""
        versions = self.log.batches()
        return (versions[-1], self.read(versions[-1])) if versions else (None, self.spark.createDataFrame([], SCHEMA))


def detections(features: DataFrame, models: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """(sensor_id, timestamp, row_id, detector, confidence, version) of continuous features; late rows and sensors without a
    model give none.  The seasonal detection belongs to the row half a period before the one that completes its trend."""
    j = statistical_columns(features.filter(~F.col("late")).drop("z", "conf_statistical").join(models, "sensor_id"), cfg)
    phase = F.pmod(F.col("pos") - F.lit(cfg.half_period), F.lit(cfg.period)).cast("int")
    resid = F.col("centre_value") - F.col("centre_trend") - F.element_at("seasonal_map", phase)
    bound = F.lit(cfg.residual_threshold) * F.col("resid_std")
    flag = F.coalesce((F.col("n") >= 2 * cfg.period) & (F.abs(resid) > bound), F.lit(False))
    seasonal = F.when(flag, F.least(F.coalesce(F.try_divide(F.abs(resid), bound), F.lit(1.0)), F.lit(1.0)))
    hits = F.array(
        F.struct("timestamp", "row_id", F.lit("statistical").alias("detector"), F.col("conf_statistical").alias("confidence")),
        F.struct(F.col("centre_timestamp").alias("timestamp"), F.col("centre_row_id").alias("row_id"), F.lit("seasonal").alias("detector"), seasonal.alias("confidence")))
    return j.select("sensor_id", F.inline(F.filter(hits, lambda x: x["confidence"].isNotNull())), "version")
