"""A registry of scaler models that are fitted once.

Insert-only and versioned: a version is a folder with the models of the sensors
that it adds, published by the commit log.  A sensor keeps its first model, for
batch jobs and streams alike, also after a restart.  A version is taken by
publishing its number, which only one writer can; another that was fitting at
the same time looks again which sensors are still missing and takes the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import DetectionConfig
from ..schema import SCALER_MODEL
from ..sources.commits import CommitLog
from .features import series_frame
from .scaler import fit_new_sensors


class ScalerRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, self.path)

    def models(self) -> DataFrame:
        """(sensor_id, feature, mean, scale, n, fitted_at, version) of all published versions: one model a sensor."""
        return self._models(self.log.batches())

    def _models(self, versions: list[int]) -> DataFrame:
        folders = [self.log.entry(v)["folder"] for v in versions]
        schema = T.StructType([*SCALER_MODEL.fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def register(self, readings: DataFrame, cfg: DetectionConfig) -> DataFrame:
        """Fit and publish models of the sensors in ``readings`` that have none yet; all models."""
        while True:
            versions = self.log.batches()
            held = self._models(versions)
            new = readings.join(held.select("sensor_id").distinct(), "sensor_id", "left_anti")
            version = versions[-1] + 1 if versions else 0
            folder = f"{self.path}/models/version-{version}-{uuid.uuid4().hex}"
            added = fit_new_sensors(series_frame(new.select(*readings.columns), cfg), held, cfg)
            added.withColumn("version", F.lit(version).cast("bigint")).write.parquet(folder)
            if self.spark.read.parquet(folder).isEmpty() or self.log.commit(version, folder=folder):
                return self.models()
