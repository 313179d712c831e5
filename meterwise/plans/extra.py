"""Streaming queries, queries checked by row count only (random forest) and the
flagship query."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DetectionConfig, SCALED_FEATURES
from ..operators.ensemble import ensemble_detect
from ..operators.features import series_frame
from ..operators.iforest import iforest_detect, permutation_importance_rows
from ..operators.scaler import apply_scaler, fit_scaler
from ..schema import ALERT_COLUMNS
from ..session import cut_lineage
from ..sources.fixtures import hourly_by_type, load_table, raw_by_type
from ..streaming.continuous import STREAM_SCHEMA
from .batch import detect_alerts, detection_frame
from .catalog import gappy

FULL = DetectionConfig(processing_time="2024-02-01 00:00:00")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    a = detect_alerts(hourly_by_type(spark, sf), DetectionConfig())
    return a.select(*ALERT_COLUMNS)


def _scaled_frame(readings: DataFrame, cfg: DetectionConfig) -> DataFrame:
    f = cut_lineage(series_frame(readings, cfg))  # read by the scaler's fit and by the rows: the windows run once
    return apply_scaler(f, fit_scaler(f, cfg))


def q_iforest_detect(spark, sf):
    d = iforest_detect(_scaled_frame(raw_by_type(spark, sf), FULL), FULL)
    return (d.filter(F.col("conf_isolation_forest").isNotNull())
             .select("sensor_id", "timestamp", "row_id", F.round("if_score", 6).alias("if_score"),
                     F.round("conf_isolation_forest", 6).alias("confidence")))


def q_permutation_importance(spark, sf):
    f = _scaled_frame(hourly_by_type(spark, sf), FULL)
    return permutation_importance_rows(f, FULL).select(
        "sensor_id", "feature", F.round("importance", 6).alias("importance"))


def q_ensemble_three_detectors(spark, sf):
    j = detection_frame(hourly_by_type(spark, sf), FULL)
    return ensemble_detect(j, FULL).select("sensor_id", "timestamp",
                                           F.round("ensemble_confidence", 6).alias("confidence"),
                                           "anomaly_type")


def q_detect_alerts(spark, sf):
    a = detect_alerts(hourly_by_type(spark, sf), FULL.with_(permutation_importance=True))
    return a.select("timestamp", "sensor_id", "anomaly_type", "severity",
                    F.round("value", 6).alias("value"),
                    F.round("confidence_score", 6).alias("confidence_score"),
                    "root_cause_summary")


def _run_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/meterwise-stream-{uuid.uuid4().hex}"


def q_stream_batch_isolated(spark, sf):
    """Hourly series written one file per sensor, streamed one file per
    micro-batch: each batch is one whole series, so the alerts equal the
    batch job's."""
    from ..streaming import run_batch_isolated
    run = _run_dir(spark)
    hourly_by_type(spark, sf).repartition("sensor_id").write.partitionBy("sensor_id").parquet(f"{run}/input")
    stream = (spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 1)
              .parquet(f"{run}/input"))
    a = run_batch_isolated(stream, f"{run}/out", f"{run}/checkpoint", FULL.with_(min_points=10))
    return a.select("batch_id", "timestamp", "sensor_id", "anomaly_type", "severity",
                    F.round("confidence_score", 6).alias("confidence_score"))


def q_stream_batch_alerts(spark, sf):
    """The same stream with the two deterministic detectors: the alerts of the batch job."""
    from ..streaming import run_batch_isolated
    run = _run_dir(spark)
    hourly_by_type(spark, sf).repartition("sensor_id").write.partitionBy("sensor_id").parquet(f"{run}/input")
    stream = (spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 1)
              .parquet(f"{run}/input"))
    cfg = FULL.with_(min_points=10, detectors=("statistical", "seasonal"))
    a = run_batch_isolated(stream, f"{run}/out", f"{run}/checkpoint", cfg)
    return a.select("sensor_id", "timestamp", "anomaly_type", "severity",
                    F.round(F.col("confidence_score") + F.lit(1e-9), 6).alias("confidence_score"))


#: Rows of a part that one task writes as one file.
FILE_ROWS = 1 << 17


def _in_turn(parts: list[DataFrame], folder: str, file_rows: int = FILE_ROWS) -> int:
    """Write the parts one after the other, each as the same number of files, which is returned: the file source reads files in
    the order of their times, so that as many files a trigger make each part one micro-batch."""
    rows = [p.count() for p in parts]
    n = max(1, min(-(-max(rows) // file_rows), min(rows)))
    for p, r in zip(parts, rows):
        # Rows are dealt in turn: one input partition of n rows or more is enough for n files.
        (p.coalesce(1) if n == 1 else p.coalesce(max(1, r // file_rows)).repartition(n)).write.mode("append").parquet(folder)
    return n


def _shuffled_stream(rows: DataFrame, run: str) -> DataFrame:
    """A stream of the rows, each delayed by up to a day: every three days (of that time) are one micro-batch, and a
    heartbeat closes it."""
    from datetime import timedelta

    from ..streaming import heartbeat
    spark = rows.sparkSession
    delay = F.pmod(F.xxhash64("sensor_id", "timestamp", "row_id"), F.lit(86_400))
    part = F.floor((F.unix_timestamp(F.col("timestamp").cast("timestamp")) + delay) / (3 * 86_400))
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{run}/rows")
    dealt = spark.read.parquet(f"{run}/rows")
    days = sorted(r["part"] for r in dealt.select("part").distinct().collect())  # one a three days
    end = dealt.agg(F.max("timestamp")).first()[0]
    parts = [dealt.filter(F.col("part") == d).drop("part") for d in days]
    files = _in_turn(parts, f"{run}/input")
    _in_turn([heartbeat(spark, end + timedelta(days=400))], f"{run}/input")
    return spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{run}/input")


def q_stream_continuous(spark, sf):
    """Continuous-mode features over irregular series with gaps, from shuffled rows."""
    from ..streaming import start_continuous
    run = _run_dir(spark)
    stream = _shuffled_stream(gappy(spark, sf).select("timestamp", "value", "row_id", "sensor_id"), run)
    q = start_continuous(stream, f"{run}/out", f"{run}/checkpoint", FULL.with_(min_points=10), watermark="25 hours", available_now=True)
    q.awaitTermination()
    six = lambda c: F.round(F.col(c) + F.lit(1e-9), 6).alias(c)
    return spark.read.parquet(f"{run}/out").select(
        "sensor_id", "timestamp", "row_id", *map(six, ("value", "rolling_mean_24", "rolling_std_168", "rate_of_change", "value_scaled", "conf_statistical")), "late")


def q_stream_detections(spark, sf):
    """D1 and D5 in continuous mode: shuffled rows, scored with a model that the batch job has published."""
    from ..operators.models import DetectionModels
    from ..streaming import read_committed, start_continuous_detection
    run = _run_dir(spark)
    rows = hourly_by_type(spark, sf).select("timestamp", "value", "row_id", "sensor_id")
    DetectionModels(spark, f"{run}/models").publish(series_frame(rows, FULL), FULL)
    stream = _shuffled_stream(rows, run)
    start_continuous_detection(stream, f"{run}/out", f"{run}/checkpoint", f"{run}/models", FULL.with_(min_points=10), watermark="25 hours",
                               available_now=True).awaitTermination()
    return read_committed(spark, f"{run}/out", "detections").select(
        "sensor_id", "timestamp", "detector", F.round(F.col("confidence") + F.lit(1e-9), 6).alias("confidence"), "version")


def q_stream_scaler_registry(spark, sf):
    """Two micro-batches in two runs of the stream, the second one after a restart.  A sensor is scaled by the model of its first batch;
    one sensor comes only in the second."""
    from ..streaming import run_batch_isolated
    run = _run_dir(spark)
    early = (F.col("sensor_id") != "view") & (F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz"))
    rows = hourly_by_type(spark, sf).select("timestamp", "value", "row_id", "sensor_id")
    cfg = FULL.with_(detectors=("statistical", "seasonal"))
    for part in (rows.filter(early), rows.filter(~early)):
        _in_turn([part], f"{run}/input")
        stream = spark.readStream.schema(STREAM_SCHEMA).parquet(f"{run}/input")
        alerts = run_batch_isolated(stream, f"{run}/out", f"{run}/checkpoint", cfg, registry=f"{run}/models")
    return alerts.select(F.col("batch_id").cast("bigint").alias("batch_id"), "sensor_id", "timestamp",
                         F.round(F.col("value_scaled") + F.lit(1e-9), 6).alias("value_scaled"), "severity")


def q_stream_quarantine(spark, sf):
    """JSON messages, some of them spoilt by rule; readings and quarantined messages of all committed micro-batches."""
    from ..streaming import read_committed, run_batch_isolated
    run = _run_dir(spark)
    i = F.col("event_id")
    at = F.when(i % 89 == 0, F.lit("not a time")).when(i % 83 != 0, F.col("ts").cast("string"))
    whole = F.to_json(F.struct(F.when(i % 97 != 0, F.col("event_type")).alias("sensor_id"), at.alias("timestamp"), F.col("value").cast("double").alias("value")))
    messages = load_table(spark, sf, "events").select("event_id", F.when(i % 101 == 0, F.lit("{broken")).otherwise(whole).alias("value"))
    files = _in_turn([messages.filter(i % 3 == k).select("value") for k in range(3)], f"{run}/input")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).parquet(f"{run}/input")
    out = f"{run}/out"
    run_batch_isolated(stream, out, f"{run}/checkpoint", FULL.with_(detectors=("statistical",), min_points=10), payload="value")
    kept = read_committed(spark, out, "readings").select(F.lit("kept").alias("outcome"))
    return kept.unionAll(read_committed(spark, out, "quarantine").select("reason")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


ROWS_ONLY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "iforest_detect": q_iforest_detect,
    "permutation_importance": q_permutation_importance,
    "ensemble_three_detectors": q_ensemble_three_detectors,
    "detect_alerts": q_detect_alerts,
    "stream_batch_isolated": q_stream_batch_isolated,
    "stream_continuous": q_stream_continuous,
    "stream_batch_alerts": q_stream_batch_alerts,
    "stream_detections": q_stream_detections,
    "stream_scaler_registry": q_stream_scaler_registry,
    "stream_quarantine": q_stream_quarantine,
}
