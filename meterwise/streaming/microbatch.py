"""Batch-isolated stream processing.

Each micro-batch runs the same DataFrame plan as the batch job (nothing is
pulled to the driver).  Its tables are written to ``<out>/<table>/batch_id=<id>``:
``alerts``, and the ``outbox`` made from the written alerts, so that both carry the
same processing time (one per batch).  They become visible together when the
batch is committed (``sources.commits``).  A batch that was stopped half way is
written anew by its replay, one that is committed is left as it is: an alert is
neither lost nor repeated.  The stream's progress lives in the caller's
``checkpointLocation``.

With ``payload`` the stream brings JSON messages in that column (S2): its readings
and its quarantined messages are tables of the batch too (X6).  With ``registry`` a sensor is scaled by the
model of its first batch (P3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DetectionConfig
from ..operators.outbox import route_alerts
from ..operators.registry import ScalerRegistry
from ..plans.batch import detect_alerts
from ..sources.commits import CommitLog
from ..sources.stream import tag_json_payload, tagged_quarantine, tagged_readings


def _writer(out: str, cfg: DetectionConfig, checkpoint_location: str, registry: str | None, payload: str | None):
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, out)
        log.own(checkpoint_location)
        if log.committed(batch_id):
            return

        def written(df: DataFrame, table: str) -> DataFrame:
            path = f"{out}/{table}/batch_id={batch_id}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        tables = ["alerts", "outbox"]
        readings = batch
        if payload:
            tagged = tag_json_payload(batch, payload).persist()  # parsed once for both tables
            try:
                written(tagged_quarantine(tagged), "quarantine")
                readings = written(tagged_readings(tagged), "readings")
            finally:
                tagged.unpersist()
            tables += ["quarantine", "readings"]
        now = cfg.processing_time or spark.range(1).select(F.localtimestamp().cast("string")).first()[0]
        at = cfg.with_(processing_time=now)
        models = ScalerRegistry(spark, registry).register(readings, at) if registry else None
        alerts = written(detect_alerts(readings, at, scaler_model=models), "alerts")
        written(route_alerts(alerts, cfg.routes), "outbox")
        log.commit(batch_id, tables=tables, processing_time=now)
    return process


def start_batch_isolated(stream: DataFrame, out: str, checkpoint_location: str,
                         cfg: DetectionConfig | None = None, available_now: bool = False,
                         processing_time: str | None = None, registry: str | None = None, payload: str | None = None):
    """Start the query; the stream path's default guard is 10 cleaned rows."""
    cfg = cfg or DetectionConfig(min_points=10)
    process = _writer(out, cfg, checkpoint_location, registry, payload)
    w = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint_location)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_batch_isolated(stream: DataFrame, out: str, checkpoint_location: str,
                       cfg: DetectionConfig | None = None, registry: str | None = None, payload: str | None = None) -> DataFrame:
    """Process everything available, then return the committed alerts."""
    q = start_batch_isolated(stream, out, checkpoint_location, cfg, available_now=True, registry=registry, payload=payload)
    q.awaitTermination()
    return read_committed(stream.sparkSession, out, "alerts")


def read_committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of ``alerts``, ``outbox``, ``readings`` or ``quarantine`` of all committed batches, with their ``batch_id``."""
    return CommitLog(spark, out).read(table)
