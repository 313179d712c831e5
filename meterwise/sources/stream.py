"""Stream sources (S2): JSON lines from files or Kafka ``value`` bytes,
parsed into typed readings without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import RAW_READINGS
from .readings import _BAD, _tag, normalize_readings


def _parsed(df: DataFrame, column: str) -> DataFrame:
    text = F.col(column).cast("string")
    return df.select(text.alias("payload"), F.from_json(text, RAW_READINGS).alias("r")).select("payload", "r.*")


def tag_json_payload(df: DataFrame, column: str = "value") -> DataFrame:
    """Every message once, with its ``payload``, its typed reading and the reason why it gives none: what ``tagged_readings``
    and ``tagged_quarantine`` part, so that one pass parses for both."""
    p = _parsed(df, column)
    return _tag(p, "sensor_id", "timestamp", "value", "row_id" if "row_id" in p.columns else None, None)


def tagged_readings(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(_BAD).isNull()).drop(_BAD, "payload")


def tagged_quarantine(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(_BAD).isNotNull()).select("payload", F.col(_BAD).alias("reason"))


def parse_json_payload(df: DataFrame, column: str = "value") -> DataFrame:
    """Kafka-style payload: ``from_json(value.cast('string'))`` -> readings."""
    return tagged_readings(tag_json_payload(df, column))


def quarantine_json_payload(df: DataFrame, column: str = "value") -> DataFrame:
    """(payload, reason) of the messages that give no reading: malformed JSON, or no usable timestamp or sensor."""
    return tagged_quarantine(tag_json_payload(df, column))


def read_reading_stream(spark: SparkSession, path_or_servers: str, fmt: str = "json", *,
                        topic: str | None = None, max_files_per_trigger: int | None = None,
                        schema=None) -> DataFrame:
    """Streaming readings.  ``fmt`` is ``json`` / ``parquet`` (file source over a
    folder) or ``kafka`` (needs the Kafka connector on the classpath)."""
    if fmt == "kafka":
        raw = (spark.readStream.format("kafka")
               .option("kafka.bootstrap.servers", path_or_servers)
               .option("subscribe", topic or "sensor_data").load())
        return parse_json_payload(raw)
    r = spark.readStream.format(fmt).schema(schema or RAW_READINGS)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return normalize_readings(r.load(path_or_servers))
