"""Alert outbox.  Instead of sending from inside the engine, every
message to deliver becomes a row ``(sensor_id, timestamp, channel, from, to,
subject, body)`` that a delivery job can read (idempotent, replayable).

A channel is a function ``(alerts, routes) -> outbox rows``; ``CHANNELS`` holds
the built-in ones, and ``route_alerts`` takes any others beside them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Routes
from ..functions.numeric import fmt_num


def py_timestamp_text(ts: Column) -> Column:
    """``str()`` of a pandas timestamp: seconds, microseconds only if set."""
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == "000000", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def iso_text(ts: Column) -> Column:
    frac = F.date_format(ts, "SSSSSS")
    return F.when(frac == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def attribution_lines(ranked: Column, k: int = 5) -> Column:
    """``- name: 0.123`` for the k largest |importance|."""
    return F.array_join(F.transform(F.slice(ranked, 1, k), lambda e: F.format_string(
        "- %s: %s", e["feature"], fmt_num(e["importance"], 3))), "\n")


def metadata_json(meta: Column) -> Column:
    """Two-space indented JSON of the metadata, time as ISO text."""
    return F.format_string('{\n  "processing_time": "%s",\n  "data_points_used": %d\n}',
                           iso_text(meta["processing_time"]), meta["data_points_used"])


def ranked(attribution: Column) -> Column:
    """The entries of ``feature_attribution``, which are kept in rank order."""
    return F.transform(F.map_entries(attribution), lambda e: F.struct(e["key"].alias("feature"), e["value"].alias("importance")))


def email_subject() -> Column:
    return F.format_string("Anomaly Alert - %s - %s", F.col("sensor_id"), F.upper(F.col("severity")))


def email_body() -> Column:
    """A9."""
    return F.format_string(
        "\nAnomaly Detection Alert\n\nTimestamp: %s\nSensor ID: %s\nAnomaly Type: %s\n"
        "Severity: %s\nConfidence: %s%%\n\nValue: %s\nExpected Range: %s - %s\n\n"
        "Root Cause Analysis:\n%s\n\nTop Contributing Features:\n%s\n\nMetadata:\n%s\n        ",
        py_timestamp_text(F.col("timestamp")), F.col("sensor_id"), F.col("anomaly_type"),
        F.upper(F.col("severity")), fmt_num(F.col("confidence_score") * 100.0, 2),
        fmt_num(F.col("value"), 2), fmt_num(F.col("expected_range.lower"), 2),
        fmt_num(F.col("expected_range.upper"), 2), F.coalesce(F.col("root_cause_summary"), F.lit("None")),
        attribution_lines(ranked(F.col("feature_attribution"))), metadata_json(F.col("metadata")))


def sms_text() -> Column:
    """A12."""
    return F.format_string("ALERT: %s - %s (%s) at %s. Value: %s",
                           F.col("sensor_id"), F.col("anomaly_type"), F.col("severity"),
                           F.date_format(F.col("timestamp"), "HH:mm"), fmt_num(F.col("value"), 1))


def email_outbox(alerts: DataFrame, routes: Routes) -> DataFrame:
    if not routes.email:
        return _nothing(alerts)
    return alerts.select(
        "sensor_id", "timestamp", F.lit("email").alias("channel"), F.lit(routes.email_sender).alias("from"),
        F.lit(", ".join(routes.email)).alias("to"),
        email_subject().alias("subject"), email_body().alias("body"))


def sms_outbox(alerts: DataFrame, routes: Routes) -> DataFrame:
    """Only high and critical alerts produce a text message."""
    if not routes.sms:
        return _nothing(alerts)
    none = F.lit(None).cast("string")
    return (alerts.filter(F.col("severity").isin("high", "critical"))
                  .select("sensor_id", "timestamp", F.lit("sms").alias("channel"), none.alias("from"),
                          F.lit(", ".join(routes.sms)).alias("to"), none.alias("subject"), sms_text().alias("body")))


def _nothing(alerts: DataFrame) -> DataFrame:
    text = ("channel", "from", "to", "subject", "body")
    return alerts.filter(F.lit(False)).select("sensor_id", "timestamp", *[F.lit(None).cast("string").alias(c) for c in text])


Channel = Callable[[DataFrame, Routes], DataFrame]
CHANNELS: Mapping[str, Channel] = {"email": email_outbox, "sms": sms_outbox}


def route_alerts(alerts: DataFrame, routes: Routes, extra: Mapping[str, Channel] | None = None) -> DataFrame:
    """Alert x channel with recipients -> outbox rows.  ``extra`` adds or replaces channels by name."""
    out = _nothing(alerts)
    for channel in {**CHANNELS, **(extra or {})}.values():
        out = out.unionByName(channel(alerts, routes))
    return out
