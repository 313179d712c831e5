"""Readers that turn files, tables and streams into typed readings."""

from .readings import normalize_readings, quarantine, read_readings
from .fixtures import hourly_by_type, raw_by_type, raw_by_user, orders_by_priority, resample_hourly, load_table
from .stream import read_reading_stream, parse_json_payload, quarantine_json_payload

__all__ = [
    "normalize_readings", "quarantine", "read_readings",
    "hourly_by_type", "raw_by_type", "raw_by_user", "orders_by_priority",
    "resample_hourly", "load_table", "read_reading_stream", "parse_json_payload", "quarantine_json_payload",
]
