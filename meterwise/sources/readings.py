"""Batch sources (S1) and input cleaning at the edge (F1, NaN folding).

``read_readings`` accepts parquet, CSV, JSON or a table name and returns the
canonical readings: ``sensor_id STRING, timestamp TIMESTAMP_NTZ, value DOUBLE,
row_id BIGINT`` plus any pass-through columns.  Rows whose timestamp cannot be
parsed, or without timestamp or sensor, are not silently lost: ``quarantine`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.numeric import fold_nan

_BAD = "_bad_reason"


def _parse_ts(c: Column, dtype: T.DataType, fmt: str | None) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        # instants are rendered as wall clock of the session zone (UTC)
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
        return parsed.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):  # epoch seconds
        return F.timestamp_seconds(c.cast("double")).cast("timestamp_ntz")
    raise TypeError(f"unsupported timestamp type {dtype}")


def _tag(df: DataFrame, sensor_col: str, ts_col: str, value_col: str,
         row_id_col: str | None, ts_format: str | None) -> DataFrame:
    fields = {f.name: f.dataType for f in df.schema.fields}
    ts = _parse_ts(F.col(ts_col), fields[ts_col], ts_format)
    value = F.col(value_col)
    if not isinstance(fields[value_col], T.DoubleType):
        value = value.try_cast("double")
    rid = F.col(row_id_col).cast("bigint") if row_id_col else F.lit(None).cast("bigint")
    passthrough = [c for c in df.columns if c not in {sensor_col, ts_col, value_col, row_id_col}]
    return df.select(
        F.col(sensor_col).cast("string").alias("sensor_id"),
        ts.alias("timestamp"),
        fold_nan(value).alias("value"),
        rid.alias("row_id"),
        *passthrough,
        F.when(F.col(ts_col).isNull(), F.lit("missing timestamp"))
         .when(ts.isNull(), F.lit("unparsable timestamp"))
         .when(F.col(sensor_col).isNull(), F.lit("missing sensor")).alias(_BAD),
    )


def normalize_readings(df: DataFrame, sensor_col: str = "sensor_id", ts_col: str = "timestamp",
                       value_col: str = "value", row_id_col: str | None = None,
                       ts_format: str | None = None) -> DataFrame:
    """Typed readings; rows without a usable timestamp or sensor are removed:
    ``quarantine`` returns exactly those."""
    if row_id_col is None and "row_id" in df.columns:
        row_id_col = "row_id"
    t = _tag(df, sensor_col, ts_col, value_col, row_id_col, ts_format)
    return t.filter(F.col(_BAD).isNull()).drop(_BAD)


def quarantine(df: DataFrame, sensor_col: str = "sensor_id", ts_col: str = "timestamp",
               value_col: str = "value", row_id_col: str | None = None,
               ts_format: str | None = None) -> DataFrame:
    """Rows without a usable timestamp or sensor, with the original text and the reason:
    kept rows and quarantined rows add up to the input."""
    if row_id_col is None and "row_id" in df.columns:
        row_id_col = "row_id"
    t = _tag(df.withColumn("_raw_ts", F.col(ts_col).cast("string")), sensor_col, ts_col,
             value_col, row_id_col, ts_format)
    return (t.filter(F.col(_BAD).isNotNull())
             .select("sensor_id", F.col("_raw_ts").alias("raw_timestamp"), "value", "row_id",
                     F.col(_BAD).alias("reason")))


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet", *,
                  schema: T.StructType | str | None = None, sensor_col: str = "sensor_id",
                  ts_col: str = "timestamp", value_col: str = "value",
                  row_id_col: str | None = None, ts_format: str | None = None,
                  options: dict | None = None) -> DataFrame:
    """Scan a file set (parquet / csv / json) or a catalog table.

    Column pruning and filters placed on the result reach the scan."""
    if fmt == "table":
        raw = spark.read.table(path)
    else:
        r = spark.read.format(fmt)
        if fmt == "csv":
            r = r.option("header", True)
        for k, v in (options or {}).items():
            r = r.option(k, v)
        if schema is not None:
            r = r.schema(schema)
        raw = r.load(path)
    return normalize_readings(raw, sensor_col, ts_col, value_col, row_id_col, ts_format)
