"""Schemas of the engine's tables."""

from pyspark.sql import types as T

READINGS = T.StructType([
    T.StructField("sensor_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("row_id", T.LongType(), True),
])

# raw input as it arrives on a stream or in text files
RAW_READINGS = T.StructType([
    T.StructField("sensor_id", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
])

RANGE = T.StructType([
    T.StructField("lower", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
])

SCALER_MODEL = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("n", T.LongType()),
    T.StructField("fitted_at", T.TimestampNTZType()),
])

FOREST = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("psi", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("size", T.ArrayType(T.IntegerType())),
])

DETECTION = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("detector", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])

ALERT_COLUMNS = (
    "timestamp", "sensor_id", "anomaly_type", "severity", "value", "value_scaled",
    "expected_range", "expected_range_scaled", "confidence_score",
    "root_cause_summary", "feature_attribution", "metadata",
)

OUTBOX_COLUMNS = ("sensor_id", "timestamp", "channel", "from", "to", "subject", "body")
