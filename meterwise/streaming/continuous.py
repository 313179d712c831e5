"""Continuous mode - features that run across micro-batches.

Per sensor a stateful processor keeps the last 168 cleaned values, the scaler
(fitted once, on the sensor's first ``min_points`` rows in order), the place of
the last row given out, and a list of rows that wait.  A row waits until the
watermark (greatest event time seen, less ``watermark``) has passed it; then no
earlier row is expected and it is given out in (timestamp, row_id, value)
order, so the result does not depend on how rows are cut into micro-batches or
shuffled within the watermark.  Missing values wait for the next known value of
the sensor, as interpolation needs both ends.  An event-time timer per sensor
wakes it when its next row is due, also if the sensor itself is silent; a gap
whose right end has not come when the watermark is ``gap_timeout`` behind its
first row is closed as at the end of a series: the last value is repeated.

A row behind the last one given out is older than the watermark.  It cannot be
put in order any more and is given out at once with ``late`` set and without
features, so that no row is lost silently.  Spark itself drops what is older
than its own watermark; that one lies ``GRACE_DAYS`` further back.  Event times
must therefore lie after 1980.

Each row also brings the row half a period before it, whose centred trend it
completes (``centre_*``), so that the seasonal detector needs no state of its own.
``start_continuous_detection`` runs the statistical and the seasonal detector on
every micro-batch with the newest version of a model table
(``operators.models``) and publishes features and detections together.

Rows of the sensor ``HEARTBEAT`` only advance the watermark.  One far behind
the data closes the stream: everything that waits is given out, trailing gaps
included, as in the batch job.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import ROLLING_WINDOWS, SCALED_FEATURES, DetectionConfig
from ..operators.models import DetectionModels, detections
from ..sources.commits import CommitLog

RING = max(ROLLING_WINDOWS)
SCALED = tuple(SCALED_FEATURES)
GRACE_DAYS = 3650
HEARTBEAT = "__heartbeat__"
STREAM_SCHEMA = "timestamp timestamp_ntz, value double, row_id bigint, sensor_id string"
_NO_ROW = -(1 << 63)  # sorts as a missing row_id does: first

OUTPUT = T.StructType([
    T.StructField("sensor_id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("value", T.DoubleType()),
    *[T.StructField(f"rolling_{s}_{k}", T.DoubleType()) for k in ROLLING_WINDOWS for s in ("mean", "std")],
    T.StructField("rate_of_change", T.DoubleType()),
    T.StructField("rate_of_change_abs", T.DoubleType()),
    T.StructField("value_scaled", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("conf_statistical", T.DoubleType()),
    T.StructField("pos", T.LongType()),
    T.StructField("centre_timestamp", T.TimestampNTZType()),
    T.StructField("centre_row_id", T.LongType()),
    T.StructField("centre_value", T.DoubleType()),
    T.StructField("centre_trend", T.DoubleType()),
    T.StructField("late", T.BooleanType()),
])
SERIES = T.StructType([
    T.StructField("ring", T.ArrayType(T.DoubleType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("scales", T.ArrayType(T.DoubleType())),
    T.StructField("first", T.ArrayType(T.DoubleType())),
    T.StructField("last_us", T.LongType()),
    T.StructField("last_row", T.LongType()),
    T.StructField("last_value", T.DoubleType()),
    T.StructField("count", T.LongType()),
    T.StructField("half_us", T.ArrayType(T.LongType())),
    T.StructField("half_row", T.ArrayType(T.LongType())),
])
#: Waiting rows are kept as the bytes of ``HELD`` records, ``HELD_ROWS`` a list element: the state server is asked once for
#: many rows, not for each.  A missing value is NaN.
WAITING = T.StructType([T.StructField("rows", T.BinaryType())])
HELD = np.dtype([("us", "<i8"), ("row", "<i8"), ("value", "<f8")])
HELD_ROWS = 1 << 13


def _features(values: np.ndarray, n_new: int) -> pd.DataFrame:
    s = pd.Series(values, dtype=float)
    out = {}
    for k in ROLLING_WINDOWS:
        out[f"rolling_mean_{k}"] = s.rolling(k, min_periods=1).mean()
        out[f"rolling_std_{k}"] = s.rolling(k, min_periods=1).std()
    d = s.diff()
    out["rate_of_change"] = d
    out["rate_of_change_abs"] = d.abs()
    f = pd.DataFrame(out)
    f.insert(0, "value", s)
    return f.iloc[len(values) - n_new:].reset_index(drop=True)


def _order(rows: np.ndarray) -> np.ndarray:
    """The order of the rows of a sensor: timestamp, row_id, value, missing ones first."""
    return np.lexsort((_rank(rows["value"]), rows["row"], rows["us"]))


def _rank(value: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(value), -np.inf, value)


def _before(rows: np.ndarray, last: tuple) -> np.ndarray:
    """Whether each row is in front of the place (timestamp, row_id, value)."""
    us, row, value = last
    value = -np.inf if value is None or value != value else value
    return (rows["us"] < us) | (rows["us"] == us) & ((rows["row"] < row) | (rows["row"] == row) & (_rank(rows["value"]) < value))


def _row_ids(rows: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(rows.astype(np.int64), rows == _NO_ROW)


def _held(pdf: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(pdf), HELD)
    out["us"] = pdf["timestamp"].astype("datetime64[us]").astype("int64")
    # One missing id makes pandas read all as doubles, unless the column is of its own integer type.
    out["row"] = pd.to_numeric(pdf["row_id"]).astype("Int64").fillna(_NO_ROW).astype("int64")
    out["value"] = pdf["value"].astype(float)
    return out


def _nullable(xs) -> list:
    return [None if x is None or x != x else float(x) for x in xs]


class SeriesProcessor(StatefulProcessor):
    """State and timers of one sensor (see the module's text)."""

    def __init__(self, cfg: DetectionConfig, grace_ms: int, gap_ms: int):
        self.min_points, self.z_threshold = max(cfg.min_points, 1), cfg.z_threshold
        self.grace_ms, self.gap_ms = grace_ms, gap_ms
        self.period, self.half = cfg.period, cfg.half_period
        self.ring_rows = max(RING, self.period + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", SERIES)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sensor = key[0]
        state = self.series.get() if self.series.exists() else None
        last = tuple(state[4:7]) if state is not None and state[4] is not None else None
        held = self._waiting_rows()
        for pdf in rows:
            if sensor == HEARTBEAT:
                continue
            new = _held(pdf)
            late = _before(new, last) if last is not None else np.zeros(len(new), bool)
            if late.any():
                yield self._late(sensor, new[late])
            held.append(new[~late])
        yield from self._give_out(sensor, state, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.series.get() if self.series.exists() else None
        yield from self._give_out(key[0], state, self._waiting_rows(), timerValues.getCurrentWatermarkInMs())

    def _waiting_rows(self) -> list[np.ndarray]:
        return [np.frombuffer(r[0], HELD) for r in self.waiting.get()] if self.waiting.exists() else []

    def close(self) -> None:
        pass

    def _late(self, sensor: str, rows: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({f.name: pd.Series([None] * len(rows), dtype="float64") for f in OUTPUT.fields})
        out["sensor_id"], out["late"] = sensor, True
        out["timestamp"] = rows["us"].astype("datetime64[us]")
        out["row_id"] = _row_ids(rows["row"])
        out["value"] = rows["value"]
        out["centre_timestamp"] = pd.Series(pd.NaT, index=range(len(rows)), dtype="datetime64[us]")
        out["pos"] = out["centre_row_id"] = pd.array([None] * len(rows), dtype="Int64")
        return out

    def _give_out(self, sensor: str, state, held: list[np.ndarray], spark_watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = np.concatenate([np.empty(0, HELD), *held])
        held = held[_order(held)]
        # 0: no watermark yet
        horizon = (spark_watermark_ms + self.grace_ms) * 1000 if spark_watermark_ms > 0 else -(1 << 62)
        due = int(np.searchsorted(held["us"], horizon, "left"))
        ring, means, scales, first = ([], None, None, []) if state is None else (list(state[0] or []), state[1], state[2], list(state[3] or []))
        count, half_us, half_row = (0, [], []) if state is None else (state[7], list(state[8] or []), list(state[9] or []))
        known = np.flatnonzero(~np.isnan(held["value"][:due]))
        cut = int(known[-1]) + 1 if len(known) else 0
        closed = cut < due and int(held["us"][cut]) + self.gap_ms * 1000 < horizon
        if closed or (not ring and not len(known)):  # a leading gap has no value to go on from
            cut = due
        rows, held = held[:cut], held[cut:]
        if len(rows):
            before = np.array(ring, dtype=float)
            filled = pd.Series(np.concatenate([before[-1:], rows["value"]])).interpolate("linear", limit_area="inside").ffill().iloc[len(ring[-1:]):]
            whole = filled.notna().to_numpy()  # leading gaps stay missing: dropped as in the batch job
            ready, places = filled[whole].to_numpy(), rows[whole]
            if len(ready):
                values = np.concatenate([before, ready])
                frame, means, scales, first = self._scaled(_features(values, len(ready)), means, scales, first)
                frame.insert(0, "row_id", _row_ids(places["row"]))
                frame.insert(0, "timestamp", places["us"].astype("datetime64[us]"))
                frame.insert(0, "sensor_id", sensor)
                frame["late"] = False
                times, ids = (np.concatenate([np.array(a, np.int64), b]) for a, b in ((half_us, places["us"]), (half_row, places["row"])))
                self._centres(frame, values, times, ids, count)
                ring = values[-self.ring_rows:].tolist()
                count, half_us, half_row = count + len(ready), times[-self.half:].tolist(), ids[-self.half:].tolist()
                yield frame[[f.name for f in OUTPUT.fields]]
            us, row, value = rows[-1].item()
            self.series.update((_nullable(ring), means, scales, _nullable(first), us, row, None if value != value else value, count, half_us, half_row))
        if len(held):
            self.waiting.put([(held[i:i + HELD_ROWS].tobytes(),) for i in range(0, len(held), HELD_ROWS)])
        else:
            self.waiting.clear()
        self._wake(held["us"], due - cut, spark_watermark_ms)

    def _centres(self, frame: pd.DataFrame, values: np.ndarray, times: np.ndarray, ids: np.ndarray, count: int) -> None:
        """Position of each row, and place, value and centred trend (as in ``features.centred_trend``) of the row half a period before it."""
        n, h = len(frame), self.half
        frame["pos"] = np.arange(count, count + n)
        end = np.arange(len(values) - n, len(values))  # each new row within ``values``
        start = end - 2 * h  # the first row of the trend's window
        ok = start >= 0
        trend, value = np.full(n, np.nan), np.full(n, np.nan)
        lo, hi = start[ok], end[ok]
        if len(lo):
            even = self.period % 2 == 0
            inner = np.lib.stride_tricks.sliding_window_view(values, 2 * h - 1 if even else 2 * h + 1)
            first = lo + 1 if even else lo
            sums = np.concatenate([inner[first[i:i + HELD_ROWS]].sum(axis=1) for i in range(0, len(first), HELD_ROWS)])
            trend[ok] = (sums + 0.5 * values[lo] + 0.5 * values[hi] if even else sums) / self.period
        value[ok] = values[hi - h]
        at = np.arange(len(times) - n, len(times)) - h
        some = ok & (at >= 0)
        stamps, rows = np.full(n, np.datetime64("NaT"), "datetime64[us]"), np.full(n, _NO_ROW)
        stamps[some], rows[some] = times[at[some]].astype("datetime64[us]"), ids[at[some]]
        frame["centre_timestamp"], frame["centre_row_id"] = stamps, _row_ids(rows)
        frame["centre_value"], frame["centre_trend"] = value, trend

    def _wake(self, us: np.ndarray, gap: int, spark_watermark_ms: int) -> None:
        """One timer: when the next row is due, or the open gap (the first ``gap`` rows) is to be closed."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        at = [int(us[0]) // 1000 + self.gap_ms] if gap else []
        at += [int(us[gap]) // 1000] if gap < len(us) else []
        if at:
            self.handle.registerTimer(max(min(at) + 1 - self.grace_ms, spark_watermark_ms + 1, 1))

    def _scaled(self, feats: pd.DataFrame, means, scales, first: list):
        """Scaled value, z and confidence; scales from the last row of the fit on."""
        n_new, wide = len(feats), len(SCALED)
        unscaled = 0
        if means is None:
            more = feats[list(SCALED)].iloc[:self.min_points - len(first) // wide]
            first = first + more.to_numpy(dtype=float).ravel().tolist()
            unscaled = n_new
            if len(first) // wide == self.min_points:
                unscaled = len(more) - 1
                fit = pd.DataFrame(np.array([np.nan if x is None else x for x in first], dtype=float).reshape(-1, wide), columns=list(SCALED))
                first = []
                means = [float(np.nanmean(fit[c])) if fit[c].notna().any() else 0.0 for c in SCALED]
                sd = [float(np.nanstd(fit[c])) if fit[c].notna().any() else 1.0 for c in SCALED]
                scales = [x if x > 0 else 1.0 for x in sd]
        out = feats.copy()
        vs = (feats["value"] - means[0]) / scales[0] if means is not None else pd.Series([np.nan] * n_new)
        vs.iloc[:unscaled] = np.nan
        z = vs.abs()
        out["value_scaled"], out["z"] = vs.to_numpy(), z.to_numpy()
        out["conf_statistical"] = np.where(z > self.z_threshold, np.minimum(z / self.z_threshold, 1.0), np.nan)
        return out, means, scales, first


def continuous_features(stream: DataFrame, cfg: DetectionConfig | None = None, watermark: str = "2 hours",
                        gap_timeout: str = "365 days") -> DataFrame:
    """Needs the RocksDB state store when it is started: see ``rocksdb_state``."""
    cfg = cfg or DetectionConfig(min_points=10)
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    grace = GRACE_DAYS * 86_400_000
    # watermarks need an instant type: event_time is the wall clock read in
    # the session zone (UTC)
    row_id = F.col("row_id").cast("bigint") if "row_id" in stream.columns else F.lit(None).cast("bigint")
    s = (stream.select("sensor_id", "timestamp", "value", row_id.alias("row_id"),
                       F.col("timestamp").cast("timestamp").alias("event_time"))
               .withWatermark("event_time", f"{ms(watermark) + grace} milliseconds"))
    return s.groupBy("sensor_id").transformWithStateInPandas(
        SeriesProcessor(cfg, grace, ms(gap_timeout)), OUTPUT, "Append", "EventTime")


def heartbeat(spark: SparkSession, at: datetime) -> DataFrame:
    """One row that only advances the watermark to ``at``."""
    return spark.createDataFrame([(at, None, None, HEARTBEAT)], STREAM_SCHEMA)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State lists and timers need the RocksDB state store; a query keeps the setting it was started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def start_continuous(stream: DataFrame, out: str, checkpoint_location: str,
                     cfg: DetectionConfig | None = None, watermark: str = "2 hours",
                     available_now: bool = False, gap_timeout: str = "365 days"):
    w = (continuous_features(stream, cfg, watermark, gap_timeout).writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint_location).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    with rocksdb_state(stream.sparkSession):
        return w.start()


def start_continuous_detection(stream: DataFrame, out: str, checkpoint_location: str, models: str, cfg: DetectionConfig | None = None,
                               watermark: str = "2 hours", available_now: bool = False, gap_timeout: str = "365 days"):
    """Features and detections of every micro-batch under ``<out>/features`` and ``<out>/detections``, published together
    (``read_committed``).  The detections are those of the newest version of the model table ``models`` at that time."""
    cfg = cfg or DetectionConfig(min_points=10)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, out)
        log.own(checkpoint_location)
        if log.committed(batch_id):
            return
        batch.write.mode("overwrite").parquet(f"{out}/features/batch_id={batch_id}")
        features = spark.read.schema(batch.schema).parquet(f"{out}/features/batch_id={batch_id}")
        version, model = DetectionModels(spark, models).latest()
        detections(features, model, cfg).write.mode("overwrite").parquet(f"{out}/detections/batch_id={batch_id}")
        log.commit(batch_id, tables=["features", "detections"], model_version=version)

    w = (continuous_features(stream, cfg, watermark, gap_timeout).writeStream.foreachBatch(process)
         .option("checkpointLocation", checkpoint_location).outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    with rocksdb_state(stream.sparkSession):
        return w.start()
