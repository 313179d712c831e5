import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.config import DetectionConfig, Routes
from meterwise.operators.features import series_frame
from meterwise.plans import detect_alerts
from meterwise.sources import hourly_by_type
from meterwise.operators.registry import ScalerRegistry
from meterwise.operators.scaler import fit_new_sensors, fit_scaler
from meterwise.sources.commits import CommitLog
from meterwise.streaming import heartbeat, microbatch, read_committed, run_batch_isolated, start_continuous
from meterwise.plans.extra import STREAM_SCHEMA

TWO = DetectionConfig(detectors=("statistical", "seasonal"), min_points=10, routes=Routes(email=("a@example.org",)))


def test_batch_isolated_equals_batch(spark):
    run = tempfile.mkdtemp(prefix="mw-stream-")
    h = hourly_by_type(spark, "/root/testdata/sf0.001")
    h.repartition("sensor_id").write.partitionBy("sensor_id").parquet(f"{run}/in")
    stream = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    got = run_batch_isolated(stream, f"{run}/out", f"{run}/ck", TWO)
    want = detect_alerts(h, TWO)
    key = lambda df: sorted((r.sensor_id, str(r.timestamp), r.anomaly_type, r.severity)
                            for r in df.select("sensor_id", "timestamp", "anomaly_type", "severity").collect())
    assert key(got) == key(want)
    assert got.select("batch_id").distinct().count() == 5
    # replay of a batch overwrites its own partition
    outbox = spark.read.parquet(f"{run}/out/outbox")
    assert outbox.count() == got.count()
    # one processing time per batch, the same in the alert and in its e-mail
    times = {(r.batch_id, r.metadata.processing_time) for r in got.collect()}
    assert len(times) == 5
    stamps = {t.isoformat() for _, t in times}
    assert all(any(s in r.body for s in stamps) for r in outbox.collect())


CLOSE = datetime(2030, 1, 1)


def _stream(spark, folder, files=1):
    return (spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder))


def _continuous(spark, batches, cfg, close=True, **options):
    run = tempfile.mkdtemp(prefix="mw-cuts-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, STREAM_SCHEMA).coalesce(1).write.parquet(f"{run}/in/part{i:03d}")
    if close:
        heartbeat(spark, CLOSE).coalesce(1).write.parquet(f"{run}/in/part{len(batches):03d}")
    q = start_continuous(_stream(spark, f"{run}/in"), f"{run}/out", f"{run}/ck", cfg, available_now=True, **options)
    q.awaitTermination()
    return spark.read.parquet(f"{run}/out").toPandas().sort_values(["late", "sensor_id", "timestamp", "row_id"]).reset_index(drop=True)


def _same(got, want, columns):
    m = want.merge(got, on=["sensor_id", "row_id"], suffixes=("", "_s"))
    assert len(m) == len(want) == len(got)
    for c in columns:
        x, y = m[c].to_numpy(dtype=float), m[f"{c}_s"].to_numpy(dtype=float)
        assert np.allclose(x, y, equal_nan=True, atol=1e-6), c


def _readings(n=240, sensors="ab", seed=4, missing=0.2, tail=6):
    rnd = np.random.default_rng(seed)
    return [(datetime(2024, 1, 1) + timedelta(hours=i // 2), None if rnd.random() < missing or i >= n - tail else float(x), i, s)
            for s in sensors for i, x in enumerate(rnd.normal(10, 3, n))]


@pytest.mark.parametrize("cuts", [1, 3, 20])
def test_shuffled_stream_equals_the_batch_features(spark, cuts):
    """Rows delayed by up to 12 hours, gaps, a trailing gap: the batch job's rows, however they are cut."""
    rows, rnd = _readings(), np.random.default_rng(cuts)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0] + timedelta(hours=float(rnd.uniform(0, 12))))
    parts = [[rows[j] for j in rnd.permutation(p)] for p in np.array_split(order, cuts)]
    got = _continuous(spark, parts, TWO, watermark="12 hours")
    want = series_frame(spark.createDataFrame(rows, STREAM_SCHEMA), TWO).toPandas()
    assert not got.late.any() and set(got.sensor_id) == {"a", "b"}
    _same(got, want, ("value", "rolling_mean_12", "rolling_mean_168", "rolling_std_24", "rate_of_change"))


def test_rows_are_given_out_behind_the_watermark_only(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), float(i), i, "s") for i in range(40)]
    got = _continuous(spark, [rows[:30], rows[30:]], TWO, close=False, watermark="5 hours")
    assert got.row_id.tolist() == list(range(34))  # the greatest time is that of row 39


def test_a_silent_sensor_is_woken_by_its_timer(spark):
    start = datetime(2024, 1, 1)
    quiet = [(start + timedelta(hours=i), float(i), i, "quiet") for i in range(5)]
    busy = [[(start + timedelta(hours=10 * b + i), 1.0, 10 * b + i, "busy") for i in range(10)] for b in range(3)]
    got = _continuous(spark, [quiet + busy[0], busy[1], busy[2]], TWO, close=False, watermark="2 hours")
    assert (got.sensor_id == "quiet").sum() == 5


def test_an_open_gap_is_closed_after_its_timeout(spark):
    start = datetime(2024, 1, 1)
    gap = [(start + timedelta(hours=i), 7.0 if i < 3 else None, i, "gap") for i in range(6)]
    later = [(start + timedelta(hours=h), 1.0, 100 + h, "other") for h in (8, 40, 41)]
    got = _continuous(spark, [gap, later], TWO, close=False, watermark="1 hour", gap_timeout="24 hours")
    g = got[got.sensor_id == "gap"]
    assert g.value.tolist() == [7.0] * 6


def test_late_rows_are_marked(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), float(i), i, "s") for i in range(40)]
    got = _continuous(spark, [rows[10:], rows[:2], rows[2:10]], TWO, watermark="2 hours")
    assert len(got) == 40 and got.late.sum() == 8
    late = got[got.late]  # rows 0 and 1 came before anything was given out: they are in order
    assert late.rolling_mean_12.isna().all() and sorted(late.value) == list(range(2, 10))
    # within the watermark nothing is late
    got = _continuous(spark, [rows[10:], rows[:10]], TWO, watermark="40 hours")
    assert len(got) == 40 and not got.late.any()


def test_continuous_restart_goes_on_from_its_state(spark):
    rows, run = _readings(), tempfile.mkdtemp(prefix="mw-restart-")
    rows.sort(key=lambda r: r[0])
    for i, part in enumerate((rows[:200], rows[200:])):
        spark.createDataFrame(part, STREAM_SCHEMA).coalesce(1).write.parquet(f"{run}/in/part{i}")
        if i:
            heartbeat(spark, CLOSE).coalesce(1).write.parquet(f"{run}/in/part9")
        start_continuous(_stream(spark, f"{run}/in"), f"{run}/out", f"{run}/ck", TWO, available_now=True).awaitTermination()
    got = spark.read.parquet(f"{run}/out").toPandas()
    want = series_frame(spark.createDataFrame(rows, STREAM_SCHEMA), TWO).toPandas()
    _same(got, want, ("value", "rolling_mean_168", "rate_of_change"))


def test_continuous_scaling_does_not_depend_on_batch_cuts(spark):
    rnd = np.random.default_rng(4)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i // 2), float(x), i, "s") for i, x in enumerate(rnd.normal(10, 3, 40))]
    cfg = DetectionConfig(detectors=("statistical",), min_points=10)
    whole = _continuous(spark, [rows], cfg)
    assert not whole.late.any() and whole.value_scaled.notna().sum() == 31
    for cuts in ([rows[:7], rows[7:13], rows[13:]], [rows[::-1][20:], rows[::-1][:20]]):
        got = _continuous(spark, cuts, cfg)
        assert len(got) == 40 and not got.late.any()
        for c in ("value", "rolling_mean_12", "value_scaled", "z"):
            assert np.allclose(got[c].astype(float), whole[c].astype(float), equal_nan=True), c


# ------------------------------------------------------------------ commits
def _hourly(spark, run, sensors=2):
    h = hourly_by_type(spark, "/root/testdata/sf0.001")
    names = sorted(r[0] for r in h.select("sensor_id").distinct().collect())[:sensors]
    rows = h.filter(F.col("sensor_id").isin(names)).select("timestamp", "value", "row_id", "sensor_id")
    for n in names:
        rows.filter(F.col("sensor_id") == n).coalesce(1).write.parquet(f"{run}/in/{n}")
    return rows


def _alert_keys(df):
    return sorted((r.sensor_id, str(r.timestamp), r.anomaly_type, r.severity) for r in df.select("sensor_id", "timestamp", "anomaly_type", "severity").collect())


def test_a_run_stopped_between_two_tables_neither_loses_nor_repeats_alerts(spark, monkeypatch):
    run = tempfile.mkdtemp(prefix="mw-stop-")
    rows = _hourly(spark, run)
    route, calls = microbatch.route_alerts, []

    def stops_once(alerts, routes):
        calls.append(1)
        if len(calls) == 2:  # the second batch: its alerts are written, its outbox is not
            raise RuntimeError("stopped")
        return route(alerts, routes)

    monkeypatch.setattr(microbatch, "route_alerts", stops_once)
    with pytest.raises(Exception, match="stopped"):
        run_batch_isolated(_stream(spark, f"{run}/in"), f"{run}/out", f"{run}/ck", TWO)
    assert CommitLog(spark, f"{run}/out").batches() == [0]
    seen = read_committed(spark, f"{run}/out", "alerts")
    assert seen.select("batch_id").distinct().count() == 1  # the half-written batch is not seen
    assert read_committed(spark, f"{run}/out", "outbox").count() == seen.count()
    first = CommitLog(spark, f"{run}/out").entry(0)
    got = run_batch_isolated(_stream(spark, f"{run}/in"), f"{run}/out", f"{run}/ck", TWO)
    assert _alert_keys(got) == _alert_keys(detect_alerts(rows, TWO))
    assert read_committed(spark, f"{run}/out", "outbox").count() == got.count()
    assert CommitLog(spark, f"{run}/out").entry(0) == first


def test_a_committed_batch_is_not_written_again(spark):
    run = tempfile.mkdtemp(prefix="mw-replay-")
    rows = _hourly(spark, run, 1)
    process = microbatch._writer(f"{run}/out", TWO, f"{run}/ck", None, None)
    process(rows, 0)
    before = read_committed(spark, f"{run}/out", "alerts").collect()
    process(rows.limit(0), 0)
    assert read_committed(spark, f"{run}/out", "alerts").collect() == before
    with pytest.raises(ValueError, match="belongs to the stream"):
        microbatch._writer(f"{run}/out", TWO, f"{run}/other", None, None)(rows, 0)


def test_commit_is_published_once(spark):
    log = CommitLog(spark, tempfile.mkdtemp(prefix="mw-log-") + "/out")
    assert log.batches() == [] and not log.committed(3)
    assert log.commit(3, a=1) and not log.commit(3, a=2)
    assert log.batches() == [3] and log.entry(3) == {"a": 1}
    with pytest.raises(ValueError, match="no batch"):
        CommitLog(spark, tempfile.mkdtemp(prefix="mw-log-")).read("alerts")


# ------------------------------------------------------------------ scaler registry
def test_second_micro_batch_is_scaled_by_the_first_model(spark):
    run = tempfile.mkdtemp(prefix="mw-reg-")
    rows = hourly_by_type(spark, "/root/testdata/sf0.01").filter(F.col("sensor_id").isin("click", "view")).select("timestamp", "value", "row_id", "sensor_id").cache()
    early = F.col("timestamp") < F.lit("2024-01-16").cast("timestamp_ntz")
    first = rows.filter(early & (F.col("sensor_id") == "click"))
    for i, part in enumerate((first, rows.filter(~early))):
        part.coalesce(1).write.parquet(f"{run}/in/part{i}")
        alerts = run_batch_isolated(_stream(spark, f"{run}/in"), f"{run}/out", f"{run}/ck", TWO, registry=f"{run}/models")  # the second run is a restart
    models = {(r.sensor_id, r.feature): r for r in ScalerRegistry(spark, f"{run}/models").models().collect()}
    assert {(s, m.version) for (s, f), m in models.items()} == {("click", 0), ("view", 1)}
    want = {r.feature: r for r in fit_scaler(series_frame(first, TWO), TWO).collect()}
    assert abs(models["click", "value"].mean - want["value"].mean) < 1e-9
    late = [r for r in alerts.collect() if r.sensor_id == "click" and r.batch_id == 1]
    assert late and all(abs(r.value_scaled - (r.value - want["value"].mean) / want["value"].scale) < 1e-6 for r in late)


def test_registry_keeps_first_models_in_batch_jobs_too(spark):
    from helpers import series
    reg = ScalerRegistry(spark, tempfile.mkdtemp(prefix="mw-reg-") + "/m")
    assert reg.models().count() == 0
    a, b = series(spark, [float(i) for i in range(20)], "a"), series(spark, [float(5 * i) for i in range(20)], "b")
    one = reg.register(a, TWO).collect()
    again = reg.register(a.withColumn("value", F.col("value") * 3), TWO).collect()
    assert sorted(map(str, one)) == sorted(map(str, again)) and reg.log.batches() == [0]
    both = reg.register(a.unionByName(b), TWO)
    assert {(r.sensor_id, r.version) for r in both.select("sensor_id", "version").distinct().collect()} == {("a", 0), ("b", 1)}
    assert reg.register(series(spark, [1.0, 2.0], "short"), TWO).count() == both.count()  # under min_points: no model yet
    assert fit_new_sensors(series_frame(a.unionByName(b), TWO), reg.models().filter("sensor_id = 'a'"), TWO).select("sensor_id").distinct().collect() == [("b",)]


# ------------------------------------------------------------------ quarantine of streams
def test_kept_and_quarantined_messages_are_all_messages(spark):
    run = tempfile.mkdtemp(prefix="mw-quar-")
    good = [f'{{"sensor_id": "m{i % 2}", "timestamp": "2024-01-01T{i:02d}:00:00Z", "value": {i}}}' for i in range(24)]
    bad = ["{broken", '{"sensor_id": "m0", "timestamp": "soon", "value": 1}', '{"timestamp": "2024-01-01T00:00:00Z", "value": 1}', "", None]
    messages = [(m,) for m in good + bad]
    for i in range(2):
        spark.createDataFrame(messages[i::2], "value string").coalesce(1).write.parquet(f"{run}/in/part{i}")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{run}/in")
    out = f"{run}/out"
    for _ in range(2):  # the second run has nothing new
        run_batch_isolated(stream, out, f"{run}/ck", TWO, payload="value")
        kept, spoilt = read_committed(spark, out, "readings"), read_committed(spark, out, "quarantine")
        assert (kept.count(), spoilt.count()) == (24, 5)
    process = microbatch._writer(out, TWO, f"{run}/ck", None, "value")
    process(spark.createDataFrame(messages, "value string"), 0)  # a replay
    assert (read_committed(spark, out, "readings").count(), read_committed(spark, out, "quarantine").count()) == (24, 5)
    assert {r.reason for r in spoilt.collect()} == {"missing timestamp", "unparsable timestamp", "missing sensor"}


# ------------------------------------------------------------------ detectors in continuous mode
def _pairs(df):
    return {(r.sensor_id, r.row_id, r.detector): r.confidence for r in df.collect()}


def _batch_pairs(frame, cfg):
    from meterwise.operators.seasonal import seasonal_detect
    from meterwise.operators.statistical import statistical_detect
    out = {}
    for name, rows in (("statistical", statistical_detect(frame, cfg)), ("seasonal", seasonal_detect(frame, cfg))):
        out |= {(r.sensor_id, r.row_id, name): r[f"conf_{name}"] for r in rows.filter(f"conf_{name} is not null").collect()}
    return out


@pytest.mark.parametrize("period", [24, 7])
def test_continuous_detections_equal_the_batch_job(spark, period):
    """IQR branch and seasonal detector under a fixed model; a sensor without a model gives none."""
    from meterwise.operators.models import DetectionModels
    from meterwise.streaming import start_continuous_detection
    cfg = TWO.with_(period=period)
    rnd, run = np.random.default_rng(period), tempfile.mkdtemp(prefix="mw-det-")
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), None if rnd.random() < 0.1 else float(10 + np.sin(2 * np.pi * i / period) + rnd.exponential(0.5)), i, s)
            for s in "ab" for i in range(300)]
    frame = series_frame(spark.createDataFrame(rows, STREAM_SCHEMA), cfg)
    DetectionModels(spark, f"{run}/models").publish(frame, cfg)
    rows += [(datetime(2024, 1, 1) + timedelta(hours=i), float(i), i, "new") for i in range(60)]
    order = sorted(rows, key=lambda r: r[0] + timedelta(hours=float(rnd.uniform(0, 6))))
    for i, part in enumerate(np.array_split(np.arange(len(order)), 4)):
        spark.createDataFrame([order[j] for j in part], STREAM_SCHEMA).coalesce(1).write.parquet(f"{run}/in/part{i}")
        if i == 3:
            heartbeat(spark, CLOSE).coalesce(1).write.parquet(f"{run}/in/part9")
        if i in (1, 3):  # the second run is a restart
            start_continuous_detection(_stream(spark, f"{run}/in"), f"{run}/out", f"{run}/ck", f"{run}/models", cfg, watermark="6 hours", available_now=True).awaitTermination()
    got, want = _pairs(read_committed(spark, f"{run}/out", "detections")), _batch_pairs(frame, cfg)
    assert {k for k in want if k[2] == "seasonal"} and {k for k in want if k[2] == "statistical"}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert read_committed(spark, f"{run}/out", "features").filter("not late").count() == frame.count() + 60


def test_models_are_versioned(spark):
    from meterwise.operators.models import DetectionModels, detections
    models = DetectionModels(spark, tempfile.mkdtemp(prefix="mw-mod-") + "/m")
    assert models.latest()[0] is None and models.latest()[1].count() == 0
    from helpers import series
    frames = [series_frame(series(spark, [float(k + i % 11) for i in range(100)], "s"), TWO) for k in (1, 5)]
    assert [models.publish(f, TWO) for f in frames] == [0, 1]
    version, newest = models.latest()
    assert version == 1 and [r.version for r in newest.collect()] == [1]
    assert models.read(0).first().mean != newest.first().mean


# ------------------------------------------------------------------ windows with a watermark
def test_windowed_stats_of_a_stream_equal_the_batch(spark):
    """Shuffled within the watermark, every window is given out once and whole; rows behind it are left out."""
    from meterwise.operators.windowed import windowed_stats
    from meterwise.streaming.continuous import HEARTBEAT
    rnd, run = np.random.default_rng(9), tempfile.mkdtemp(prefix="mw-win-")
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=7 * i), None if rnd.random() < 0.1 else float(rnd.normal()), i, "ab"[i % 2]) for i in range(600)]
    order = sorted(rows, key=lambda r: r[0] + timedelta(hours=float(rnd.uniform(0, 3))))
    for i, part in enumerate(np.array_split(np.arange(len(order)), 5)):
        spark.createDataFrame([order[j] for j in part], STREAM_SCHEMA).coalesce(1).write.parquet(f"{run}/in/part{i}")
    heartbeat(spark, CLOSE).coalesce(1).write.parquet(f"{run}/in/part9")
    out = windowed_stats(_stream(spark, f"{run}/in"), "1 hour", watermark="3 hours")
    q = (out.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/ck").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    key = lambda df: sorted((r.sensor_id, str(r.window_start), r.n, None if r.mean is None else round(r.mean, 9), r.max) for r in df.collect())
    got = spark.read.parquet(f"{run}/out").filter(F.col("sensor_id") != HEARTBEAT)
    assert key(got) == key(windowed_stats(spark.createDataFrame(rows, STREAM_SCHEMA), "1 hour"))


def test_a_part_is_many_files_and_one_micro_batch(spark, tmp_path):
    from meterwise.plans.extra import _in_turn
    parts = [spark.range(100 * k, 100 * k + n, numPartitions=3) for k, n in ((0, 50), (1, 90), (2, 12))]
    files = _in_turn(parts, str(tmp_path / "in"), file_rows=20)
    assert files == 5
    seen = []
    q = (spark.readStream.schema("id long").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in")).writeStream
         .foreachBatch(lambda b, i: seen.append(sorted(r["id"] for r in b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert seen == [sorted(r["id"] for r in p.collect()) for p in parts]


def test_waiting_rows_are_packed():
    from meterwise.streaming.continuous import _NO_ROW, HELD, HELD_ROWS, WAITING, _before, _held, _order
    import numpy as np
    import pandas as pd
    assert [f.dataType.simpleString() for f in WAITING.fields] == ["binary"] and HELD_ROWS > 1000
    big = (1 << 60) + 1
    rows = _held(pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-02", "2024-01-01", "2024-01-01", "2024-01-01"]), "row_id": pd.array([big, 2, None, 2], dtype="Int64"),
                               "value": [1.0, 5.0, 7.0, None]}))
    assert rows["row"].tolist() == [big, 2, _NO_ROW, 2] and np.frombuffer(rows.tobytes(), HELD)["row"].tolist() == rows["row"].tolist()
    assert _order(rows).tolist() == [2, 3, 1, 0]
    assert _before(rows, tuple(rows[1].item())).tolist() == [False, False, True, True]
