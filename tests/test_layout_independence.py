"""Results that must not depend on the physical layout, and exact rendering."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import series
from meterwise.config import DetectionConfig, Routes, config_from_dict
from meterwise.functions.numeric import fmt_num
from meterwise.operators.features import series_frame
from meterwise.operators.outbox import route_alerts
from meterwise.plans import detect_alerts
from meterwise.sources import normalize_readings, parse_json_payload, quarantine, quarantine_json_payload, read_readings


def test_trend_of_a_long_period(spark):
    x = [random.Random(i).random() for i in range(2000)]
    got = []
    for block in (1_000_000, 800):
        cfg = DetectionConfig(period=400, block_rows=block)
        got.append([r.trend for r in series_frame(series(spark, x), cfg).orderBy("pos").collect()])
    assert [t is None for t in got[0]] == [t is None for t in got[1]] and sum(t is None for t in got[0]) == 400
    assert all(a is None or abs(a - b) < 1e-9 for a, b in zip(*got))


@pytest.mark.parametrize("decimals", [1, 2, 3])
def test_numbers_render_like_printf(spark, decimals):
    rnd = random.Random(decimals)
    xs = [2.675, 12.25, 0.15, 0.125, -2.675, -0.001, -0.0, 0.0, 0.05, 0.5, 1.005, 999.995, 0.9996, 1e15 + 0.3, 4503599627370497.5, 1e18, 123456789.125, 1e-300]
    xs += [rnd.uniform(-1000, 1000) for _ in range(500)] + [round(rnd.uniform(-100, 100), decimals + 1) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(fmt_num("x", decimals)).collect()]
    assert got == [f"%.{decimals}f" % x for x in xs]


def test_one_detector_without_importance(spark):
    x = [random.Random(i).gauss(10, 1) for i in range(200)] + [500.0]
    cfg = DetectionConfig(detectors=("isolation_forest",), n_estimators=20)
    rows = detect_alerts(series(spark, x), cfg).collect()
    assert rows and all(r.feature_attribution == {} for r in rows)


def test_sensor_ids(spark):
    x = [random.Random(i).gauss(10, 1) for i in range(100)] + [500.0]
    both = series(spark, x, "a").unionByName(series(spark, x, "b"))
    cfg = DetectionConfig(detectors=("statistical",), min_ensemble_confidence=0.1)
    assert {r.sensor_id for r in detect_alerts(both, cfg, sensor_ids=["b"]).collect()} == {"b"}


def test_kept_and_quarantined_add_up(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "soon", 1.0), ("a", None, 1.0), (None, "2024-01-01 00:00:00", 1.0)],
                               "sensor_id string, timestamp string, value double")
    assert normalize_readings(df).count() == 1
    assert sorted(r.reason for r in quarantine(df).collect()) == ["missing sensor", "missing timestamp", "unparsable timestamp"]
    js = spark.createDataFrame([('{"sensor_id":"m","timestamp":"2024-01-01T00:00:00","value":1.5}',), ("{broken",), ('{"sensor_id":"m"}',), (None,)], "value string")
    assert parse_json_payload(js).count() == 1 and quarantine_json_payload(js).count() == 3


def test_file_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.5), ("b", "2024-01-01 01:00:00", None)], "sensor_id string, timestamp string, value double")
    df.write.csv(f"{tmp_path}/c", header=True)
    df.write.json(f"{tmp_path}/j")
    df.createOrReplaceTempView("readings_for_test")
    want = sorted(map(str, normalize_readings(df).collect()))
    schema = "sensor_id string, timestamp string, value double"
    for path, fmt, opts in ((f"{tmp_path}/c", "csv", {"schema": schema}), (f"{tmp_path}/j", "json", {"schema": schema}), ("readings_for_test", "table", {})):
        assert sorted(map(str, read_readings(spark, path, fmt, **opts).collect())) == want


def test_config_from_dict_and_channels(spark):
    cfg = config_from_dict({"detection_thresholds": {"statistical_threshold": 2, "seasonal_period": 12}, "email": {"host": "x"},
                            "alert_recipients": {"email": ["a@example.org"], "sms": ["1"]}})
    assert cfg.z_threshold == 2 and cfg.period == 12 and cfg.routes.email == ("a@example.org",) and cfg.routes.sms == ()
    x = [random.Random(i).gauss(10, 1) for i in range(100)] + [500.0]
    alerts = detect_alerts(series(spark, x), DetectionConfig(detectors=("statistical",), processing_time="2024-02-01 00:00:00"))

    def pager(a, routes):
        text = [F.lit(c).alias(c) for c in ("channel", "from", "to", "subject", "body")]
        return a.select("sensor_id", "timestamp", *text)

    out = route_alerts(alerts, Routes(email=("a@example.org",), email_sender="s@example.org"), {"pager": pager}).collect()
    assert {(r.channel, r["from"]) for r in out} == {("email", "s@example.org"), ("channel", "from")}
    assert all("Top Contributing Features:\n- " in r.body for r in out if r.channel == "email")
