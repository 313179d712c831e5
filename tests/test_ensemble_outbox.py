from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from meterwise.config import DetectionConfig, Routes
from meterwise.functions.text import domain_rules, severity
from meterwise.operators.ensemble import ensemble_columns, ensemble_detect
from meterwise.operators.outbox import route_alerts, sms_outbox


def _conf(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["conf_statistical", "conf_isolation_forest", "conf_seasonal"]),
                                 "conf_statistical double, conf_isolation_forest double, conf_seasonal double")


def test_ties_and_weights(spark):
    df = _conf(spark, [(0.8, 0.8, 0.8), (None, 0.6, 0.6), (0.5, None, None), (0.2, 1.0, None)])
    r = ensemble_columns(df, DetectionConfig()).collect()
    assert [x.strongest_detector for x in r] == ["statistical", "isolation_forest", "statistical", "isolation_forest"]
    assert abs(r[3].ensemble_confidence - (0.3 * 0.2 + 0.4 * 1.0) / 0.7) < 1e-12
    # strict: exactly 0.5 is not an anomaly
    assert ensemble_detect(df, DetectionConfig()).count() == 3


def test_severity_strict_bounds(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.9,), (0.91,)], "c double")
    assert [r[0] for r in df.select(severity(F.col("c"))).collect()] == ["low", "medium", "high", "critical"]


def test_domain_rules(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 6, 18),), (datetime(2024, 1, 2, 3),), (datetime(2024, 4, 2, 3),)],
                               "t timestamp_ntz")
    r = [x[0] for x in df.select(domain_rules(F.col("t"))).collect()]
    assert len(r[0]) == 3 and r[0][0].startswith("Anomaly occurred during peak") and r[0][2].startswith("Summer")
    assert r[1] == ["Winter period anomaly - possible heating system issue"]
    assert r[2] == []


def test_sms_gate_and_routing(spark):
    alerts = spark.createDataFrame(
        [("m1", datetime(2024, 1, 1, 5, 7), "statistical_outlier", "high", 12.345),
         ("m1", datetime(2024, 1, 1, 6), "seasonal_shift", "medium", 1.0)],
        "sensor_id string, timestamp timestamp_ntz, anomaly_type string, severity string, value double")
    s = sms_outbox(alerts, Routes(sms=("+1",))).collect()
    assert len(s) == 1 and s[0].body == "ALERT: m1 - statistical_outlier (high) at 05:07. Value: 12.3"
    assert route_alerts(alerts, Routes(email=(), sms=())).count() == 0
