import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import series
from meterwise.config import DetectionConfig
from meterwise.operators.layout import clean_series, min_points_guard
from meterwise.sources import hourly_by_type, quarantine, normalize_readings


def _pd_linear(h):
    out = []
    for sid, g in h.sort_values(["sensor_id", "timestamp"]).groupby("sensor_id"):
        g = g.copy()
        g["value"] = g["value"].interpolate("linear")
        g = g.dropna(subset=["value"])
        g["pos"] = np.arange(len(g))
        out.append(g)
    return pd.concat(out)


def test_linear_matches_pandas_across_chunks(spark):
    h = hourly_by_type(spark, "/root/testdata/sf0.001")
    ref = _pd_linear(h.toPandas())
    for chunk in (1_000_000, 37):
        c = clean_series(h, DetectionConfig(chunk_rows=chunk)).toPandas()
        m = c.merge(ref, on=["sensor_id", "timestamp"], suffixes=("", "_o"))
        assert len(c) == len(ref) == len(m)
        assert np.abs(m.value - m.value_o).max() < 1e-9
        assert (m.pos == m.pos_o).all()
        assert c.imputed.sum() == 2700


def test_gap_head_mid_tail(spark):
    df = series(spark, [None, None, 1.0, None, None, 4.0, None, None])
    c = clean_series(df, DetectionConfig(chunk_rows=3)).orderBy("pos").toPandas()
    assert list(c.value) == [1.0, 2.0, 3.0, 4.0, 4.0, 4.0]  # leading dropped, middle linear, trailing repeated
    assert list(c.pos) == list(range(6))
    assert (c.n == 6).all()


def test_methods(spark):
    vals = [1.0, None, None, None, 5.0, None]
    df = series(spark, vals)
    get = lambda m: clean_series(df, DetectionConfig(interpolation=m)).orderBy("pos").toPandas().value.tolist()
    assert get("ffill") == [1.0, 1.0, 1.0, 1.0, 5.0, 5.0]
    assert get("nearest") == [1.0, 1.0, 1.0, 5.0, 5.0]  # tie (middle) goes to the earlier point; no trailing
    assert get("linear") == [1.0, 2.0, 3.0, 4.0, 5.0, 5.0]


def test_time_interpolation_uses_timestamps(spark):
    from datetime import datetime
    pdf = pd.DataFrame({"sensor_id": ["s"] * 3, "timestamp": [datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1),
                                                              datetime(2024, 1, 1, 4)],
                        "value": [0.0, None, 4.0], "row_id": [0, 1, 2]})
    df = spark.createDataFrame(pdf, "sensor_id string, timestamp timestamp_ntz, value double, row_id bigint")
    v = clean_series(df, DetectionConfig(interpolation="time")).orderBy("pos").toPandas().value.tolist()
    assert v == [0.0, 1.0, 4.0]


def test_nan_folded_and_extra_null_dropped(spark):
    df = series(spark, [1.0, float("nan"), 3.0, 4.0], extra=["a", "b", None, "d"])
    df = normalize_readings(df)
    c = clean_series(df, DetectionConfig()).orderBy("pos").toPandas()
    assert c.value.tolist() == [1.0, 2.0, 4.0]  # NaN interpolated, row with NULL tag dropped
    assert c.pos.tolist() == [0, 1, 2]


def test_bad_timestamp_quarantined(spark):
    raw = spark.createDataFrame([("s", "2024-01-01 00:00:00", 1.0), ("s", "garbage", 2.0),
                                 ("s", "2024-01-01T01:00:00Z", 3.0)],
                                "sensor_id string, timestamp string, value double")
    good = normalize_readings(raw)
    bad = quarantine(raw)
    assert good.count() == 2
    q = bad.collect()
    assert len(q) == 1 and q[0].raw_timestamp == "garbage"
    assert dict(good.dtypes)["timestamp"] == "timestamp_ntz"


def test_duplicate_timestamps_ordered_by_row_id(spark):
    from datetime import datetime
    pdf = pd.DataFrame({"sensor_id": ["s"] * 3, "timestamp": [datetime(2024, 1, 1)] * 3,
                        "value": [3.0, 1.0, 2.0], "row_id": [2, 0, 1]})
    df = spark.createDataFrame(pdf, "sensor_id string, timestamp timestamp_ntz, value double, row_id bigint")
    c = clean_series(df, DetectionConfig()).orderBy("pos").toPandas()
    assert c.row_id.tolist() == [0, 1, 2]


def test_min_points_guard(spark):
    df = series(spark, [1.0] * 9, sensor="n9").unionByName(series(spark, [1.0] * 10, sensor="n10"))
    cfg = DetectionConfig(min_points=10)
    g = min_points_guard(clean_series(df, cfg), cfg)
    assert sorted(r.sensor_id for r in g.select("sensor_id").distinct().collect()) == ["n10"]
