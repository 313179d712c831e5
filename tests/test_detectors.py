import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import series, sine_with_spike
from meterwise.config import DetectionConfig
from meterwise.operators.features import series_frame
from meterwise.operators.scaler import apply_scaler, fit_scaler
from meterwise.operators.seasonal import seasonal_detect
from meterwise.operators.statistical import statistical_detect
from meterwise.plans import detect_alerts, detection_frame
from meterwise.sources import hourly_by_type

TWO = DetectionConfig(detectors=("statistical", "seasonal"))


def test_regression_counts_sf0001(spark):
    a = detect_alerts(hourly_by_type(spark, "/root/testdata/sf0.001"), TWO).toPandas()
    assert len(a) == 189
    assert a.anomaly_type.value_counts().to_dict() == {"seasonal_shift": 129, "statistical_outlier": 60}
    assert a.severity.value_counts().to_dict() == {"critical": 172, "high": 17}
    assert (a.expected_range_scaled.map(lambda r: abs(r["lower"] + 2) < 1e-9)).all()


def test_statistical_against_numpy(spark):
    vals = list(np.random.default_rng(3).normal(50, 10, 300))
    vals[17] = 200.0
    df = series(spark, vals)
    d = statistical_detect(series_frame(df, TWO), TWO).toPandas().sort_values("pos")
    v = np.array(vals)
    z = np.abs((v - v.mean()) / v.std())
    q1, q3 = np.percentile(v, [25, 75])
    flag = (z > 3) | (v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))
    assert (d.conf_statistical.notna().to_numpy() == flag).all()
    got = d.conf_statistical.to_numpy()[flag]
    assert np.allclose(got, np.minimum(z[flag] / 3, 1.0))


def test_constant_series(spark):
    df = series(spark, [5.0] * 60)
    j = detection_frame(df, TWO).toPandas()
    assert j.conf_statistical.isna().all() and j.conf_seasonal.isna().all()
    assert (j.value_scaled == 0).all()  # scale 1 where the deviation is 0
    m = fit_scaler(series_frame(df, TWO), TWO).toPandas()
    assert (m[m.feature == "value"].scale == 1.0).all()


def test_seasonal_guard_47_48(spark):
    x = sine_with_spike(days=2, spike_at=30)
    d47 = seasonal_detect(series_frame(series(spark, list(x[:47])), TWO), TWO)
    d48 = seasonal_detect(series_frame(series(spark, list(x[:48])), TWO), TWO)
    assert d47.filter("conf_seasonal is not null").count() == 0
    assert d48.filter("conf_seasonal is not null").count() > 0


def test_spike_all_detectors_and_legacy_shift(spark):
    x = sine_with_spike(days=14, spike_at=200)
    df = series(spark, list(x))
    j = detection_frame(df, DetectionConfig()).toPandas().set_index("pos")
    assert j.loc[200, "conf_statistical"] > 0
    assert j.loc[200, "conf_seasonal"] == 1.0
    assert j.loc[200, "conf_isolation_forest"] > 0
    legacy = DetectionConfig(detectors=("statistical", "seasonal"), legacy_shift=True)
    jl = detection_frame(df, legacy).toPandas().set_index("pos")
    assert jl.loc[188, "conf_seasonal"] == 1.0  # half a period early, as the original placement


def test_scaler_fit_once_reuse(spark):
    df = series(spark, [float(i) for i in range(30)])
    f = series_frame(df, TWO)
    model = fit_scaler(f, TWO)
    later = series_frame(series(spark, [float(i) for i in range(30, 60)]), TWO)
    s = apply_scaler(later, model).toPandas().sort_values("pos")
    mu, sd = np.mean(range(30)), np.std(range(30))
    assert np.allclose(s.value_scaled, (np.arange(30, 60) - mu) / sd)
