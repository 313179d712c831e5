"""The block + halo layout must give exactly the single-block results."""
import numpy as np

from meterwise.config import ENGINEERED_FEATURES, DetectionConfig
from meterwise.operators.features import series_frame
from meterwise.operators.seasonal import seasonal_detect
from meterwise.sources import hourly_by_type, raw_by_type

COLS = list(ENGINEERED_FEATURES) + ["trend", "lag_24", "lag_168", "value", "pos"]


def _frame(spark, readings, **kw):
    return series_frame(readings, DetectionConfig(**kw)).toPandas().sort_values(["sensor_id", "pos"]).reset_index(drop=True)


def test_small_blocks_equal_one_block(spark):
    h = hourly_by_type(spark, "/root/testdata/sf0.001")
    a = _frame(spark, h)
    b = _frame(spark, h, block_rows=200, chunk_rows=150)
    assert len(a) == len(b)
    for c in COLS:
        x, y = a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(x), np.isnan(y)), c
        assert np.nanmax(np.abs(x - y)) < 1e-9 if np.isfinite(x).any() else True, c


def test_irregular_series_small_blocks(spark):
    r = raw_by_type(spark, "/root/testdata/sf0.001")
    a = _frame(spark, r)
    b = _frame(spark, r, block_rows=181, chunk_rows=50)
    assert (a.row_id.to_numpy() == b.row_id.to_numpy()).all()
    for c in ("rolling_mean_168", "rolling_std_12", "rate_of_change", "trend"):
        x, y = a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(x), np.isnan(y)), c
        assert np.nanmax(np.abs(x - y)) < 1e-9, c


def test_seasonal_flags_independent_of_blocks(spark):
    h = hourly_by_type(spark, "/root/testdata/sf0.001")
    f = lambda **kw: sorted(
        (r.sensor_id, str(r.timestamp)) for r in seasonal_detect(
            series_frame(h, DetectionConfig(**kw)), DetectionConfig(**kw)).filter("conf_seasonal is not null").collect())
    assert f() == f(block_rows=240, chunk_rows=100)
