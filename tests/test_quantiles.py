"""Selected quantiles against ``percentile``, and chunks of even size."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import series
from meterwise.config import DetectionConfig
from meterwise.functions.time import epoch_micros
from meterwise.operators.detectors import PandasDetector
from meterwise.operators.features import series_frame
from meterwise.operators.layout import with_chunks, with_halo
from meterwise.operators.quantiles import exact_quantiles
from meterwise.operators.statistical import statistical_detect
from meterwise.plans import detect_alerts

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("grid,limit", [(16, 8), (64, 300), (1024, 1 << 15)])
def test_selection_equals_percentile(spark, grid, limit):
    r = np.random.default_rng(0)
    held = {"distinct": r.normal(size=20_000), "decades": 10.0 ** r.uniform(-300, 300, 5000), "half": np.concatenate([np.full(3000, 7.0), r.normal(size=3000)]),
            "constant": np.full(500, 3.0), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "few": r.integers(0, 5, 7000).astype(float),
            "ends": np.concatenate([np.zeros(5000), [1e-300, 1e300]]), "gaps": np.where(r.random(900) < 0.3, np.nan, r.normal(size=900))}
    pdf = pd.concat([pd.DataFrame({"sensor_id": k, "value": v}) for k, v in held.items()])
    df = spark.createDataFrame(pdf, "sensor_id string, value double").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
    df = df.unionByName(spark.createDataFrame([("none", None)], "sensor_id string, value double")).repartition(5).cache()
    want = {x.sensor_id: x.q for x in df.groupBy("sensor_id").agg(F.percentile("value", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect()}
    got = {x.sensor_id: x.quantiles for x in exact_quantiles(df, PROBS, grid=grid, limit=limit).collect()}
    assert got == {k: v for k, v in want.items() if k != "none"}


def test_long_series_are_selected_in_the_batch_job(spark):
    x = list(np.random.default_rng(1).normal(10, 1, 400)) + [99.0]
    both = series(spark, x, "a").unionByName(series(spark, x[::-1], "b"))
    cfg = DetectionConfig(detectors=("statistical", "seasonal"), processing_time="2024-02-01 00:00:00")
    rows = lambda c: sorted(map(str, detect_alerts(both, c).collect()))
    assert rows(cfg) == rows(cfg.with_(quantile_map_rows=100)) and rows(cfg)


def test_selected_quartiles_give_the_same_detections(spark):
    x = list(np.random.default_rng(2).normal(10, 1, 500)) + [50.0]
    hits = lambda c: sorted(r.row_id for r in statistical_detect(series_frame(series(spark, x), c), c).filter("conf_statistical is not null").collect())
    assert hits(DetectionConfig()) == hits(DetectionConfig(quantiles="selection"))


def test_chunks_are_even(spark):
    """A burst, many rows of one time, a stray date, an ordinary series: no chunk has more than twice its rows."""
    start, rnd = datetime(2024, 1, 1), np.random.default_rng(3)
    burst = [("burst", start + timedelta(days=i), 1.0, i) for i in range(300)] + [("burst", start + timedelta(days=200, milliseconds=i), 2.0, 1000 + i) for i in range(6000)]
    same = [("same", start, float(rnd.normal()), i) for i in range(4000)] + [("same", start + timedelta(hours=i), 1.0, 9000 + i) for i in range(100)]
    stray = [("stray", start + timedelta(seconds=int(s)), 1.0, i) for i, s in enumerate(rnd.permutation(3000))] + [("stray", datetime(1971, 1, 1), 1.0, 5000)]
    few = [("few", start + timedelta(hours=i), 1.0, i) for i in range(20)]
    df = spark.createDataFrame([(s, t, v, r) for s, t, v, r in burst + same + stray + few], "sensor_id string, timestamp timestamp_ntz, value double, row_id long")
    got = with_chunks(df.withColumn("t_us", epoch_micros("timestamp")), DetectionConfig(chunk_rows=500)).toPandas()
    assert len(got) == df.count()
    sizes = got.groupby(["sensor_id", "chunk"]).size()
    assert sizes.max() <= 1000 and sizes.groupby("sensor_id").size().to_dict()["few"] == 1
    for _, g in got.groupby("sensor_id"):  # chunks follow the order of the rows
        g = g.sort_values(["t_us", "row_id", "value"])
        assert g.chunk.is_monotonic_increasing


def test_uneven_times_give_the_same_frame(spark):
    rnd, start = np.random.default_rng(4), datetime(2024, 1, 1)
    times = [start + timedelta(days=i) for i in range(40)] + [start + timedelta(days=20, seconds=int(i // 3)) for i in range(400)] + [datetime(1999, 1, 1)]
    rows = [("s", t, None if rnd.random() < 0.2 else float(rnd.normal()), i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "sensor_id string, timestamp timestamp_ntz, value double, row_id long")
    a, b = (series_frame(df, DetectionConfig(chunk_rows=c, block_rows=200)).toPandas().sort_values("pos").reset_index(drop=True) for c in (1_000_000, 40))
    assert a.row_id.tolist() == b.row_id.tolist()
    for c in ("value", "rolling_mean_168", "rate_of_change", "trend"):
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


@pytest.mark.parametrize("block,back,ahead", [(7, 0, 0), (7, 3, 2), (5, 12, 9), (1000, 4, 4)])
def test_halos_reach_over_several_blocks(spark, block, back, ahead):
    df = spark.createDataFrame([("s", i, 50) for i in range(50)], "sensor_id string, pos long, n long")
    got = {}
    for r in with_halo(df, block, back, ahead).collect():
        got.setdefault(r.blk, []).append((r.pos, r.role == 0))
    for blk, rows in got.items():
        lo, hi = blk * block, min(50, (blk + 1) * block)
        assert sorted(rows) == [(p, lo <= p < hi) for p in range(max(0, lo - back), min(50, hi + ahead))]
    assert sorted(got) == list(range(-(-50 // block)))


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_pandas_detector_equals_the_whole_series(spark, block):
    x = np.random.default_rng(5).normal(10, 2, 300)
    cfg = DetectionConfig(chunk_rows=70)
    frame = series_frame(series(spark, list(x)), cfg)

    def centred(rows):
        gap = (rows["value"] - rows["value"].rolling(41, center=True, min_periods=1).median()).abs()
        return (gap / 10).where(gap > 3)

    d = PandasDetector("centred", centred, back=20, ahead=20).detect(frame, cfg.with_(block_rows=block))
    want = centred(pd.DataFrame({"value": x})).dropna()
    got = {r.row_id: r.confidence for r in d.collect()}
    assert got.keys() == set(want.index) and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_pandas_detector_must_answer_for_every_row(spark):
    frame = series_frame(series(spark, [1.0, 2.0, 3.0]), DetectionConfig())
    with pytest.raises(Exception, match="1 confidences for 3 rows"):
        PandasDetector("short", lambda rows: rows["value"].head(1)).detect(frame, DetectionConfig()).collect()
