from datetime import datetime, timedelta

import numpy as np
import pandas as pd


def series(spark, values, sensor="s", start=datetime(2024, 1, 1), step=timedelta(hours=1), row_ids=None,
           extra=None):
    rows = []
    for i, v in enumerate(values):
        r = {"sensor_id": sensor, "timestamp": start + i * step, "value": v,
             "row_id": (row_ids[i] if row_ids is not None else i)}
        if extra is not None:
            r["tag"] = extra[i]
        rows.append(r)
    schema = "sensor_id string, timestamp timestamp_ntz, value double, row_id bigint"
    if extra is not None:
        schema += ", tag string"
    return spark.createDataFrame(pd.DataFrame(rows), schema)


def sine_with_spike(days=14, spike_at=200, height=8.0, seed=0):
    rng = np.random.default_rng(seed)
    n = days * 24
    x = 10 + np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 0.05, n)
    x[spike_at] += height * x.std()
    return x
