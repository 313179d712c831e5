"""Exact quantiles per sensor in bounded memory.

``percentile`` keeps a value -> count map per sensor, which for measured values
grows with the series.  Here a quantile is *selected*: its two neighbouring order
statistics are looked for between two values (lo, hi), at first between none.
One pass counts the values below, at and between them and takes a grid of
approximate quantiles of those between (a mergeable sketch of fixed size); the
two grid values around the wanted rank are the next (lo, hi).  Each pass narrows
the open interval by a factor of about ``GRID`` / 4, whatever the distribution
(ties: the ends are counted by themselves).  When at most ``LIMIT`` values lie
between, they are collected, sorted and read.  The counts are exact, so an
error of the sketch costs a pass, never the result.

All passes are partial aggregates over the column.  A sensor's state is a few
numbers, its sketch and at most ``LIMIT`` values, however long the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .layout import attach_per_sensor

GRID = 1024
ACCURACY = 20_000
LIMIT = 1 << 15


def _between(v: Column, t: Column) -> Column:
    return v.isNotNull() & (t["lo"].isNull() | (v > t["lo"])) & (t["hi"].isNull() | (v < t["hi"]))


def _targets(probs: Sequence[float]) -> Column:
    """The ranks floor(p * (n - 1)) and the next for every quantile, nothing known of their values."""
    none = F.lit(None).cast("double")
    at = [F.lit(float(p)) * (F.col("count") - 1) for p in probs]
    ranks = [k for a in at for k in (F.floor(a), F.least(F.floor(a) + 1, F.col("count") - 1))]
    return F.array(*[F.struct(k.cast("bigint").alias("k"), none.alias("lo"), none.alias("hi"), none.alias("value"), F.lit(1).alias("margin")) for k in ranks])


def _counted(values: DataFrame, state: DataFrame, n: int, grid: int, limit: int | None) -> DataFrame:
    """State with, for each target, (below, at_lo, open, at_hi) and the grid of the open interval, or its values if ``limit`` is None."""
    j = attach_per_sensor(values, state) if "blk" in values.columns else values.join(state, "sensor_id")
    v, aggs = F.col("value"), []
    for i in range(n):
        t = F.col("targets")[i]
        free = t["value"].isNull() & _between(v, t)
        aggs += [F.count_if(v < t["lo"]).alias(f"below_{i}"), F.count_if(v == t["lo"]).alias(f"at_lo_{i}"),
                 F.count_if(free).alias(f"open_{i}"), F.count_if(v == t["hi"]).alias(f"at_hi_{i}")]
        if limit is None:
            aggs.append(F.array_sort(F.collect_list(F.when(free, v))).alias(f"grid_{i}"))
        else:
            aggs.append(F.percentile_approx(F.when(free, v), [g / grid for g in range(grid + 1)], ACCURACY).alias(f"grid_{i}"))
    return j.groupBy("sensor_id").agg(F.any_value("count").alias("count"), F.any_value("targets").alias("targets"), *aggs)


def _narrowed(counted: DataFrame, n: int, grid: int) -> DataFrame:
    """Each target found at an end, or with new ends from the grid."""
    out, width = [], []
    for i in range(n):
        t, below, at_lo, free, at_hi = (F.col("targets")[i], *(F.col(f"{c}_{i}") for c in ("below", "at_lo", "open", "at_hi")))
        rank = t["k"] - below - at_lo  # among the values between
        found = F.when(t["value"].isNotNull(), t["value"]).when((rank < 0) & (rank >= -at_lo), t["lo"]).when((rank >= free) & (rank < free + at_hi), t["hi"])
        missed = (rank < -at_lo) | (rank >= free + at_hi)  # the grid was off: begin anew, with more room
        step = F.lit(grid) / F.greatest(free, F.lit(1))
        at = F.col(f"grid_{i}")
        lo_at, hi_at = F.floor(rank * step) - t["margin"], F.ceil((rank + 1) * step) + t["margin"]
        lo = F.when(lo_at <= 0, t["lo"]).otherwise(F.get(at, lo_at.cast("int")))
        hi = F.when(hi_at >= grid, t["hi"]).otherwise(F.get(at, hi_at.cast("int")))
        none = F.lit(None).cast("double")
        out.append(F.struct(t["k"].alias("k"), F.when(missed, none).otherwise(lo).alias("lo"), F.when(missed, none).otherwise(hi).alias("hi"),
                            found.alias("value"), F.when(missed, t["margin"] * 8).otherwise(t["margin"]).cast("int").alias("margin")))
        width.append(F.when(found.isNull(), free).otherwise(F.lit(0)))
    return counted.select("sensor_id", "count", F.array(*out).alias("targets"), F.greatest(*width, F.lit(0)).alias("width"))


def exact_quantiles(rows: DataFrame, probs: Sequence[float], col: str = "value", grid: int = GRID, limit: int = LIMIT) -> DataFrame:
    """(sensor_id, quantiles): the linearly interpolated quantiles of the non-missing values, as ``percentile`` gives them;
    sensors without a value have none.  ``rows`` are read once for each pass: materialise them before."""
    keys = [c for c in ("sensor_id", "blk") if c in rows.columns]
    values = rows.select(*keys, F.col(col).cast("double").alias("value")).filter("value is not null")
    state = values.groupBy("sensor_id").agg(F.count("value").alias("count")).withColumn("targets", _targets(probs))
    n, state = 2 * len(probs), cut_lineage(state.withColumn("width", F.col("count")))
    while not state.filter(F.col("width") > limit).isEmpty():
        state = cut_lineage(_narrowed(_counted(values, state.select("sensor_id", "count", "targets"), n, grid, limit), n, grid))
    ends = _counted(values, state.select("sensor_id", "count", "targets"), n, grid, None)
    got = []
    for i in range(n):
        t, rank = F.col("targets")[i], F.col("targets")[i]["k"] - F.col(f"below_{i}") - F.col(f"at_lo_{i}")
        got.append(F.when(t["value"].isNotNull(), t["value"]).when(rank < 0, t["lo"]).when(rank >= F.col(f"open_{i}"), t["hi"])
                   .otherwise(F.get(F.col(f"grid_{i}"), rank.cast("int"))))
    out = []
    for i, p in enumerate(probs):
        lower, upper, at = got[2 * i], got[2 * i + 1], F.lit(float(p)) * (F.col("count") - 1)
        low, high = F.floor(at), F.ceil(at)
        out.append(F.when((low == high) | (lower == upper), lower).otherwise((high - at) * lower + (at - low) * upper))
    return ends.select("sensor_id", F.array(*out).alias("quantiles"))
