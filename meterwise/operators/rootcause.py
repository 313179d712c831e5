"""Explanations of an alert.

The summary joins, with '; ', the explanations of the three features with
the largest |importance|, the domain-rule insights and the temporal context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import (HIGH_DEMAND_MONTHS, MAINTENANCE_HOURS, OFF_PEAK_HOURS, PEAK_HOURS,
                      TEMPORAL_CHANGE_PCT, TEMPORAL_LOOKBACKS, DetectionConfig)
from ..functions.numeric import fmt_num
from ..functions.text import domain_rules, explain_feature
from .layout import attach_per_sensor

DOMAIN_SETS = {  # R4
    "peak_hours": PEAK_HOURS,
    "off_peak_hours": OFF_PEAK_HOURS,
    "high_demand_months": HIGH_DEMAND_MONTHS,
    "maintenance_hours": MAINTENANCE_HOURS,
}


def change_pct(value: Column, past: Column) -> Column:
    """Percent change, NULL when the past value is missing or zero."""
    return F.when(past.isNotNull() & (past != 0), (value - past) / past * F.lit(100.0))


def temporal_context(value: Column, pasts: dict[int, Column]) -> Column:
    """Texts for |change| > 20 % against the values k rows back."""
    parts = []
    for k, label in TEMPORAL_LOOKBACKS:
        ch = change_pct(value, pasts[k])
        parts.append(F.when(F.abs(ch) > TEMPORAL_CHANGE_PCT, F.format_string(
            "Value changed by %s%% compared to %s", fmt_num(ch, 1), F.lit(label))))
    return F.concat_ws("; ", *parts)


def with_series_end_pasts(frame: DataFrame) -> DataFrame:
    """Anchor at the series end: values n-k rows from the start (the k-th
    last row), one small aggregate per sensor."""
    aggs = [F.max(F.when(F.col("pos") == F.col("n") - k, F.col("value"))).alias(f"end_past_{k}")
            for k, _ in TEMPORAL_LOOKBACKS]
    ends = frame.groupBy("sensor_id").agg(*aggs)
    return attach_per_sensor(frame, ends)


def past_columns(cfg: DetectionConfig) -> dict[int, Column]:
    if cfg.temporal_anchor == "series_end":
        return {k: F.col(f"end_past_{k}") for k, _ in TEMPORAL_LOOKBACKS}
    return {k: F.col(f"lag_{k}") for k, _ in TEMPORAL_LOOKBACKS}


def top_explanations(ranked: Column, k: int = 3) -> Column:
    return F.transform(F.slice(ranked, 1, k),
                       lambda e: explain_feature(e["feature"], e["importance"]))


def root_cause_summary(ranked: Column, ts: Column, temporal: Column) -> Column:
    """R5."""
    parts = F.concat(
        top_explanations(ranked),
        domain_rules(ts),
        F.filter(F.array(temporal), lambda x: x != ""),
    )
    return F.array_join(parts, "; ")
