"""Combine detector confidences.

Wide form: each detector contributes a nullable ``conf_<detector>`` column on
the row (the full outer merge of the detection lists is then free).  The long
form for plug-in detectors is in ``detectors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DETECTOR_ORDER, SEASONAL_IMPORTANCE, DetectionConfig
from ..functions.text import detector_type


def active_detectors(df: DataFrame, cfg: DetectionConfig) -> list[str]:
    return [d for d in DETECTOR_ORDER if d in cfg.detectors and f"conf_{d}" in df.columns]


def strongest_detector(dets: list[str]):
    """Greatest confidence; ties go to the earlier detector in
    statistical -> isolation_forest -> seasonal order."""
    confs = [F.col(f"conf_{d}") for d in dets]
    m = F.greatest(*confs) if len(confs) > 1 else confs[0]
    expr = None
    for d, c in zip(dets, confs):
        expr = F.when(c == m, d) if expr is None else expr.when(c == m, d)
    return expr


def weighted_confidence(dets: list[str], cfg: DetectionConfig):
    """sum(w * c) / sum(w) over the detectors that fired on the row."""
    num, den = F.lit(0.0), F.lit(0.0)
    for d in dets:
        c, w = F.col(f"conf_{d}"), F.lit(float(cfg.weights[d]))
        num = num + F.when(c.isNotNull(), w * c).otherwise(F.lit(0.0))
        den = den + F.when(c.isNotNull(), w).otherwise(F.lit(0.0))
    return F.try_divide(num, den)


def ensemble_columns(df: DataFrame, cfg: DetectionConfig) -> DataFrame:
    dets = active_detectors(df, cfg)
    out = df.withColumns({
        "ensemble_confidence": weighted_confidence(dets, cfg),
        "strongest_detector": strongest_detector(dets),
    })
    return out.withColumn("anomaly_type", F.when(F.col("strongest_detector").isNotNull(),
                                                 detector_type(F.col("strongest_detector"))))


def ensemble_detect(df: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Rows whose weighted confidence is strictly above the minimum."""
    return ensemble_columns(df, cfg).filter(
        F.col("ensemble_confidence") > F.lit(cfg.min_ensemble_confidence))


def seasonal_importance_rows(sensors: DataFrame, ordinal_base: int) -> DataFrame:
    """D7 as rows for each sensor (an explode of a literal, not a join)."""
    entries = F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(float(v)).alias("importance"),
                                 F.lit(ordinal_base + i).alias("ordinal"))
                        for i, (k, v) in enumerate(SEASONAL_IMPORTANCE.items())])
    return sensors.select("sensor_id", F.inline(entries))


def combined_importance(parts: list[DataFrame]) -> DataFrame:
    """Average importance per (sensor, feature) over the detectors
    that produced one; ``ordinal`` keeps the first-seen feature order.  At
    least one part is needed (see ``sensor_attribution`` for none)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.groupBy("sensor_id", "feature")
             .agg(F.avg("importance").alias("importance"), F.min("ordinal").alias("ordinal")))


def attribution_map(imp: DataFrame) -> DataFrame:
    """Per sensor: ``feature_attribution`` map and ``attribution_ranked``
    (entries by |importance| desc, first-seen order on ties)."""
    g = imp.groupBy("sensor_id").agg(
        F.collect_list(F.struct(
            (-F.abs(F.col("importance"))).alias("k"), F.col("ordinal").alias("o"),
            F.col("feature").alias("feature"), F.col("importance").alias("importance"))).alias("_e"))
    ranked = F.transform(F.array_sort(F.col("_e")),
                         lambda e: F.struct(e["feature"].alias("feature"), e["importance"].alias("importance")))
    return g.select(
        "sensor_id",
        F.map_from_entries(ranked).alias("feature_attribution"),
        ranked.alias("attribution_ranked"))
