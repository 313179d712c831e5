"""The batch detection job, a chain of plans cut by checkpoints.

readings -> clean + guard (time chunks) -> positional pass (position blocks)
-> per-sensor statistics (value stats, scaler, correlations, seasonal phase
means: partial aggregates) -> attach to blocks -> detectors -> second
statistics round (residual spread, forest thresholds) -> ensemble -> alerts.

Shuffles of the reading rows: one into time chunks, one into position
blocks.  Everything else that moves is per-sensor or per-block summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..config import ENGINEERED_FEATURES, SCALED_FEATURES, DetectionConfig
from ..functions.numeric import standardise
from ..operators.ensemble import (attribution_map, combined_importance, ensemble_detect,
                                  seasonal_importance_rows)
from ..operators.features import series_frame
from ..operators.layout import attach_per_sensor
from ..operators.alerts import assemble_alerts
from ..operators.outbox import route_alerts
from ..operators.rootcause import with_series_end_pasts
from ..operators.scaler import model_wide
from ..operators.seasonal import seasonal_profile
from ..operators.stats import safe_corr, with_quartiles
from ..operators.statistical import statistical_columns
from ..session import cut_lineage


def _sensor_stats(frame: DataFrame, cfg: DetectionConfig, fit_scaler: bool) -> DataFrame:
    """One grouped pass: value statistics, scaler fit, |corr| per feature."""
    v = F.col("value")
    aggs = [F.max("n").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop")]
    if fit_scaler:
        for f in SCALED_FEATURES:
            aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    aggs += [safe_corr(F.col(f).cast("double"), v).alias(f"corr__{f}") for f in ENGINEERED_FEATURES]
    s = with_quartiles(frame, aggs, cfg)
    if fit_scaler:
        s = s.withColumns({
            f"{f}__scale": F.when(F.col(f"{f}__std").isNull() | (F.col(f"{f}__std") == 0), F.lit(1.0))
            .otherwise(F.col(f"{f}__std")) for f in SCALED_FEATURES}).drop(
            *[f"{f}__std" for f in SCALED_FEATURES])
    return s


def detection_frame(readings: DataFrame, cfg: DetectionConfig, scaler_model: DataFrame | None = None,
                    materialize: bool = True) -> DataFrame:
    """Every kept reading with features, scaled features and detector
    columns (``conf_<detector>``)."""
    return _detect(readings, cfg, scaler_model, materialize)[0]


def _detect(readings: DataFrame, cfg: DetectionConfig, scaler_model: DataFrame | None,
            materialize: bool):
    cfg = cfg.validate()
    frame = series_frame(readings, cfg)
    if cfg.temporal_anchor == "series_end":
        frame = with_series_end_pasts(frame)
    if materialize:
        frame = cut_lineage(frame)
        if cfg.quantiles == "exact" and (frame.agg(F.max("n")).first()[0] or 0) > cfg.quantile_map_rows:
            cfg = cfg.with_(quantiles="selection")  # the same values in bounded memory

    stats = _sensor_stats(frame, cfg, fit_scaler=scaler_model is None)
    if scaler_model is not None:
        stats = stats.join(model_wide(scaler_model), "sensor_id", "left")
    use_seasonal = "seasonal" in cfg.detectors
    if use_seasonal:
        stats = stats.join(seasonal_profile(frame, cfg), "sensor_id", "left")

    j = attach_per_sensor(frame, stats, cfg)
    j = j.withColumns({f"{f}_scaled": standardise(f, f"{f}__mean", f"{f}__scale")
                       for f in SCALED_FEATURES})
    if "statistical" in cfg.detectors:
        j = statistical_columns(j, cfg)

    round2 = []
    if use_seasonal:
        seas = F.element_at(F.col("seasonal_map"), F.pmod(F.col("pos"), F.lit(cfg.period)).cast("int"))
        j = j.withColumn("seasonal", seas).withColumn(
            "resid", F.col("value") - F.col("trend") - F.col("seasonal"))
        if cfg.legacy_shift:
            lead_seas = F.element_at(F.col("seasonal_map"),
                                     F.pmod(F.col("pos") + cfg.half_period, F.lit(cfg.period)).cast("int"))
            j = j.withColumn("resid_lead", F.col("lead_value") - F.col("lead_trend") - lead_seas)
        round2.append(F.stddev_samp("resid").alias("resid_std"))

    forest_scores, forest = None, None
    if "isolation_forest" in cfg.detectors:
        from ..operators.iforest import fit_forest, score_rows
        if materialize:  # fit and score both read these rows: cut here
            j = cut_lineage(j.drop("seasonal_map"))
        forest = fit_forest(j, cfg)
        if materialize:
            forest = cut_lineage(forest)
        forest_scores = score_rows(j, forest, cfg)
        if materialize:  # scores feed the threshold aggregate and the rows
            forest_scores = cut_lineage(forest_scores)
        j = forest_scores

    if round2 or forest_scores is not None:
        if forest_scores is not None:
            from ..operators.iforest import forest_thresholds
            s2 = forest_thresholds(j, [F.max("n").alias("n"), *round2], cfg)
        else:
            s2 = j.groupBy("sensor_id").agg(F.max("n").alias("n"), *round2)
        j = attach_per_sensor(j, s2, cfg)

    if use_seasonal:
        r = F.col("resid_lead") if cfg.legacy_shift else F.col("resid")
        bound = F.lit(cfg.residual_threshold) * F.col("resid_std")
        flag = F.coalesce((F.col("n") >= 2 * cfg.period) & (F.abs(r) > bound), F.lit(False))
        conf = F.least(F.coalesce(F.try_divide(F.abs(r), bound), F.lit(1.0)), F.lit(1.0))
        j = j.withColumn("conf_seasonal", F.when(flag, conf)).drop("seasonal_map")
    if forest_scores is not None:
        from ..operators.iforest import forest_confidence
        j = forest_confidence(j, cfg)
    return j, stats, forest


def sensor_attribution(frame_with_stats: DataFrame, cfg: DetectionConfig,
                       extra: list[DataFrame] | None = None) -> DataFrame:
    """E2 per sensor from the correlation columns already aggregated
    (``corr__<feature>``) plus the seasonal constants."""
    sensors = frame_with_stats.select("sensor_id", "n", *[f"corr__{f}" for f in ENGINEERED_FEATURES])
    parts = []
    if "statistical" in cfg.detectors:
        entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"corr__{f}").alias("importance"),
                                     F.lit(i).alias("ordinal"))
                            for i, f in enumerate(ENGINEERED_FEATURES)])
        parts.append(sensors.select("sensor_id", F.inline(entries)))
    parts += extra or []
    if "seasonal" in cfg.detectors:
        base = len(ENGINEERED_FEATURES) + (1 if extra else 0)
        parts.append(seasonal_importance_rows(sensors.select("sensor_id"), base))
    if not parts:  # no active detector ranks features: empty attributions
        none = F.array().cast("array<struct<feature:string,importance:double>>")
        return sensors.select("sensor_id", F.map_from_entries(none).alias("feature_attribution"), none.alias("attribution_ranked"), "n")
    return attribution_map(combined_importance(parts)).join(sensors.select("sensor_id", "n"), "sensor_id")


def detect_alerts(readings: DataFrame, cfg: DetectionConfig | None = None,
                  scaler_model: DataFrame | None = None, materialize: bool = True,
                  sensor_ids: Sequence[str] | None = None) -> DataFrame:
    """Alert rows for every sensor in ``readings``, or for ``sensor_ids`` alone (the filter reaches the scan)."""
    cfg = cfg or DetectionConfig()
    if sensor_ids is not None:
        readings = readings.filter(F.col("sensor_id").isin(list(sensor_ids)))
    j, stats, forest = _detect(readings, cfg, scaler_model, materialize)
    det = ensemble_detect(j, cfg)
    extra = []
    if cfg.permutation_importance and "isolation_forest" in cfg.detectors:
        from ..operators.iforest import permutation_importance_rows
        extra.append(permutation_importance_rows(j, cfg, forest))
    attr = sensor_attribution(stats, cfg, extra)
    det = attach_per_sensor(det, attr, cfg)
    return assemble_alerts(det, cfg)


def alerts_and_outbox(readings: DataFrame, cfg: DetectionConfig | None = None):
    cfg = cfg or DetectionConfig()
    alerts = detect_alerts(readings, cfg)
    return alerts, route_alerts(alerts, cfg.routes)
