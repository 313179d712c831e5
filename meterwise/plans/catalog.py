"""Named queries over the given tables: one per operator of the inventory.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame whose doubles are
rounded (``r6``) so results can be compared with an independent SQL run.
Inputs are derived from the whole ``events`` table (see ``sources.fixtures``):

* ``hourly``  - hourly grid per event type, NULL in empty hours (main fixture)
* ``raw``     - every event, one series per event type, ``row_id = event_id``
* ``users``   - every event, one series per user (many short series)
* ``gappy``   - ``raw`` with the value missing where the event's ``props.k``
                is below 10 (irregular spacing *and* gaps)
* ``user_gappy`` - the same rule on the per-user series
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import (ENGINEERED_FEATURES, SCALED_FEATURES, DetectionConfig, Routes)
from ..functions.text import domain_rules, explain_feature
from ..operators.alerts import assemble_alerts
from ..operators.detectors import Ensemble, PandasDetector, StatisticalDetector
from ..operators.ensemble import ensemble_columns, ensemble_detect
from ..operators.features import series_frame
from ..operators.layout import attach_per_sensor, clean_series, min_points_guard
from ..operators.outbox import (attribution_lines, email_outbox, route_alerts, sms_outbox)
from ..operators.quantiles import exact_quantiles
from ..operators.rootcause import past_columns, temporal_context
from ..operators.scaler import apply_scaler, fit_scaler
from ..operators.seasonal import decompose, phase_means, seasonal_detect
from ..operators.statistical import correlation_importance, statistical_detect
from ..operators.stats import series_stats
from ..operators.windowed import windowed_stats
from ..sources import normalize_readings, quarantine
from ..sources.fixtures import hourly_by_type, load_table, orders_by_priority, raw_by_type, raw_by_user
from .batch import _detect, detect_alerts, sensor_attribution

# fixed processing time so rendered messages are reproducible
FIXED_PROCESSING_TIME = "2024-02-01 00:00:00"
TWO = DetectionConfig(detectors=("statistical", "seasonal"), processing_time=FIXED_PROCESSING_TIME)
ROUTES = Routes(email=("ops@example.org", "lead@example.org"), sms=("+10000000000",), email_sender="alerts@example.org")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), 6)


def _gappy(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    ev = load_table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    return (df.join(ev, "row_id")
              .withColumn("value", F.when(F.col("k") >= 10, F.col("value")))
              .drop("k"))


def gappy(spark, sf):
    return _gappy(raw_by_type(spark, sf), spark, sf)


def user_gappy(spark, sf):
    return _gappy(raw_by_user(spark, sf), spark, sf)


# --------------------------------------------------------------------------- cleaning
def q_interpolate_linear(spark, sf):
    c = clean_series(hourly_by_type(spark, sf), TWO)
    return c.select("sensor_id", "timestamp", r6("value").alias("value"), "imputed",
                    F.col("pos").cast("bigint").alias("pos"))


def _interp(method):
    def q(spark, sf):
        c = clean_series(gappy(spark, sf), TWO.with_(interpolation=method))
        return c.select("sensor_id", "timestamp", "row_id", r6("value").alias("value"),
                        F.col("pos").cast("bigint").alias("pos"))
    return q


def q_drop_incomplete(spark, sf):
    raw = user_gappy(spark, sf)
    kept = clean_series(raw, TWO)
    a = raw.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_raw"))
    b = kept.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n_kept"),
                                      F.min("timestamp").alias("first_kept"))
    return a.join(b, "sensor_id", "left").select(
        "sensor_id", "n_raw", F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept"), "first_kept")


def q_min_points_guard(spark, sf):
    cfg = TWO.with_(min_points=60)
    c = min_points_guard(clean_series(raw_by_user(spark, sf), cfg), cfg)
    return c.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- features
def _frame(spark, sf, cfg=TWO):
    return series_frame(hourly_by_type(spark, sf), cfg)


def q_calendar_features(spark, sf):
    return _frame(spark, sf).select("sensor_id", "timestamp",
                                    *[F.col(c).cast("bigint").alias(c) for c in ("hour", "day_of_week", "month")])


def q_rolling_mean(spark, sf):
    return _frame(spark, sf).select("sensor_id", "timestamp",
                                    *[r6(f"rolling_mean_{k}").alias(f"rolling_mean_{k}") for k in (12, 24, 168)])


def q_rolling_std(spark, sf):
    return _frame(spark, sf).select("sensor_id", "timestamp",
                                    *[r6(f"rolling_std_{k}").alias(f"rolling_std_{k}") for k in (12, 24, 168)])


def q_rate_of_change(spark, sf):
    return _frame(spark, sf).select("sensor_id", "timestamp", r6("rate_of_change").alias("rate_of_change"),
                                    r6("rate_of_change_abs").alias("rate_of_change_abs"))


def q_features_wide(spark, sf):
    cols = [F.col(c).cast("bigint").alias(c) if c in ("hour", "day_of_week", "month") else r6(c).alias(c)
            for c in ENGINEERED_FEATURES]
    return _frame(spark, sf).select("sensor_id", "timestamp", r6("value").alias("value"), *cols)


def q_scaler_fit(spark, sf):
    m = fit_scaler(_frame(spark, sf), TWO)
    return m.select("sensor_id", "feature", r6("mean").alias("mean"), r6("scale").alias("scale"), "n")


def q_scaler_apply(spark, sf):
    f = _frame(spark, sf)
    s = apply_scaler(f, fit_scaler(f, TWO))
    return s.select("sensor_id", "timestamp", *[r6(f"{c}_scaled").alias(f"{c}_scaled") for c in SCALED_FEATURES])


# --------------------------------------------------------------------------- statistics
def q_series_stats(spark, sf):
    c = clean_series(raw_by_type(spark, sf), TWO)
    s = series_stats(c, TWO)
    return s.select("sensor_id", F.col("n_values").alias("n"), r6("mean").alias("mean"),
                    r6("std_pop").alias("std_pop"), r6("std_samp").alias("std_samp"),
                    r6("q1").alias("q1"), r6("q3").alias("q3"), "min", "max")


def q_phase_means(spark, sf):
    pm = phase_means(_frame(spark, sf), TWO)
    return pm.select("sensor_id", F.col("phase").cast("bigint").alias("phase"),
                     r6("phase_mean").alias("phase_mean"), r6("seasonal").alias("seasonal"))


def q_expected_range(spark, sf):
    s = series_stats(_frame(spark, sf), TWO)
    return s.select("sensor_id", r6(F.col("mean") - 2.0 * F.col("std_pop")).alias("lower"),
                    r6(F.col("mean") + 2.0 * F.col("std_pop")).alias("upper"))


def q_feature_correlation(spark, sf):
    imp = correlation_importance(_frame(spark, sf))
    return imp.select("sensor_id", "feature", r6("importance").alias("importance"))


# --------------------------------------------------------------------------- detection
def _raw_stat(spark, sf):
    return statistical_detect(series_frame(raw_by_type(spark, sf), TWO), TWO)


def q_zscore_outliers(spark, sf):
    d = _raw_stat(spark, sf)
    return d.filter(F.col("z_flag")).select("sensor_id", "timestamp", "row_id", r6("z").alias("z"))


def q_iqr_fences(spark, sf):
    d = _raw_stat(spark, sf)
    return d.groupBy("sensor_id").agg(
        r6(F.first("q1")).alias("q1"), r6(F.first("q3")).alias("q3"),
        r6(F.first("iqr_lower")).alias("lower"), r6(F.first("iqr_upper")).alias("upper"),
        F.sum(F.col("iqr_flag").cast("bigint")).alias("n_flagged"))


def q_statistical_detect(spark, sf):
    d = statistical_detect(series_frame(raw_by_user(spark, sf), TWO), TWO)
    return (d.filter(F.col("conf_statistical").isNotNull())
             .select("sensor_id", "timestamp", "row_id", r6("conf_statistical").alias("confidence")))


def q_seasonal_trend(spark, sf):
    return (_frame(spark, sf).filter(F.col("trend").isNotNull())
            .select("sensor_id", "timestamp", r6("trend").alias("trend")))


def q_seasonal_decompose(spark, sf):
    d = decompose(_frame(spark, sf), TWO)
    return (d.filter(F.col("trend").isNotNull())
             .select("sensor_id", "timestamp", r6("trend").alias("trend"),
                     r6("seasonal").alias("seasonal"), r6("resid").alias("resid")))


def q_seasonal_detect(spark, sf):
    d = seasonal_detect(_frame(spark, sf), TWO)
    return (d.filter(F.col("conf_seasonal").isNotNull())
             .select("sensor_id", "timestamp", r6("conf_seasonal").alias("confidence")))


# --------------------------------------------------------------------------- ensemble
def _two(spark, sf):
    j, stats, _ = _detect(hourly_by_type(spark, sf), TWO, None, True)
    return j, stats


def _hits(j):
    return j.filter(F.col("conf_statistical").isNotNull() | F.col("conf_seasonal").isNotNull())


def q_merge_detections(spark, sf):
    j, _ = _two(spark, sf)
    return _hits(j).select("sensor_id", "timestamp", r6("conf_statistical").alias("conf_statistical"),
                           r6("conf_seasonal").alias("conf_seasonal"))


def q_argmax_detector(spark, sf):
    j, _ = _two(spark, sf)
    return ensemble_columns(_hits(j), TWO).select("sensor_id", "timestamp", "strongest_detector", "anomaly_type")


def q_ensemble_two_detectors(spark, sf):
    j, _ = _two(spark, sf)
    return ensemble_detect(j, TWO).select("sensor_id", "timestamp", r6("ensemble_confidence").alias("confidence"),
                                          "anomaly_type")


def _attribution(spark, sf):
    j, stats = _two(spark, sf)
    return j, stats, sensor_attribution(stats, TWO)


def q_combined_importance(spark, sf):
    _, _, attr = _attribution(spark, sf)
    return attr.select("sensor_id", F.explode("attribution_ranked").alias("e")).select(
        "sensor_id", F.col("e.feature").alias("feature"), r6("e.importance").alias("importance"))


def q_explain_feature(spark, sf):
    _, _, attr = _attribution(spark, sf)
    top = attr.select("sensor_id", F.posexplode(F.slice("attribution_ranked", 1, 3)).alias("rank", "e"))
    return top.select("sensor_id", (F.col("rank") + 1).cast("bigint").alias("rank"),
                      explain_feature(F.col("e.feature"), F.col("e.importance")).alias("explanation"))


def _alerts(spark, sf):
    j, stats, attr = _attribution(spark, sf)
    det = attach_per_sensor(ensemble_detect(j, TWO), attr, TWO)
    return assemble_alerts(det, TWO), det


def q_domain_rules(spark, sf):
    a, _ = _alerts(spark, sf)
    return a.select("sensor_id", "timestamp", F.array_join(domain_rules(F.col("timestamp")), "; ").alias("insights"))


def q_temporal_context(spark, sf):
    _, det = _alerts(spark, sf)
    return det.select("sensor_id", "timestamp",
                      temporal_context(F.col("value"), past_columns(TWO)).alias("context"))


def q_root_cause_summary(spark, sf):
    a, _ = _alerts(spark, sf)
    return a.select("sensor_id", "timestamp", "root_cause_summary")


def q_root_cause_series_end(spark, sf):
    """R3 with the temporal context counted back from the end of the series."""
    a = detect_alerts(hourly_by_type(spark, sf), TWO.with_(temporal_anchor="series_end"))
    return a.select("sensor_id", "timestamp", "root_cause_summary")


def q_severity(spark, sf):
    a, _ = _alerts(spark, sf)
    return a.select("sensor_id", "timestamp", r6("confidence_score").alias("confidence_score"), "severity")


def q_attribution_top5(spark, sf):
    _, _, attr = _attribution(spark, sf)
    return attr.select("sensor_id", attribution_lines(F.col("attribution_ranked")).alias("lines"))


def q_alert_routing(spark, sf):
    a, _ = _alerts(spark, sf)
    return route_alerts(a, ROUTES).select("sensor_id", "timestamp", "channel", "to")


def q_email_outbox(spark, sf):
    a, _ = _alerts(spark, sf)
    return email_outbox(a, ROUTES).select("sensor_id", "timestamp", "subject", "body")


def q_sms_outbox(spark, sf):
    a, _ = _alerts(spark, sf)
    return sms_outbox(a, ROUTES).select("sensor_id", "timestamp", "body")


def q_alerts_per_sensor(spark, sf):
    a, _ = _alerts(spark, sf)
    return a.groupBy("sensor_id", "anomaly_type", "severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def q_alert_values(spark, sf):
    a, _ = _alerts(spark, sf)
    return a.select("sensor_id", "timestamp", r6("value").alias("value"),
                    r6("value_scaled").alias("value_scaled"),
                    r6("expected_range.lower").alias("lower"), r6("expected_range.upper").alias("upper"),
                    r6("expected_range_scaled.lower").alias("lower_scaled"),
                    r6("expected_range_scaled.upper").alias("upper_scaled"),
                    F.col("metadata.data_points_used").alias("data_points_used"))


# --------------------------------------------------------------------------- extension
class SurgeDetector:
    """A plug-in detector: the value is more than three times its rolling 24-row mean."""

    name = "surge"

    def detect(self, frame, cfg):
        ratio = F.col("value") / F.col("rolling_mean_24")
        return (frame.filter((F.col("rolling_mean_24") > 0) & (ratio > 3.0))
                .select("sensor_id", "timestamp", "row_id", F.least(ratio / 6.0, F.lit(1.0)).alias("confidence")))

    def importance(self, frame, cfg):
        return None


def q_ensemble_plugin(spark, sf):
    e = Ensemble([StatisticalDetector(), SurgeDetector()], {"statistical": 0.3, "surge": 0.7})
    return e.detect(_frame(spark, sf), TWO).select("sensor_id", "timestamp", r6("ensemble_confidence").alias("confidence"),
                                                   "strongest_detector", F.size("detector_scores").cast("bigint").alias("n_detectors"))


def q_seasonal_long_period(spark, sf):
    """A period far longer than the halo of the rolling frames, over blocks of 800 rows."""
    cfg = TWO.with_(period=400, block_rows=800)
    d = seasonal_detect(series_frame(raw_by_type(spark, sf), cfg), cfg)
    return d.filter(F.col("trend").isNotNull()).groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("n_trend"), F.count("conf_seasonal").alias("n_hits"), r6(F.sum("trend")).alias("sum_trend"))


def q_domain_rules_orders(spark, sf):
    """R2 over all months of the year."""
    o = orders_by_priority(spark, sf)
    return o.select("sensor_id", "row_id", F.array_join(domain_rules(F.col("timestamp")), "; ").alias("insights"))


def q_quarantine_counts(spark, sf):
    """kept and quarantined rows add up to the input; some timestamps and sensors are spoilt by rule."""
    ev = load_table(spark, sf, "events")
    i = F.col("event_id")
    raw = ev.select(F.when(i % 97 != 0, F.col("event_type")).alias("sensor_id"),
                    F.when(i % 89 == 0, F.lit("not a time")).when(i % 83 != 0, F.col("ts").cast("string")).alias("timestamp"),
                    F.col("value").cast("double").alias("value"))
    kept = normalize_readings(raw).select(F.lit("kept").alias("outcome"))
    return kept.unionAll(quarantine(raw).select("reason")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def q_detect_alerts_two(spark, sf):
    """A4 with the two deterministic detectors, whole alert rows."""
    a = detect_alerts(hourly_by_type(spark, sf), TWO)
    return a.select("sensor_id", "timestamp", "anomaly_type", "severity", r6("value").alias("value"), r6("confidence_score").alias("confidence_score"),
                    "root_cause_summary", F.col("metadata.data_points_used").alias("data_points_used"))


def q_quantile_selection(spark, sf):
    """G5 without a value map: small bounds, so that several passes are needed."""
    q = exact_quantiles(raw_by_type(spark, sf), (0.05, 0.25, 0.5, 0.75, 0.95), grid=64, limit=200)
    return q.select("sensor_id", *[r6(F.get("quantiles", F.lit(i))).alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))])


def q_statistical_selection(spark, sf):
    """D1 with selected quartiles: the same detections."""
    cfg = TWO.with_(quantiles="selection")
    d = statistical_detect(series_frame(raw_by_type(spark, sf), cfg), cfg)
    return d.filter(F.col("conf_statistical").isNotNull()).select("sensor_id", "timestamp", "row_id", r6("conf_statistical").alias("confidence"))


def rolling_median(rows):
    """A user's detector over pandas rows in order: the value is more than four times the median of the last 25 rows."""
    ratio = rows["value"] / rows["value"].rolling(25, min_periods=1).median()
    return (ratio / 8.0).clip(upper=1.0).where(ratio > 4.0)


def q_pandas_detector(spark, sf):
    """A plug-in detector written for pandas, over position blocks of 400 rows."""
    cfg = TWO.with_(block_rows=400)
    d = PandasDetector("rolling_median", rolling_median, back=24).detect(series_frame(raw_by_type(spark, sf), cfg), cfg)
    return d.select("sensor_id", "timestamp", "row_id", r6("confidence").alias("confidence"))


def q_windowed_stats(spark, sf):
    w = windowed_stats(raw_by_type(spark, sf), "1 hour")
    return w.select("sensor_id", "window_start", "window_end", "n", r6("mean").alias("mean"),
                    r6("stddev").alias("stddev"), "max", "min")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interpolate_linear": q_interpolate_linear,
    "interpolate_time": _interp("time"),
    "interpolate_ffill": _interp("ffill"),
    "interpolate_nearest": _interp("nearest"),
    "drop_incomplete": q_drop_incomplete,
    "min_points_guard": q_min_points_guard,
    "calendar_features": q_calendar_features,
    "rolling_mean": q_rolling_mean,
    "rolling_std": q_rolling_std,
    "rate_of_change": q_rate_of_change,
    "features_wide": q_features_wide,
    "scaler_fit": q_scaler_fit,
    "scaler_apply": q_scaler_apply,
    "series_stats": q_series_stats,
    "phase_means": q_phase_means,
    "expected_range": q_expected_range,
    "feature_correlation": q_feature_correlation,
    "zscore_outliers": q_zscore_outliers,
    "iqr_fences": q_iqr_fences,
    "statistical_detect": q_statistical_detect,
    "seasonal_trend": q_seasonal_trend,
    "seasonal_decompose": q_seasonal_decompose,
    "seasonal_detect": q_seasonal_detect,
    "merge_detections": q_merge_detections,
    "argmax_detector": q_argmax_detector,
    "ensemble_two_detectors": q_ensemble_two_detectors,
    "combined_importance": q_combined_importance,
    "explain_feature": q_explain_feature,
    "domain_rules": q_domain_rules,
    "temporal_context": q_temporal_context,
    "root_cause_summary": q_root_cause_summary,
    "root_cause_series_end": q_root_cause_series_end,
    "severity": q_severity,
    "attribution_top5": q_attribution_top5,
    "alert_routing": q_alert_routing,
    "email_outbox": q_email_outbox,
    "sms_outbox": q_sms_outbox,
    "alerts_per_sensor": q_alerts_per_sensor,
    "alert_values": q_alert_values,
    "windowed_stats": q_windowed_stats,
    "quantile_selection": q_quantile_selection,
    "statistical_selection": q_statistical_selection,
    "pandas_detector": q_pandas_detector,
    "ensemble_plugin": q_ensemble_plugin,
    "seasonal_long_period": q_seasonal_long_period,
    "domain_rules_orders": q_domain_rules_orders,
    "quarantine_counts": q_quarantine_counts,
    "detect_alerts_two": q_detect_alerts_two,
}
