"""Detection configuration and the fixed vocabularies of the engine.

Everything a query needs to know that is not in the data lives in a frozen
``DetectionConfig``.  Functions take it as an argument; nothing reads global
state.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Mapping

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being reproduced: detector
# names and their priority order, anomaly-type and severity words, feature
# names, the seasonal importance constants, feature explanations, domain
# rule texts and calendar sets, temporal-context labels.
# ---------------------------------------------------------------------------

DETECTOR_ORDER = ("statistical", "isolation_forest", "seasonal")
DEFAULT_WEIGHTS = {"statistical": 0.3, "isolation_forest": 0.4, "seasonal": 0.3}

ANOMALY_TYPES = (
    "abrupt_change",
    "seasonal_shift",
    "trend_anomaly",
    "statistical_outlier",
    "multi_scale_anomaly",
)
DETECTOR_TO_TYPE = {
    "statistical": "statistical_outlier",
    "isolation_forest": "multi_scale_anomaly",
    "seasonal": "seasonal_shift",
}
DEFAULT_ANOMALY_TYPE = "statistical_outlier"

SEVERITIES = ("low", "medium", "high", "critical")

ROLLING_WINDOWS = (12, 24, 168)
CALENDAR_FEATURES = ("hour", "day_of_week", "month")
# engineered columns in the order they are created (calendar, then mean/std per
# window, then the difference and its absolute value)
ENGINEERED_FEATURES = (
    "hour",
    "day_of_week",
    "month",
    "rolling_mean_12",
    "rolling_std_12",
    "rolling_mean_24",
    "rolling_std_24",
    "rolling_mean_168",
    "rolling_std_168",
    "rate_of_change",
    "rate_of_change_abs",
)
# columns standardised by the per-sensor scaler (calendar columns stay raw)
SCALED_FEATURES = (
    "value",
    "rolling_mean_12",
    "rolling_mean_24",
    "rolling_mean_168",
    "rolling_std_12",
    "rolling_std_24",
    "rolling_std_168",
    "rate_of_change",
    "rate_of_change_abs",
)
# input of the isolation forest: the value and every engineered column
FOREST_FEATURES = ("value",) + ENGINEERED_FEATURES

SEASONAL_IMPORTANCE = {
    "seasonal_component": 0.8,
    "trend_component": 0.6,
    "residual_component": 1.0,
}

FEATURE_EXPLANATIONS = {
    "rolling_mean_24": "24-hour average shows unusual pattern (impact: %s)",
    "rate_of_change": "Rapid value changes detected (impact: %s)",
    "hour": "Time-of-day pattern anomaly (impact: %s)",
    "day_of_week": "Day-of-week pattern anomaly (impact: %s)",
    "rolling_std_168": "Weekly volatility pattern anomaly (impact: %s)",
}
DEFAULT_EXPLANATION = "%s shows anomalous behavior (impact: %s)"

PEAK_HOURS = (17, 18, 19, 20)
OFF_PEAK_HOURS = (1, 2, 3, 4, 5)
HIGH_DEMAND_MONTHS = (6, 7, 8, 12, 1, 2)
MAINTENANCE_HOURS = (2, 3, 4)
SUMMER_MONTHS = (6, 7, 8)
WINTER_MONTHS = (12, 1, 2)
RULE_PEAK = "Anomaly occurred during peak demand hours - may indicate grid stress"
RULE_WEEKEND = "Weekend anomaly detected - unusual for typical consumption patterns"
RULE_SUMMER = "Summer period anomaly - possible AC load or cooling system issue"
RULE_WINTER = "Winter period anomaly - possible heating system issue"

TEMPORAL_LOOKBACKS = ((24, "same time yesterday"), (168, "same time last week"))
TEMPORAL_CHANGE_PCT = 20.0

INTERPOLATION_METHODS = ("linear", "time", "ffill", "nearest")


@dataclass(frozen=True)
class Routes:
    """Alert recipients per channel; an empty tuple disables the channel."""

    email: tuple[str, ...] = ()
    sms: tuple[str, ...] = ()
    email_sender: str = ""


@dataclass(frozen=True)
class DetectionConfig:
    # detector parameters
    z_threshold: float = 3.0
    iqr_multiplier: float = 1.5
    contamination: float = 0.1
    n_estimators: int = 100
    max_samples: int = 256
    forest_seed: int = 42
    period: int = 24
    residual_threshold: float = 2.0
    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    detectors: tuple[str, ...] = DETECTOR_ORDER
    min_ensemble_confidence: float = 0.5
    # cleaning
    interpolation: str = "linear"
    min_points: int = 0  # 10 on the streaming path
    # seasonal alignment: True reproduces the half-period early placement
    legacy_shift: bool = False
    # attribution: include the forest's permutation importance
    permutation_importance: bool = False
    # temporal context anchor: "anomaly" (lag from the alert row) or
    # "series_end" (count back from the last row of the series)
    temporal_anchor: str = "anomaly"
    # quantiles: "exact" (a value -> count map per sensor; the batch job selects
    # instead when a series is longer than ``quantile_map_rows``), "selection"
    # (as exact, bounded memory, more passes) or "approx" (one sketch)
    quantiles: str = "exact"
    quantile_map_rows: int = 1_000_000
    quantile_accuracy: int = 100_000
    # physical layout.  A series is never one task: rows are ordered inside
    # time chunks of about ``chunk_rows`` rows and processed in position
    # blocks of ``block_rows`` rows with a halo of neighbouring rows.
    chunk_rows: int = 1 << 17
    block_rows: int = 1 << 17
    # fixed processing time for reproducible output (None -> current time)
    processing_time: str | None = None
    routes: Routes = field(default_factory=Routes)

    def with_(self, **kw) -> "DetectionConfig":
        return replace(self, **kw)

    @property
    def half_period(self) -> int:
        return self.period // 2

    @property
    def halo_back(self) -> int:
        """Rows a block needs from its predecessor: the longest rolling
        frame (167 rows back), the longest lag (168) and the centred trend
        (half a period back)."""
        return max(max(ROLLING_WINDOWS), max(k for k, _ in TEMPORAL_LOOKBACKS), self.half_period, 1)

    @property
    def halo_forward(self) -> int:
        """Rows a block needs from its successor: the centred trend reaches
        half a period ahead; the legacy placement reads a residual half a
        period ahead, whose trend reaches one more half period."""
        h = max(self.half_period, 1)
        return 2 * h if self.legacy_shift else h

    def validate(self) -> "DetectionConfig":
        if self.interpolation not in INTERPOLATION_METHODS:
            raise ValueError(f"interpolation must be one of {INTERPOLATION_METHODS}")
        if self.block_rows < self.halo_back + self.halo_forward + 1:
            raise ValueError("block_rows must exceed the halo")
        if self.period < 2:
            raise ValueError("period must be >= 2")
        if self.quantiles not in ("exact", "selection", "approx"):
            raise ValueError("quantiles must be 'exact', 'selection' or 'approx'")
        unknown = set(self.detectors) - set(DETECTOR_ORDER)
        if unknown:
            raise ValueError(f"unknown detectors {unknown}")
        return self


def config_from_dict(d: Mapping) -> DetectionConfig:
    """Build a config from the nested dictionary layout (thresholds under
    ``detection_thresholds``, recipients under ``alert_recipients``)."""
    th = d.get("detection_thresholds", {})
    rec = d.get("alert_recipients", {})
    email = d.get("email", {})
    kw = {}
    if "statistical_threshold" in th:
        kw["z_threshold"] = float(th["statistical_threshold"])
    if "isolation_contamination" in th:
        kw["contamination"] = float(th["isolation_contamination"])
    if "seasonal_period" in th:
        kw["period"] = int(th["seasonal_period"])
    routes = Routes(
        email=tuple(rec.get("email", ())) if email else (),
        sms=tuple(rec.get("sms", ())) if d.get("sms") else (),
        email_sender=email.get("username", Routes.email_sender),
    )
    return DetectionConfig(routes=routes, **kw).validate()
