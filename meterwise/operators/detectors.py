"""Extension points: the detector protocol and an ensemble over any detectors.

A detector takes a series frame (see ``features.series_frame``) and gives long
rows ``(sensor_id, timestamp, row_id, confidence)``; optionally it ranks
features per sensor.  ``Ensemble`` merges the long detections of any detectors
(J1: one row per reading with a map detector -> confidence) and combines them by
weight, with the same rules as the wide path of the built-in detectors.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import DetectionConfig
from ..functions.text import detector_type

DETECTION_KEYS = ("sensor_id", "timestamp", "row_id")


@runtime_checkable
class Detector(Protocol):
    name: str

    def detect(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        """(sensor_id, timestamp, row_id, confidence) of the readings that are anomalies."""

    def importance(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame | None:
        """(sensor_id, feature, importance, ordinal), or None."""


def _hits(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).select(*DETECTION_KEYS, F.col(col).alias("confidence"))


class StatisticalDetector:
    name = "statistical"

    def detect(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .statistical import statistical_detect
        return _hits(statistical_detect(frame, cfg), "conf_statistical")

    def importance(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .statistical import correlation_importance
        return correlation_importance(frame)


class SeasonalDetector:
    name = "seasonal"

    def detect(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .seasonal import seasonal_detect
        return _hits(seasonal_detect(frame, cfg), "conf_seasonal")

    def importance(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .ensemble import seasonal_importance_rows
        return seasonal_importance_rows(frame.select("sensor_id").distinct(), 0)


class IsolationForestDetector:
    name = "isolation_forest"

    def _scaled(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .scaler import apply_scaler, fit_scaler
        return apply_scaler(frame, fit_scaler(frame, cfg))

    def detect(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .iforest import iforest_detect
        return _hits(iforest_detect(self._scaled(frame, cfg), cfg), "conf_isolation_forest")

    def importance(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .iforest import permutation_importance_rows
        return permutation_importance_rows(self._scaled(frame, cfg), cfg)


class PandasDetector:
    """A detector from a function over pandas: it gets some neighbouring rows of one sensor, in order of ``pos``, and returns a
    confidence for each row (missing: no anomaly).

    The function sees a block of positions with the ``back`` rows before it and the ``ahead`` rows after it; what it returns
    for those is left out.  A function that looks no further gives the result over the whole series, while no group is
    larger than a block with its halo."""

    def __init__(self, name: str, fn: Callable[[pd.DataFrame], pd.Series], back: int = 0, ahead: int = 0, columns: Sequence[str] = ("value",)):
        self.name, self.fn, self.back, self.ahead, self.columns = name, fn, back, ahead, tuple(columns)

    def detect(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        from .layout import CORE, with_halo
        fn, keys = self.fn, list(DETECTION_KEYS)
        columns = list(dict.fromkeys([*keys, "pos", "n", *self.columns]))
        blocks = with_halo(frame.select(*columns), cfg.block_rows, self.back, self.ahead)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos", ignore_index=True)
            confidence = pd.Series(fn(pdf.drop(columns=["role", "blk"])), dtype=float).reset_index(drop=True)
            if len(confidence) != len(pdf):
                raise ValueError(f"{self.name} returned {len(confidence)} confidences for {len(pdf)} rows")
            hit = (pdf["role"] == CORE) & confidence.notna()
            return pdf.loc[hit, keys].assign(confidence=confidence[hit])

        kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
        schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", confidence double"
        return blocks.groupBy("sensor_id", "blk").applyInPandas(run, schema)

    def importance(self, frame: DataFrame, cfg: DetectionConfig) -> None:
        return None


def merge_detections(long: DataFrame) -> DataFrame:
    """(sensor_id, timestamp, row_id, detector, confidence) rows to one row per reading with a map
    detector -> confidence.  A map holds one entry per detector."""
    return (long.groupBy(*DETECTION_KEYS)
                .agg(F.map_from_entries(F.collect_list(F.struct("detector", "confidence"))).alias("detector_scores")))


@dataclass(frozen=True)
class Ensemble:
    """Weighted combination of any detectors, in the given order (ties go to the earlier one)."""

    detectors: Sequence[Detector]
    weights: Mapping[str, float]

    def __post_init__(self):
        names = [d.name for d in self.detectors]
        if len(set(names)) != len(names):
            raise ValueError(f"detector names repeat: {names}")
        if missing := set(names) - set(self.weights):
            raise ValueError(f"no weight for {missing}")

    def detections(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        """The long detections of all detectors."""
        out = None
        for d in self.detectors:
            rows = d.detect(frame, cfg).select(*DETECTION_KEYS, F.lit(d.name).alias("detector"), "confidence")
            out = rows if out is None else out.unionByName(rows)
        return out

    def detect(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame:
        """Readings whose weighted confidence is strictly above the minimum, with ``detector_scores``,
        ``ensemble_confidence``, ``strongest_detector`` and ``anomaly_type``."""
        merged = merge_detections(self.detections(frame, cfg))
        score = {d.name: F.col("detector_scores")[d.name] for d in self.detectors}
        num = den = F.lit(0.0)
        top = F.array_max(F.map_values("detector_scores"))
        strongest = None
        for name, c in score.items():
            w = F.lit(float(self.weights[name]))
            num = num + F.when(c.isNotNull(), w * c).otherwise(F.lit(0.0))
            den = den + F.when(c.isNotNull(), w).otherwise(F.lit(0.0))
            strongest = F.when(c == top, name) if strongest is None else strongest.when(c == top, name)
        out = merged.withColumns({"ensemble_confidence": F.try_divide(num, den), "strongest_detector": strongest})
        out = out.withColumn("anomaly_type", detector_type("strongest_detector"))
        return out.filter(F.col("ensemble_confidence") > F.lit(cfg.min_ensemble_confidence))

    def importance(self, frame: DataFrame, cfg: DetectionConfig) -> DataFrame | None:
        """Importances averaged over the detectors that rank features; None where none does."""
        from .ensemble import combined_importance
        parts = [p for d in self.detectors if (p := d.importance(frame, cfg)) is not None]
        return combined_importance(parts) if parts else None
