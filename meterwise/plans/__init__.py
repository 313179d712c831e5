"""Composed plans: the batch detection job and the named query catalog."""

from .batch import detect_alerts, detection_frame, alerts_and_outbox

__all__ = ["detect_alerts", "detection_frame", "alerts_and_outbox"]
