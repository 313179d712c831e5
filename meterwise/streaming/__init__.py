"""Structured Streaming entry points."""

from .microbatch import read_committed, start_batch_isolated, run_batch_isolated
from .continuous import continuous_features, heartbeat, start_continuous, start_continuous_detection

__all__ = ["start_batch_isolated", "run_batch_isolated", "read_committed", "continuous_features", "heartbeat", "start_continuous",
           "start_continuous_detection"]
