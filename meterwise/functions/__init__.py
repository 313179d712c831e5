"""Column-expression helpers (JVM-side built-ins only, no Python UDFs)."""

from .time import epoch_micros, from_epoch_micros, trunc_hour, calendar_columns
from .numeric import standardise, fmt_num, fold_nan
from .text import severity, detector_type, explain_feature, domain_rules

__all__ = [
    "epoch_micros", "from_epoch_micros", "trunc_hour", "calendar_columns",
    "standardise", "fmt_num", "fold_nan",
    "severity", "detector_type", "explain_feature", "domain_rules",
]
