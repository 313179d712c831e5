"""Vocabulary expressions: severity, detector type, feature explanations and
domain rules (A1, C10, R1, R2)."""

from pyspark.sql import Column, functions as F

from ..config import (
    DEFAULT_ANOMALY_TYPE, DEFAULT_EXPLANATION, DETECTOR_TO_TYPE, FEATURE_EXPLANATIONS,
    PEAK_HOURS, RULE_PEAK, RULE_SUMMER, RULE_WEEKEND, RULE_WINTER, SUMMER_MONTHS,
    WINTER_MONTHS,
)
from .numeric import fmt_num


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def severity(conf) -> Column:
    c = _c(conf)
    return (F.when(c > 0.9, "critical").when(c > 0.7, "high")
            .when(c > 0.5, "medium").otherwise("low"))


def detector_type(detector) -> Column:
    d = _c(detector)
    expr = None
    for name, typ in DETECTOR_TO_TYPE.items():
        expr = (F.when(d == name, typ) if expr is None else expr.when(d == name, typ))
    return expr.otherwise(DEFAULT_ANOMALY_TYPE)


def explain_feature(feature, importance) -> Column:
    f = _c(feature)
    expr = None
    for name, tmpl in FEATURE_EXPLANATIONS.items():
        expr = F.when(f == name, F.lit(tmpl)) if expr is None else expr.when(f == name, F.lit(tmpl))
    # the number is rendered once and put into the template that was chosen
    return F.replace(expr.otherwise(F.format_string(DEFAULT_EXPLANATION, f, F.lit("%s"))), F.lit("%s"), fmt_num(importance, 2))


def domain_rules(ts, peak_hours=PEAK_HOURS) -> Column:
    """Ordered list of insight texts for an alert timestamp."""
    t = _c(ts)
    m = F.month(t)
    return F.filter(
        F.array(
            F.when(F.hour(t).isin(list(peak_hours)), F.lit(RULE_PEAK)),
            F.when(F.weekday(t) >= 5, F.lit(RULE_WEEKEND)),
            F.when(m.isin(list(SUMMER_MONTHS)), F.lit(RULE_SUMMER))
             .when(m.isin(list(WINTER_MONTHS)), F.lit(RULE_WINTER)),
        ),
        lambda x: x.isNotNull(),
    )
