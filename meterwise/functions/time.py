"""Time expressions on wall-clock (TIMESTAMP_NTZ) columns.

All arithmetic goes through microseconds since 1970-01-01 of the wall clock,
so results never depend on the session time zone.
"""

from pyspark.sql import Column, functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(ts) if isinstance(ts, str) else ts)


def from_epoch_micros(us) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH))


def trunc_hour(ts) -> Column:
    us = epoch_micros(ts)
    return from_epoch_micros(us - F.pmod(us, F.lit(3_600_000_000)))


def calendar_columns(ts: str = "timestamp") -> dict[str, Column]:
    """hour of day, day of week with Monday = 0, month."""
    c = F.col(ts)
    return {
        "hour": F.hour(c),
        "day_of_week": F.weekday(c),
        "month": F.month(c),
    }
