"""Numeric expressions: safe division, capping, standardisation, number
formatting that rounds like printf on the binary value."""

from pyspark.sql import Column, functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def standardise(x, mean, scale) -> Column:
    """(x - mean) / scale with scale 1 where the spread is 0."""
    s = _c(scale)
    return (_c(x) - _c(mean)) / F.when(s == 0, F.lit(1.0)).otherwise(s)


def fold_nan(x) -> Column:
    """NaN -> NULL: one notion of a missing value."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


#: Splits a double into two halves of 26 bits whose products are exact.
_SPLITTER = 134217729.0


def fmt_num(x, decimals: int) -> Column:
    """The text C printf gives for ``%.<decimals>f`` (1 to 6 decimals): the
    *binary* value is rounded, exact ties to the even digit (2.675 -> 2.67,
    12.25 -> 12.2).  Spark's own format_string rounds the shortest decimal
    text half up instead.

    The whole part and the fraction g are exact; g * 10^decimals is computed
    as a rounded product and its exact error, so the comparison with one half
    is exact.  From 2^63 on the whole part is left to format_string."""
    c = _c(x).cast("double")
    m = float(10 ** decimals)
    a = F.abs(c)
    whole = F.floor(a)
    g = a - whole.cast("double")
    p = g * m
    hi = g * _SPLITTER - (g * _SPLITTER - g)
    err = (hi * m - p) + (g - hi) * m
    low = F.floor(p)
    over = (p - low.cast("double")) - 0.5
    up = (over > 0) | ((over == 0) & ((err > 0) | ((err == 0) & (low % 2 == 1))))
    digits = low + F.when(up, 1).otherwise(0)
    carry = F.when(digits >= int(m), 1).otherwise(0)
    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, (whole + carry).cast("string"), F.lit("."),
                    F.lpad((digits - carry * int(m)).cast("string"), decimals, "0"))
    return (F.when(F.isnan(c), F.lit("nan")).when(a == float("inf"), F.concat(sign, F.lit("inf")))
            .when(a >= 2.0 ** 63, F.format_string(f"%.{decimals}f", c)).otherwise(text))
