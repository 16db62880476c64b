"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keeps the range of a constant dimension above zero.
RANGE_EPSILON = 1e-8


def clamp(x: Column, lower: Column, upper: Column) -> Column:
    """``x`` limited to [lower, upper]; NULL and NaN stay (greatest/least alone would lose both)."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, lower), upper))


def normalize_value(x: Column, lower: Column, upper: Column) -> Column:
    return F.lit(2.0) * (clamp(x, lower, upper) - lower) / (upper - lower + F.lit(RANGE_EPSILON)) - F.lit(1.0)


def unnormalize_value(y: Column, lower: Column, upper: Column) -> Column:
    return (y + F.lit(1.0)) * F.lit(0.5) * (upper - lower + F.lit(RANGE_EPSILON)) + lower


def format_fixed4(x: Column) -> Column:
    """Text of ``x`` with four decimals and a sign slot, rounded as C and Python do.

    Java rounds half up and starts from the shortest decimal form, so 0.03125 would become
    0.0313. Here x * 10000 is rounded to even, and where it looks like a tie the part of
    the product that a double cannot hold (found by splitting x in two halves) decides.
    """
    scaled = x * F.lit(1e4)
    nearest = F.rint(scaled)
    carry = F.lit(134217729.0) * x  # 2**27 + 1
    head = carry - (carry - x)
    residue = (head * F.lit(1e4) - scaled) + (x - head) * F.lit(1e4)
    tie = F.abs(scaled - nearest) == F.lit(0.5)
    away = F.floor(scaled) + F.when(residue > 0, F.lit(1)).otherwise(F.lit(0))
    rounded = F.when(tie & (residue != 0), away.cast("double")).otherwise(nearest)
    signed = F.when((rounded == 0) & (x < 0), F.lit(-0.0)).otherwise(rounded)
    exact = F.abs(scaled) < F.lit(2.0 ** 52)
    text = F.format_string("% .4f", F.when(exact, signed / F.lit(1e4)).otherwise(x))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit(" nan"))
        .when(F.abs(x) == F.lit(float("inf")), F.when(x > 0, F.lit(" inf")).otherwise(F.lit("-inf")))
        .otherwise(text)
    )
