"""Rating and score arithmetic whose results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities are kept to 12 decimals, term weights to 8; ratings are compared in units of 1e-4.
SIM_DIGITS = 12
WEIGHT_DIGITS = 8
RATING_DIGITS = 4


def clip(col: Column, low: float, high: float) -> Column:
    """Clip into ``[low, high]``; NULL stays NULL and NaN becomes NULL."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), col))
    return F.when(col.isNotNull() & ~F.isnan(col), bounded)


def quantize(col: Column, digits: int) -> Column:
    """Round half up to ``digits`` decimals with plain double arithmetic.

    ``F.round`` on doubles builds a BigDecimal per value; this form stays in codegen.
    """
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def scaled(col: Column, digits: int) -> Column:
    """Fixed-point bigint of a double, so that a sum is exact in any order."""
    return F.floor(col * F.lit(float(10**digits)) + F.lit(0.5)).cast("bigint")


def unscaled(col: Column, digits: int) -> Column:
    """The double behind a fixed-point bigint."""
    return col.cast("double") / F.lit(float(10**digits))


def exact_sum(col: Column) -> Column:
    """Sum of doubles to 18 decimals that is the same in any order: two sums of bigints, the upper and lower nine."""
    unit = F.lit(1e9)
    high = F.floor(col * unit).cast("bigint")
    low = F.floor((col * unit - high.cast("double")) * unit + F.lit(0.5)).cast("bigint")
    return (F.sum(high).cast("double") + F.sum(low).cast("double") / unit) / unit
