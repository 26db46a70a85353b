"""Numeric Column builders: rates, clamps, fixed-scale rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """Round half up to a fixed scale with plain IEEE steps.

    Ranks compare values for equality, so every value that reaches a ranking
    goes through this first and ties never depend on summation order.
    """
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def whole_units(value: Column, places: int) -> Column:
    """A measure as whole units of its last place, for sums in any order."""
    return F.floor(value * F.lit(float(10**places)) + F.lit(0.5)).cast("long")


def cents(value: Column) -> Column:
    """Money as whole cents, so sums are exact and order free."""
    return F.round(value * 100).cast("long")


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """Ratio of sums; null instead of a division by zero."""
    d = den.cast("double")
    return F.when(d != 0, num.cast("double") * F.lit(float(scale)) / d)


def strength(value: Column, unit: float) -> Column:
    """Signal strength clamped to [0, 1]."""
    return F.least(F.lit(1.0), F.abs(value) / F.lit(float(unit)))


def number(text: Column) -> Column:
    """Number or null, never an error."""
    return text.try_cast("double")


def innings_to_outs(text: Column) -> Column:
    """``'6.2'`` is six innings and two outs, i.e. 20 outs."""
    parts = F.split(text, r"\.")
    whole = F.coalesce(F.get(parts, F.lit(0)).try_cast("int"), F.lit(0))
    extra = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))
    return whole * 3 + extra


def quality_start(starts: Column, outs: Column, earned: Column) -> Column:
    return ((starts >= 1) & (outs >= 18) & (earned <= 3)).cast("int")


def is_barrel(speed: Column, angle: Column) -> Column:
    """Launch window that widens with exit speed from 98 up."""
    over = speed - 98
    low = F.greatest(F.lit(8.0), 26.0 - over * 1.2)
    high = F.least(F.lit(50.0), 30.0 + over * 1.5)
    return (speed >= 98) & angle.between(low, high)


# Run weights of the simplified weighted on-base rate.
ON_BASE_WEIGHTS = {"bb": 0.69, "hbp": 0.72, "b1": 0.88, "b2": 1.26, "b3": 1.60, "hr": 2.07}


def weighted_on_base(weights: dict[str, float], volume: list[str]) -> tuple[Column, Column]:
    """Numerator and denominator of a weighted rate over component columns."""
    zero = F.lit(0)
    num = sum((F.coalesce(F.col(c), zero) * w for c, w in weights.items()), F.lit(0.0))
    den = sum((F.coalesce(F.col(c), zero) for c in volume), F.lit(0))
    return num, den


def singles(hits: Column, doubles: Column, triples: Column, homers: Column) -> Column:
    """Hits that are none of the longer ones; a log that lists fewer hits than those has none."""
    zero = F.lit(0)
    longer = F.coalesce(doubles, zero) + F.coalesce(triples, zero) + F.coalesce(homers, zero)
    return F.greatest(F.coalesce(hits, zero) - longer, zero)


def swap_impact(volume: Column, edge: Column, factor: Column, denominator: Column) -> Column:
    """Rate change from turning one slot's remaining volume into a better one."""
    return ratio(factor * volume * edge, denominator)
