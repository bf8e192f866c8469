"""Exact, order-independent arithmetic: sums stay integer or decimal, one division at the end."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE = "decimal(9,2)"
_WIDE = "decimal(19,0)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL when the denominator is 0 or NULL (never an ANSI error)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def mean(value: Column) -> Column:
    """Average of an exact column as sum / count, so the result does not depend on row order."""
    return ratio(F.sum(value), F.count(value))


def as_units(value: Column, per_unit: int) -> Column:
    """A score as a whole number of 1/per_unit points."""
    return F.round(value * per_unit).cast("bigint")


def pop_stddev(units: Column, per_unit: int) -> Column:
    """Population standard deviation of whole-number units, from exact sums."""
    n = F.count(units).cast(_WIDE)
    s = F.sum(units).cast(_WIDE)
    ss = F.sum(units * units).cast(_WIDE)
    spread = F.sqrt((n * ss - s * s).cast("double"))
    return ratio(ratio(spread, F.count(units)), F.lit(per_unit))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of whole-number units; NULL below 3 pairs or when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x).cast(_WIDE)
    sx, sy = F.sum(x).cast(_WIDE), F.sum(y).cast(_WIDE)
    sxy = F.sum(x * y).cast(_WIDE)
    sxx, syy = F.sum(x * x).cast(_WIDE), F.sum(y * y).cast(_WIDE)
    top = (n * sxy - sx * sy).cast("double")
    bottom = F.sqrt((n * sxx - sx * sx).cast("double")) * F.sqrt((n * syy - sy * sy).cast("double"))
    return F.when(F.count(x) >= 3, F.try_divide(top, bottom))


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(value, high))
