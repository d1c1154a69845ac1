"""Column helpers that keep ANSI Spark quiet on missing or degenerate numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null where den is 0 or either side is missing."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def finite(c: str | Column) -> Column:
    """NaN and +-inf become null, so comparisons behave as 'unknown'."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def is_true(cond: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """0/1 integer of a condition, 0 when unknown."""
    return is_true(cond).cast("int")


def both(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """x and y with null wherever the other one is missing (pairwise complete)."""
    x, y = col(x).cast("double"), col(y).cast("double")
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson r as a grouped aggregate; null for a constant side or fewer than two pairs."""
    x, y = both(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), spread))


def all_present(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c), digits)
