"""Column expressions that keep unknown values null instead of NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def pearson(y: Column | str, x: Column | str) -> Column:
    """Correlation of pairs without nulls; null for a constant side (built-in corr raises there)."""
    both = col(y).isNotNull() & col(x).isNotNull()
    a, b = F.when(both, col(y).cast("double")), F.when(both, col(x).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    return clip(r, -1.0, 1.0)


def slope(y: Column | str, x: Column | str, least: int = 2) -> Column:
    """OLS slope of y on x, null with fewer than ``least`` pairs or a constant x."""
    n = F.regr_count(col(y), col(x))
    return F.when(n >= least, F.regr_slope(col(y).cast("double"), col(x).cast("double")))


def quantile(c: Column | str, p: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(col(c), F.lit(p))


def clip(c: Column, lo: float, hi: float) -> Column:
    """The value within bounds; null stays null (greatest and least skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def at_most(c: Column, hi: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(hi), c))


