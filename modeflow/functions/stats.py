"""Statistics as aggregate expressions: plain groupBy().agg() columns that stay inside Spark's code generation.

Inputs are doubles with null for missing values (NaN is converted at the boundary, see `clean`). All spreads are population
spreads, all percentiles exact and linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN as null, so that comparisons and means treat both as missing."""
    return F.when(F.isnan(x), None).otherwise(x)


def pct(x: Column | str, p: float) -> Column:
    return F.percentile(x, F.lit(p))


def iqr(x: Column | str) -> Column:
    return pct(x, 0.75) - pct(x, 0.25)


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def zero_if_flat(value: Column, x: Column | str, least: float = 1e-10) -> Column:
    """The value, or 0 where the population spread of x is below `least`."""
    return F.when(F.stddev_pop(x) < least, F.lit(0.0)).otherwise(value)


def skew(x: Column | str) -> Column:
    return zero_if_flat(F.skewness(x), x)


def excess_kurtosis(x: Column | str) -> Column:
    return zero_if_flat(F.kurtosis(x), x)


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums, 0 where either side is constant (Spark's corr fails on a constant column under ANSI)."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    cov = F.covar_pop(x, y) * n
    norm = F.stddev_pop(x) * F.stddev_pop(y) * n
    return F.when(norm < 1e-10, F.lit(0.0)).otherwise(F.try_divide(cov, norm))


def zero_crossings(x: Column, previous: Column) -> Column:
    """Share of rows whose sign differs from that of the row before, over all rows."""
    return F.count_if(F.signum(x) != F.signum(previous)) / F.count(x)


def slope(y: Column, position: Column, n: Column) -> Column:
    """Least-squares slope of y over positions 1..n mapped to 0..1."""
    return F.regr_slope(y, (position - 1) / F.greatest(n - 1, F.lit(1)))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
