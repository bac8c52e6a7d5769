"""Descriptive statistics over double columns: 0 where there are too few values, bias-corrected moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def mean(c: Column) -> Column:
    return _or_zero(F.avg(c))


def median(c: Column) -> Column:
    return _or_zero(F.percentile(c, 0.5))


def variance(c: Column) -> Column:
    return _or_zero(F.var_samp(c))


def std(c: Column) -> Column:
    return _or_zero(F.stddev_samp(c))


def skewness(c: Column) -> Column:
    """Adjusted Fisher-Pearson; 0 for fewer than three values or without spread."""
    n = F.count(c).cast("double")
    return F.when(n < 3, 0.0).otherwise(_or_zero(F.skewness(c) * F.sqrt(F.greatest(n * (n - 1), F.lit(0.0))) / F.nullif(n - 2, F.lit(0.0))))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess; 0 for fewer than four values or without spread."""
    n = F.count(c).cast("double")
    return F.when(n < 4, 0.0).otherwise(_or_zero((n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6)))


def covariance(x: Column, y: Column) -> Column:
    return _or_zero(F.covar_samp(x, y))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; null without spread, where a constant column would make corr() raise."""
    paired = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(F.when(paired, x)) * F.stddev_samp(F.when(paired, y)))


def quantile(c: Column, q: float) -> Column:
    return _or_zero(F.percentile(c, q)) if 0 <= q <= 1 else F.lit(0.0)


def iqr(c: Column) -> Column:
    both = F.percentile(c, [0.25, 0.75])  # one table of values for both
    return _or_zero(both[1]) - _or_zero(both[0])


def modes(df: DataFrame, name: str) -> DataFrame:
    """All values that occur most often. One count comes back to the rows, not the rows together."""
    counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(most), "n").select(name).orderBy(name)
