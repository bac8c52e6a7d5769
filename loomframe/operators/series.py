"""One column as a series: maps, folds, null handling, whole-column statistics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import need


class EmptySeries(ValueError):
    """A statistic that needs more valid values than there are."""


def series_at(df: DataFrame, name: str, kind: T.DataType | None = None) -> DataFrame:
    """The column alone; raises where it is of another type."""
    need(df, name)
    if kind is not None and df.schema[name].dataType != kind:
        raise TypeError(f"{name} is {df.schema[name].dataType.simpleString()}, not {kind.simpleString()}")
    return df.select(name)


def map_valid(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn over valid values; null stays null."""
    return F.when(c.isNotNull(), fn(c))


def map_or_error(df: DataFrame, name: str, fn: Callable[[Any], Any], kind: str, out: str, error: str) -> DataFrame:
    """A Python function that may raise: its value, or null and the error's text beside it."""
    schema = f"value {kind}, error string"

    @F.udf(schema)
    def one(x):
        if x is None:
            return None, None
        try:
            return fn(x), None
        except Exception as e:  # the caller's function decides what is an error
            return None, str(e)

    return df.withColumn("__r", one(F.col(name))).withColumns({out: F.col("__r.value"), error: F.col("__r.error")}).drop("__r")


def filter_valid(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Rows whose value is valid and passes."""
    return df.where(F.col(name).isNotNull() & condition)


def fold(df: DataFrame, name: str, by: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """A left fold over valid values in order. The values meet in one array, so use an aggregate for large columns."""
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(F.col(by).alias("k"), F.col(name).alias("v"))))), lambda s: s["v"])
    return df.agg(F.aggregate(values, start, step).alias(name))


def set_at(df: DataFrame, name: str, position: str, i: int, value: Any) -> DataFrame:
    return df.withColumn(name, F.when(F.col(position) == i, F.lit(value)).otherwise(F.col(name)))


def append(a: DataFrame, b: DataFrame, name: str, position: str) -> DataFrame:
    """b's rows after a's, under a's column name; positions go on."""
    n = a.agg((F.coalesce(F.max(position), F.lit(-1)) + 1).alias("__n"))
    return a.select(position, name).unionByName(b.crossJoin(F.broadcast(n)).select((F.col(position) + F.col("__n")).alias(position), F.col(b.columns[-1] if name not in b.columns else name).alias(name)))


def statistics(name: str) -> dict[str, Column]:
    """Expressions of all whole-column statistics over valid values."""
    c = F.col(name)
    places = [0.25, 0.5, 0.75]
    q = lambda p: F.percentile(c, places)[places.index(p)]  # noqa: E731  exact, linear between neighbours; one table of values for all
    return {
        "count": F.count(c), "nulls": F.count_if(c.isNull()), "mean": F.avg(c), "median": q(0.5), "std": F.stddev_samp(c),
        "var": F.var_samp(c), "min": F.min(c), "max": F.max(c), "q25": q(0.25), "q75": q(0.75),
    }


def describe(df: DataFrame, name: str) -> DataFrame:
    """One row of statistics, null where undefined."""
    return df.agg(*(c.alias(k) for k, c in statistics(name).items()))


def arg_min(name: str, position: str) -> Column:
    """The position of the first minimum."""
    return F.min_by(position, F.when(F.col(name).isNotNull(), F.struct(name, position)))


def arg_max(name: str, position: str) -> Column:
    return F.max_by(position, F.when(F.col(name).isNotNull(), F.struct(F.col(name), -F.col(position))))


def quantile(name: str, q: float, approximate: int | None = None) -> Column:
    """Exact; approximate takes the sketch's accuracy and is for columns too long to sort a group of."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile is in [0, 1]")
    return F.percentile(F.col(name), q) if approximate is None else F.percentile_approx(name, q, approximate)


def value_of(df: DataFrame, expression: Column, least: int, name: str) -> Any:
    """A statistic as a Python value; raises with fewer than `least` valid values."""
    r = df.agg(expression.alias("v"), F.count(name).alias("n")).first()
    if r.n < least:
        raise EmptySeries(f"{name} has {r.n} valid values; {least} are needed")
    return r.v


def total(df: DataFrame, name: str) -> Any:
    return value_of(df, F.sum(name), 1, name)


def mean(df: DataFrame, name: str) -> float:
    return value_of(df, F.avg(name), 1, name)


def median(df: DataFrame, name: str) -> float:
    return value_of(df, quantile(name, 0.5), 1, name)


def variance(df: DataFrame, name: str) -> float:
    return value_of(df, F.var_samp(name), 2, name)


def deviation(df: DataFrame, name: str) -> float:
    return value_of(df, F.stddev_samp(name), 2, name)


def minimum(df: DataFrame, name: str) -> Any:
    return value_of(df, F.min(name), 1, name)


def maximum(df: DataFrame, name: str) -> Any:
    return value_of(df, F.max(name), 1, name)
