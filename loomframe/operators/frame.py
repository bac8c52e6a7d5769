"""Projection, inspection, filters and column transforms of frames."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import dtype_name
from ..plans.predicates import Predicate


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def from_columns(spark: SparkSession, columns: dict[str, list], position: str | None = None) -> DataFrame:
    """A frame from equally long lists, columns by name; position names a column of row numbers."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError("columns differ in length")
    if "" in columns:
        raise ValueError("a column needs a name")
    names = sorted(columns)
    fields = [T.StructField(n, type_of(columns[n])) for n in names]
    rows = list(zip(*(_coerced(columns[n], f.dataType) for n, f in zip(names, fields, strict=True)), strict=True))
    if position is not None:
        rows, fields = [(i, *r) for i, r in enumerate(rows)], [T.StructField(position, T.LongType(), False), *fields]
    return spark.createDataFrame(rows, T.StructType(fields))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def type_of(values: list) -> T.DataType:
    """The column type of Python values: the widest of those that occur; int and float give double."""
    import datetime

    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.NullType()
    for accepted, result in (({bool}, T.BooleanType()), ({int}, T.LongType()), ({int, float}, T.DoubleType()), ({str}, T.StringType()), ({datetime.datetime}, T.TimestampType())):
        if kinds <= accepted:
            return result
    raise TypeError(f"a column cannot mix {', '.join(sorted(k.__name__ for k in kinds))}")


def _coerced(values: list, kind: T.DataType) -> list:
    return [float(v) if v is not None else None for v in values] if isinstance(kind, T.DoubleType) else values


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def dtypes(df: DataFrame) -> dict[str, str]:
    """int64, float64, bool, string, time or any, by column."""
    return {f.name: dtype_name(f.dataType) for f in df.schema}


def preview(df: DataFrame, by: str | None = None, n: int = 10) -> str:
    """The first rows as text, cells apart by tabs, null as <null>."""
    rows = (df.orderBy(by) if by else df).limit(n).collect()
    lines = [df.columns, *([("<null>" if v is None else str(v)) for v in r] for r in rows)]
    return "\n".join("\t".join(x) for x in lines)


def info(df: DataFrame) -> DataFrame:
    """column, dtype, rows and nulls of every column, in one pass."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("rows"), F.array(*(F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns)).alias("nulls"))
    named = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype")) for c in df.columns))
    return one.select("rows", F.explode(F.arrays_zip(named.alias("c"), F.col("nulls").alias("n"))).alias("x")).select("x.c.column", "x.c.dtype", "rows", F.col("x.n").alias("nulls"))


def select(df: DataFrame, *names: str) -> DataFrame:
    need(df, *names)
    if len(set(names)) < len(names):
        raise ValueError("a column is selected twice")
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    need(df, old)
    if new != old and new in df.columns:
        raise ValueError(f"there is a column {new} already")
    return df.withColumnRenamed(old, new)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df.withColumn(name, value)


def add_values(df: DataFrame, name: str, values: DataFrame, on: str) -> DataFrame:
    """A column from values(on, name), matched by the row id `on`."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    return df.join(values.select(on, name), on, "left")


def assign(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column, or replace it where it stands."""
    return df.withColumn(name, value)


def apply(df: DataFrame, name: str, fn: Callable[[Column], Column]) -> DataFrame:
    """The column put through fn, which sees nulls."""
    need(df, name)
    return df.withColumn(name, fn(F.col(name)))


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    for k, step in enumerate(steps):
        if step is not None:
            try:
                df = step(df)
            except Exception as e:
                e.add_note(f"in step {k} of the pipe")
                raise
    return df


def where(df: DataFrame, predicate: Predicate | Column, null_policy: str = "low") -> DataFrame:
    return df.filter(predicate.to_column(null_policy) if isinstance(predicate, Predicate) else predicate)


def where_mask(df: DataFrame, mask: DataFrame, on: str, flag: str) -> DataFrame:
    """Rows whose flag is true in mask(on, flag); a null or missing flag drops the row."""
    return df.join(mask.where(F.col(flag)).select(on), on, "left_semi")


def drop_null_rows(df: DataFrame, *names: str) -> DataFrame:
    """Rows without null in the named columns, or in any; NaN is no null."""
    need(df, *names)
    for n in names or df.columns:
        df = df.where(F.col(f"`{n}`").isNotNull())
    return df


def fill_null(df: DataFrame, name: str, value: Any) -> DataFrame:
    need(df, name)
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))


def mask(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Null where the condition is true; a null condition keeps the value."""
    need(df, name)
    return df.withColumn(name, F.when(condition, None).otherwise(F.col(name)))


def concat(*frames: DataFrame | None) -> DataFrame:
    """All rows by column name; missing columns become null; columns in alphabetical order."""
    some = [f for f in frames if f is not None]
    if not some:
        raise ValueError("nothing to concatenate")
    kinds: dict[str, T.DataType] = {}
    for f in some:
        for x in f.schema:
            if x.name in kinds and (isinstance(kinds[x.name], T.StringType) != isinstance(x.dataType, T.StringType)) and T.NullType() not in (kinds[x.name], x.dataType):
                raise TypeError(f"column {x.name} is text in one frame and not in another")
            kinds.setdefault(x.name, x.dataType)
    out = some[0]
    for f in some[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))
