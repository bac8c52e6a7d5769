"""Column casts that raise at the first value they cannot take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The texts that are booleans.
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")


def _refuse(c: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot cast to {what}: "), c.cast("string")))


def cast(c: Column, source: T.DataType, target: str) -> Column:
    """target: int64, float64, bool, string, time or any; null stays null."""
    text, number = isinstance(source, T.StringType), isinstance(source, T.NumericType)
    stamp = isinstance(source, (T.TimestampType, T.TimestampNTZType))
    if target in ("string", "any"):
        return c.cast("string")
    if target == "int64":
        if stamp:
            raise TypeError("a time cannot become int64")
        if text:
            return F.when(c.rlike(r"^[+-]?\d+$"), c.cast("bigint")).when(c.isNotNull(), _refuse(c, target).cast("bigint"))
        return c.cast("bigint")
    if target == "float64":
        if stamp:
            raise TypeError("a time cannot become float64")
        if text:
            plain = c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | c.rlike(r"(?i)^[+-]?(inf|infinity)$") | c.rlike(r"(?i)^nan$")
            return F.when(plain, c.cast("double")).when(c.isNotNull(), _refuse(c, target).cast("double"))
        return c.cast("double")
    if target == "bool":
        if text:
            return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False).when(c.isNotNull(), _refuse(c, target).cast("boolean"))
        return c != 0 if number else c.cast("boolean")
    if target == "time":
        if number:
            return F.timestamp_seconds(c.cast("bigint"))
        if text:
            day = F.when(c.rlike(r"^\d{4}-\d\d-\d\d$"), F.to_timestamp(c, "yyyy-MM-dd"))
            full = F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), c.cast("timestamp"))
            return F.coalesce(day, full, F.when(c.isNotNull(), _refuse(c, target).cast("timestamp")))
        return c.cast("timestamp")
    raise ValueError(f"no dtype {target}")


def dtype_name(kind: T.DataType) -> str:
    """int64, float64, bool, string, time or any."""
    if isinstance(kind, T.IntegralType):
        return "int64"
    for types, name in (((T.FloatType, T.DoubleType), "float64"), ((T.BooleanType,), "bool"), ((T.StringType,), "string"), ((T.TimestampType, T.TimestampNTZType), "time")):
        if isinstance(kind, types):
            return name
    return "any"


def plain_text(c: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")
