"""CSV: typed by what all values allow; read at once, in chunks or as a stream; written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import FALSE, TRUE

#: Fixed value: the texts that are null unless others are named.
NULLS = ("", "NA", "NaN", "null")


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    header: bool = True
    nulls: tuple[str, ...] = NULLS
    infer: bool = True
    keep_nan: bool = False
    skip_rows: int = 0
    max_rows: int | None = None
    columns: tuple[str, ...] | None = field(default=None)


def _clean(c: Column, o: CsvOptions) -> Column:
    nulls = [t for t in o.nulls if not (o.keep_nan and t.lower() == "nan")]
    return F.when(~c.isin(nulls), c) if nulls else c


def _is_int(c: Column) -> Column:
    return F.when(c.isNotNull(), c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull())


def _is_float(c: Column) -> Column:
    return c.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$")


def _cast_float(c: Column) -> Column:
    return F.when(c.rlike(r"(?i)^[+-]?inf(inity)?$"), F.when(c.startswith("-"), float("-inf")).otherwise(float("inf"))).when(c.rlike(r"(?i)^[+-]?nan$"), float("nan")).otherwise(c.try_cast("double"))


def infer(df: DataFrame) -> DataFrame:
    """Text columns as int64, else float64, else bool, else text, by all their values, in one pass; all-null ones as int64."""
    if not df.columns:
        return df
    tests = {"int": _is_int, "float": _is_float, "bool": lambda c: c.isin(*TRUE, *FALSE)}
    seen = df.agg(*(F.coalesce(F.bool_and(t(F.col(f"`{c}`"))), F.lit(True)).alias(f"{k}_{i}") for i, c in enumerate(df.columns) for k, t in tests.items())).first()
    out = []
    for i, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        kind = next((k for k in tests if seen[f"{k}_{i}"]), "text")
        made = {"int": lambda c: c.cast("bigint"), "float": _cast_float, "bool": lambda c: F.when(c.isNotNull(), c.isin(*TRUE)), "text": lambda c: c}[kind](c)
        out.append(made.alias(name))
    return df.select(*out)


def _raw(spark: SparkSession, path: str, o: CsvOptions) -> DataFrame:
    """All columns as text, in the order of the file."""
    read = spark.read.option("sep", o.delimiter).option("nullValue", "\u0000").option("emptyValue", "").option("mode", "FAILFAST")
    if o.skip_rows:
        lines = spark.read.text(path).rdd.zipWithIndex().filter(lambda x: x[1] >= o.skip_rows).map(lambda x: x[0][0])
        source = lines
    else:
        source = path
    df = read.option("header", o.header).option("inferSchema", False).csv(source)
    return df if o.header else df.toDF(*(f"col_{i}" for i in range(len(df.columns))))


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """Columns in alphabetical order; columns= picks those that exist."""
    o = options or CsvOptions()
    df = _raw(spark, path, o)
    if o.max_rows is not None:
        df = df.limit(o.max_rows)
    names = [c for c in df.columns if o.columns is None or c in o.columns]
    df = df.select(*(_clean(F.coalesce(F.col(f"`{c}`"), F.lit("")), o).alias(c) for c in sorted(names)))
    return infer(df) if o.infer else df


def read_csv_chunks(spark: SparkSession, path: str, rows: int, options: CsvOptions | None = None) -> Iterator[pd.DataFrame]:
    """pandas frames of `rows` rows; the driver holds a partition at a time. rows <= 0 gives one frame."""
    df = read_csv(spark, path, options)
    if rows <= 0:
        yield df.toPandas()
        return
    held: list = []
    for r in df.toLocalIterator():
        held.append(r)
        if len(held) == rows:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def stream_csv(spark: SparkSession, folder: str, schema: T.StructType | str, files_a_trigger: int = 1, options: CsvOptions | None = None) -> DataFrame:
    """Files as they come, for unbounded input."""
    o = options or CsvOptions()
    return spark.readStream.schema(schema).option("sep", o.delimiter).option("header", o.header).option("maxFilesPerTrigger", files_a_trigger).csv(folder)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, null: str = "", one_file: bool = False, mode: str = "error") -> None:
    """A folder of files, or one file where it is asked for and the frame is small."""
    out = df.coalesce(1) if one_file else df
    out.write.mode(mode).option("sep", delimiter).option("header", header).option("nullValue", null).option("emptyValue", "").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
