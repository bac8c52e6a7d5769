"""JSON as records or as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _nulls(df: DataFrame, nulls: tuple[str, ...]) -> DataFrame:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(list(nulls)), F.col(f"`{c}`")) for c in texts}) if nulls else df


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a whole object, so that the files hold an object a line."""
    line = F.trim(F.translate("value", "\t\r", "  "))
    found = spark.read.text(path).select(F.substring(line, 1, 1).alias("begin"), F.get_json_object(line, "$").isNotNull().alias("whole")).where("begin <> ''").first()
    return found is not None and found.begin == "{" and found.whole


def read_json(spark: SparkSession, path: str, orient: str = "records", nulls: tuple[str, ...] = ()) -> DataFrame:
    """records: an array of objects, or an object a line; keys are put together, missing ones null.
    columns: one object of arrays, shorter ones filled with null."""
    if orient == "records":
        return _nulls(spark.read.option("multiLine", not _by_lines(spark, path)).option("primitivesAsString", False).json(path), nulls)
    if orient != "columns":
        raise ValueError(f"orient is records or columns, not {orient}")
    return _nulls(_turned(spark.read.option("multiLine", True).json(path)), nulls)


def read_json_text(spark: SparkSession, text: str, orient: str = "records") -> DataFrame:
    df = spark.read.json(spark.sparkContext.parallelize([text], 1))
    return df if orient == "records" else _turned(df)


def _turned(df: DataFrame) -> DataFrame:
    names = df.columns
    return df.select(F.explode(F.arrays_zip(*(F.col(f"`{c}`") for c in names))).alias("r")).select(*(F.col(f"r.`{c}`").alias(c) for c in names))


def to_json(df: DataFrame, orient: str = "records", by: str | None = None) -> DataFrame:
    """records: a row `json` for each row. columns: one row, the values of each column in order of `by`."""
    if orient == "records":
        return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    if orient != "columns" or by is None:
        raise ValueError("orient is records or columns, and columns needs an order key")
    rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("_k"), F.struct("*").alias("_r"))))
    whole = df.agg(rows.alias("rows"))  # one document holds the whole frame
    return whole.select(F.to_json(F.struct(*(F.col("rows").getField("_r").getField(c).alias(c) for c in df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """An object a line, in a folder of files; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_columns(df: DataFrame, path: str, by: str, mode: str = "error") -> None:
    to_json(df, "columns", by).write.mode(mode).text(path)
