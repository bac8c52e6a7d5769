"""Grouped aggregation, group sizes, grouped apply and transform."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .frame import need

FUNCTIONS = ("sum", "mean", "min", "max", "count", "std", "first", "last")


def number_of(df: DataFrame, name: str) -> Column:
    """What sum, mean and std take from a column: numbers, or texts that are numbers; nothing from others."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.NumericType):
        return c
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"), c.try_cast("double")) if isinstance(kind, T.StringType) else F.lit(None).cast("double")


def aggregate(df: DataFrame, name: str, fn: str, by: str | None = None) -> Column:
    """One of FUNCTIONS over the valid values of a column; first and last follow the order key `by`."""
    c = F.col(name)
    if fn == "count":
        return F.count(c)
    if fn in ("min", "max"):
        return F.min(c) if fn == "min" else F.max(c)
    if fn in ("first", "last"):
        if by is None:
            raise ValueError(f"{fn} needs an order key")
        at = F.when(c.isNotNull(), F.col(by))
        return F.min_by(c, at) if fn == "first" else F.max_by(c, at)
    x = number_of(df, name)
    if fn == "sum":
        return F.sum(x)
    if fn == "mean":
        return F.avg(x)
    if fn == "std":
        return F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x))
    raise ValueError(f"no aggregate {fn}; there are {', '.join(FUNCTIONS)}")


def group(df: DataFrame, keys: list[str], spec: dict[str, str], by: str | None = None, names: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """One aggregate a column, under the column's name or names[column]; null keys are a group; sorted by key."""
    need(df, *keys, *spec)
    if not keys or set(keys) & set(spec):
        raise ValueError("grouping needs keys, and they cannot be aggregated")
    out = df.groupBy(*keys).agg(*(aggregate(df, c, spec[c], by).alias((names or {}).get(c, c)) for c in sorted(spec)))
    return out.orderBy(*(F.asc_nulls_first(k) for k in keys)) if ordered else out


def size(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of each group, nulls counted, as `size`."""
    need(df, *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("size")).orderBy(*(F.asc_nulls_first(k) for k in keys))


#: Types whose values in pandas are the same whatever rows stand beside them; of whole numbers and truths only where none is null.
_PLAIN = {T.ByteType(): "int8", T.ShortType(): "int16", T.IntegerType(): "int32", T.LongType(): "int64", T.FloatType(): "float32", T.DoubleType(): "float64", T.BooleanType(): "bool", T.StringType(): "string"}
#: Types that pass through Arrow as they are.
_CARRIED = {*_PLAIN, T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.BinaryType()}


def _carries(df: DataFrame) -> bool:
    return len({c.lower() for c in df.columns}) == len(df.columns) and all(f.dataType in _CARRIED or isinstance(f.dataType, T.DecimalType) for f in df.schema)


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each group one after the other, and as the last column whether a row is its group's first."""
    first = "__first"
    while first in {c.lower() for c in df.columns}:
        first += "_"
    return df.withColumn(first, F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) == 1)


def _whole_groups(batches):
    """Arrow tables of marked rows that hold groups as wholes, each with the ends of its groups.

    The last group of a batch may go on in the next one and is held back until it is whole.
    """
    import numpy as np
    import pyarrow as pa

    def told(parts):
        table = pa.Table.from_batches(parts)
        starts = np.flatnonzero(table.column(table.num_columns - 1).to_numpy())
        return table.select(range(table.num_columns - 1)), list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True))

    held = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
        if not len(starts):
            held.append(batch)
            continue
        last = int(starts[-1])
        if held or last:
            yield told([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if sum(b.num_rows for b in held):
        yield told(held)


def _by_group(column, kind: T.DataType):
    """A function that gives a column's values from row a to row b as pandas has them for these rows alone."""
    if column.null_count and kind not in (T.FloatType(), T.DoubleType(), T.StringType()):
        return lambda a, b: column.slice(a, b - a).to_pandas().to_numpy(copy=True)
    values = column.to_pandas().to_numpy()
    return lambda a, b: values[a:b].copy()


def _gathered(parts: list, kind: T.DataType, safe: bool):
    """The parts of a column, pandas series, as one Arrow array."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    to = getattr(pa, {"bool": "bool_"}.get(_PLAIN[kind], _PLAIN[kind]))()

    def array(x):
        mask = None if hasattr(x.array, "__arrow_array__") else x.isnull()
        try:
            return pa.Array.from_pandas(x, mask=mask, type=to, safe=safe)
        except pa.ArrowInvalid:
            return pa.Array.from_pandas(x, mask=mask).cast(to, safe=safe)

    if len({p.dtype for p in parts}) == 1 and isinstance(parts[0].dtype, np.dtype):
        try:
            return array(pd.Series(np.concatenate([p.to_numpy() for p in parts])))
        except (pa.ArrowException, TypeError):  # values of several kinds: each part by itself
            pass
    return pa.concat_arrays([array(p) for p in parts])


def _safely(df: DataFrame) -> bool:
    return str(df.sparkSession.conf.get("spark.sql.execution.pandas.convertToArrowArraySafely", "false")).lower() == "true"


def group_apply(df: DataFrame, keys: list[str], fn: Callable, schema: str) -> DataFrame:
    """fn(pandas frame of a group) -> pandas frame. A group is handled in one task's memory.

    Groups come to Python many at a time where all columns are numbers, truths or texts: a batch
    for each, as applyInPandas sends them, costs more than the work on a small group.
    """
    ship(df.sparkSession)
    given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    alone = len(inspect.getfullargspec(fn).args) == 1  # applyInPandas gives a second argument the key
    if not (keys and alone and _carries(df) and all(f.dataType in _PLAIN for f in [*df.schema, *given])):
        return df.groupBy(*keys).applyInPandas(fn, schema)
    columns, kinds = df.columns, [f.dataType for f in df.schema]
    names, out, safe = given.names, [f.dataType for f in given], _safely(df)

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        for table, ends in _whole_groups(batches):
            take = [_by_group(c, kind) for c, kind in zip(table.columns, kinds, strict=True)]
            found = []
            for a, b in ends:
                got = fn(pd.DataFrame({c: t(a, b) for c, t in zip(columns, take, strict=True)}, index=pd.RangeIndex(b - a), copy=False))
                if not isinstance(got, pd.DataFrame):
                    raise TypeError(f"a pandas frame is needed, not {type(got).__name__}")
                if len(got.columns) == 0 and got.empty:
                    continue
                named = any(isinstance(c, str) for c in got.columns)
                if len(got.columns) != len(names) or named and set(got.columns) != set(names):
                    raise ValueError(f"columns {list(got.columns)} instead of {names}")
                if len(got):
                    found.append([got[c] for c in names] if named else [got.iloc[:, i] for i in range(len(names))])
            if found:
                yield pa.RecordBatch.from_arrays([_gathered(list(p), kind, safe) for p, kind in zip(zip(*found, strict=True), out, strict=True)], names=names)

    return _marked(df, keys).mapInArrow(run, given)


def group_transform(df: DataFrame, keys: list[str], name: str, fn: Callable[[Column], Column], out: str | None = None) -> DataFrame:
    """An aggregate of each group beside every row, the rows as they were."""
    return df.withColumn(out or f"transform_{name}", fn(F.col(name)).over(Window.partitionBy(*keys)))


def group_transform_rows(df: DataFrame, keys: list[str], name: str, fn: Callable, kind: str, out: str | None = None) -> DataFrame:
    """fn(pandas series of a group) -> as many values; it sees a group in one task's memory. Batches are as in group_apply."""
    out = out or f"transform_{name}"
    to = T._parse_datatype_string(kind)
    schema = T.StructType([*df.schema.fields, T.StructField(out, to)])
    ship(df.sparkSession)

    def checked(got, n):
        if len(got) != n:
            raise ValueError(f"{len(got)} values for {n} rows")
        return got

    def run(pdf):
        return pdf.assign(**{out: list(checked(fn(pdf[name]), len(pdf)))})

    if not (keys and _carries(df) and to in _PLAIN and name in df.columns and df.schema[name].dataType in _PLAIN and out.lower() not in {c.lower() for c in df.columns}):
        return df.groupBy(*keys).applyInPandas(run, schema)
    at, came, safe = df.columns.index(name), df.schema[name].dataType, _safely(df)

    def many(batches):
        import pandas as pd

        for table, ends in _whole_groups(batches):
            take = _by_group(table.column(at), came)
            found = []
            for a, b in ends:
                got = checked(fn(pd.Series(take(a, b), name=name, copy=False)), b - a)
                found.append(got if isinstance(got, pd.Series) and got.dtype in ("int64", "float64", "bool") else pd.Series(list(got)))
            yield from table.append_column(out, _gathered(found, to, safe)).combine_chunks().to_batches()

    return _marked(df, keys).mapInArrow(many, schema)
