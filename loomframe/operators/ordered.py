"""Operators in row order, without a window over the whole frame in one task.

Rows are dealt by ranges of the order key into buckets, whose bounds come from one
percentile pass. What a window computes inside a bucket is carried on by one row a bucket:
counts, sums or last values before it. The table of those is as long as there are buckets,
so its join is a broadcast of known size, and no task sees more than a bucket.

Rows of equal keys follow their `ties`, further columns of the order. Without them such rows
stand in any order, so running sums and fills differ among them from run to run.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frame import need

#: Rows a bucket should hold at most, about.
BUCKET_ROWS = 2_000_000
MAX_BUCKETS = 20_000
#: Texts a bucket that are drawn to set the bounds of text keys; they steer the buckets, not the results.
DRAWN = 50

_B = "__bucket"
#: Columns that the operators add while they work.
_ADDED = {_B, "__before", "__edge", "__nan", "__own", "__pos", "__home", "__block", "__value", "__times", "__m", "__s"}


def _apart(operator):
    """Columns of the frame, and of the result, that bear the operators' own names are renamed meanwhile."""

    def texts(x):
        if isinstance(x, str):
            return [x]
        return [t for y in x for t in texts(y)] if isinstance(x, (list, tuple)) else []

    def renamed(x, names):
        if isinstance(x, str):
            return names.get(x, x)
        return type(x)(renamed(y, names) for y in x) if isinstance(x, (list, tuple)) else x

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options):
        names = {c: f"{c}_{uuid.uuid4().hex}" for c in [*df.columns, *texts(args), *texts(list(options.values()))] if c.lower() in _ADDED}
        if not names:
            return operator(df, *args, **options)
        out = operator(df.withColumnsRenamed(names), *renamed(args, names), **{k: renamed(v, names) for k, v in options.items()})
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


def order_number(df: DataFrame, name: str) -> Column:
    """A number, or a text for texts, that does not fall as the key rises; equal keys have equal ones."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def bucketed(df: DataFrame, by: str, rows: int | None = None) -> DataFrame:
    """df with the bucket of each row; nulls are in the first, NaN in the last."""
    need(df, by)
    number = order_number(df, by)
    n = df.count()
    buckets = min(MAX_BUCKETS, -(-n // (rows or BUCKET_ROWS)))
    if buckets <= 1:
        return df.withColumn(_B, F.lit(0))
    if isinstance(df.schema[by].dataType, T.StringType):
        drawn = df.where(number.isNotNull()).sample(min(1.0, DRAWN * buckets / n), seed=1).select(number.alias("t")).limit(2 * DRAWN * buckets)
        texts = sorted((r.t for r in drawn.collect()), key=str.encode)
        bounds = [texts[k * len(texts) // buckets] for k in range(1, buckets)] if texts else []
        bounds = sorted(set(bounds), key=str.encode)
    else:
        bounds = df.agg(F.percentile_approx(number, [k / buckets for k in range(1, buckets)], 10 * buckets).alias("b")).first().b
        bounds = sorted(set(bounds or []))
    if not bounds:
        return df.withColumn(_B, F.when(number.isNull(), -1).otherwise(0))
    literal = F.array(*map(F.lit, bounds))
    # a search among the sorted bounds by halves, as an expression: ceil(log2) comparisons a row
    at = F.lit(0)
    step = 1 << max(0, len(bounds).bit_length() - 1)
    while step:
        probe = at + step
        at = F.when((probe <= len(bounds)) & (F.element_at(literal, F.least(probe, F.lit(len(bounds)))) <= number), probe).otherwise(at)
        step >>= 1
    return df.withColumn(_B, F.when(number.isNull(), -1).otherwise(at))


def _window(by: str, *ties: str, descending: bool = False):
    return Window.partitionBy(_B).orderBy(*((F.desc if descending else F.asc)(c) for c in (by, *ties)))


def _carried(df: DataFrame, aggregates: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """A row a bucket: the running values over the buckets before it."""
    return df.groupBy(_B).agg(*(c.alias(k) for k, c in aggregates.items())).select(_B, *(c.alias(k) for k, c in running.items()))


def _before():
    """The buckets before this one."""
    return Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)


def _after():
    """The buckets after this one, the nearest last."""
    return Window.orderBy(F.desc(_B)).rowsBetween(Window.unboundedPreceding, -1)


@_apart
def with_position(df: DataFrame, by: str, name: str = "_pos", *ties: str) -> DataFrame:
    """Row numbers from 0 in the order of `by` (then ties), without gaps."""
    b = bucketed(df, by)
    before = _carried(b, {"n": F.count("*")}, {"__before": F.coalesce(F.sum("n").over(_before()), F.lit(0))})
    return b.withColumn(name, F.row_number().over(_window(by, *ties)) - 1).join(F.broadcast(before), _B).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop(_B, "__before")


def row(df: DataFrame, i: int, by: str) -> dict:
    """The i-th row in order."""
    if i < 0:
        raise IndexError(i)
    found = df.orderBy(by).offset(i).limit(1).collect()
    if not found:
        raise IndexError(i)
    return found[0].asDict()


def head(df: DataFrame, n: int, by: str) -> DataFrame:
    return df.orderBy(F.asc(by)).limit(max(0, n))


def tail(df: DataFrame, n: int, by: str) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(max(0, n)).orderBy(F.asc(by))


def sample(df: DataFrame, n: int, seed: int, by: str) -> DataFrame:
    """n rows without replacement, the same for the same seed, in order: those with the smallest md5 of key and seed."""
    if n < 0 or n > df.count():
        raise ValueError(f"{n} rows cannot be drawn")
    return df.orderBy(F.md5(F.concat_ws("-", F.col(by).cast("string"), F.lit(str(seed)))), by).limit(n).orderBy(by)


def sort(df: DataFrame, *keys: tuple[str, bool] | tuple[str, bool, bool], stable_by: str | None = None) -> DataFrame:
    """Sort by (column, ascending[, nulls_last]); nulls first by default either way; NaN below all numbers."""
    if not keys:
        return df
    order = [x for k in keys for x in sort_order(df, *k)]
    return df.orderBy(*order, *([F.asc(stable_by)] if stable_by else []))


def sort_order(df: DataFrame, name: str, ascending: bool = False, nulls_last: bool = False) -> list[Column]:
    need(df, name)
    c = F.col(name)
    out = [c.isNull().asc() if nulls_last else c.isNull().desc()]
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        nan = F.coalesce(F.isnan(c), F.lit(False))
        out.append(nan.desc() if ascending else nan.asc())
    return [*out, c.asc() if ascending else c.desc()]


@_apart
def sort_position(df: DataFrame, keys: list[tuple], out: str = "_pos", stable_by: str | None = None) -> DataFrame:
    """The place of each row, from 0, when sorted by keys as `sort` takes them."""
    name, ascending, nulls_last = (*keys[0], False)[:3]
    c = F.col(name)
    b = bucketed(df, name)
    place = F.col(_B) if ascending else -F.col(_B)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):  # NaN below all numbers
        place = F.when(F.isnan(c), -MAX_BUCKETS - 1 if ascending else MAX_BUCKETS + 1).otherwise(place)
    b = b.withColumn(_B, F.when(c.isNull(), (1 if nulls_last else -1) * (MAX_BUCKETS + 2)).otherwise(place))
    order = [x for k in keys for x in sort_order(df, *k)] + ([F.asc(stable_by)] if stable_by else [])
    before = _carried(b, {"n": F.count("*")}, {"__before": F.coalesce(F.sum("n").over(_before()), F.lit(0))})
    numbered = b.withColumn(out, F.row_number().over(Window.partitionBy(_B).orderBy(*order)) - 1)
    return numbered.join(F.broadcast(before), _B).withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop(_B, "__before")


def rank(df: DataFrame, name: str, method: str = "min", out: str | None = None) -> DataFrame:
    """rank_<name>, ascending, as double; nulls have none. method: min, max, average or dense; NaN ranks lowest.

    The different values are ranked by what stands before them and joined back, so a value
    that many rows share is one row until then.
    """
    if method not in ("min", "max", "average", "dense"):
        raise ValueError(f"no rank method {method}")
    return _rank(df, name, method, out or f"rank_{name}")


@_apart
def _rank(df: DataFrame, name: str, method: str, out: str) -> DataFrame:
    need(df, name)
    floats = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__value")).agg(F.count("*").alias("__times"))
    live = bucketed(values, "__value")
    if floats:
        live = live.withColumn(_B, F.when(F.isnan("__value"), -1).otherwise(F.col(_B)))
    size = F.lit(1) if method == "dense" else F.col("__times")
    before = _carried(live, {"n": F.sum(size)}, {"__before": F.coalesce(F.sum("n").over(_before()), F.lit(0))})
    below = F.coalesce(F.sum(size).over(Window.partitionBy(_B).orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = {"min": F.lit(1), "dense": F.lit(1), "max": F.col("__times"), "average": (F.col("__times") + 1) / F.lit(2.0)}[method]
    told = live.withColumn("__own", below).join(F.broadcast(before), _B).select("__value", (F.col("__own") + F.col("__before") + place).cast("double").alias("__own"))
    rest = [c for c in df.columns if c != out]
    return df.join(told, F.col(name) == F.col("__value"), "left").select(*(F.col(f"`{c}`") for c in rest), F.col("__own").alias(out))


@_apart
def cumulative_sum(df: DataFrame, name: str, by: str, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The sum up to each row in the order of `by`; nulls add nothing, and null stands before the first value."""
    b = bucketed(df, by)
    before = _carried(b, {"s": F.sum(name)}, {"__before": F.sum("s").over(_before())})
    own = F.sum(name).over(_window(by, *ties).rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce(F.col("__own") + F.coalesce("__before", F.lit(0)), F.col("__before"))
    return b.withColumn("__own", own).join(F.broadcast(before), _B).withColumn(out, total).drop(_B, "__before", "__own")


@_apart
def cumulative_product(df: DataFrame, name: str, by: str, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """The product up to each row, as cumulative_sum."""
    b = bucketed(df, by)
    before = _carried(b, {"s": F.product(name)}, {"__before": F.product("s").over(_before())})
    own = F.product(name).over(_window(by, *ties).rowsBetween(Window.unboundedPreceding, 0))
    total = F.coalesce(F.col("__own") * F.coalesce("__before", F.lit(1.0)), F.col("__before"))
    return b.withColumn("__own", own).join(F.broadcast(before), _B).withColumn(out, total).drop(_B, "__before", "__own")


def fill_forward(df: DataFrame, name: str, by: str, out: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The last value that is not null up to each row; leading nulls stay."""
    return _fill(df, name, by, out or name, True, ties)


def fill_backward(df: DataFrame, name: str, by: str, out: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """The next value that is not null from each row; trailing nulls stay."""
    return _fill(df, name, by, out or name, False, ties)


@_apart
def _fill(df: DataFrame, name: str, by: str, out: str, forward: bool, ties: tuple[str, ...]) -> DataFrame:
    b = bucketed(df, by)
    valid = F.when(F.col(name).isNotNull(), F.struct(by, *ties))
    if forward:
        before = _carried(b, {"v": F.max_by(name, valid)}, {"__edge": F.last("v", ignorenulls=True).over(_before())})
        own = F.last(name, ignorenulls=True).over(_window(by, *ties).rowsBetween(Window.unboundedPreceding, 0))
    else:
        before = _carried(b, {"v": F.min_by(name, valid)}, {"__edge": F.last("v", ignorenulls=True).over(_after())})
        # the last one of the order turned round: a frame that begins at each row would be read again for each
        own = F.last(name, ignorenulls=True).over(_window(by, *ties, descending=True).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("__own", own).join(F.broadcast(before), _B).withColumn(out, F.coalesce("__own", "__edge")).drop(_B, "__own", "__edge")


@_apart
def _rolling(df: DataFrame, name: str, by: str, out: str, width: int, fn, zero: bool) -> DataFrame:
    """A trailing window over positions, in blocks that also hold the rows just before them."""
    block = max(BUCKET_ROWS, 4 * width)
    p = with_position(df, by, "__pos")
    home = F.floor(F.col("__pos") / block)
    spread = F.when(F.col("__pos") % block >= block - (width - 1), F.array(home, home + 1)).otherwise(F.array(home))
    q = p.withColumn("__home", home).withColumn("__block", F.explode(spread))
    w = Window.partitionBy("__block").orderBy("__pos").rowsBetween(-(width - 1), 0)
    value = F.when(F.col("__pos") >= width - 1, fn(name).over(w))
    q = q.withColumn(out, F.coalesce(value, F.lit(0.0)) if zero else value)
    return q.where("__block = __home").drop("__pos", "__home", "__block")


def rolling_mean(df: DataFrame, name: str, by: str, width: int, out: str, min_periods_null: bool = False) -> DataFrame:
    """The mean of each row and the width - 1 before it; the first width - 1 rows give 0, or null where asked for."""
    if width <= 0:
        raise ValueError("a window needs a row")
    return _rolling(df, name, by, out, width, F.avg, not min_periods_null)


def rolling_std(df: DataFrame, name: str, by: str, width: int, out: str, min_periods_null: bool = False) -> DataFrame:
    if width <= 1:
        raise ValueError("a standard deviation needs two rows")
    return _rolling(df, name, by, out, width, F.stddev_samp, not min_periods_null)


@_apart
def z_score(df: DataFrame, name: str, out: str) -> DataFrame:
    """(x - mean) / sample deviation; zeros where that is 0 or unknown. One row is joined to all."""
    one = df.agg(F.avg(name).alias("__m"), F.stddev_samp(name).alias("__s"))
    z = F.when(F.coalesce("__s", F.lit(0.0)) == 0, 0.0).otherwise((F.col(name) - F.col("__m")) / F.col("__s"))
    return df.crossJoin(F.broadcast(one)).withColumn(out, z).drop("__m", "__s")
