"""N-dimensional arrays in two forms.

Small ones are a struct<shape: array<int>, data: array<double>> in a row (NDColumn), worked by
higher-order functions. Large ones are long frames of coordinates i0, i1, ... and a value v
(Long), worked by joins and aggregates. Division follows IEEE: no error on zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE has it."""
    a, b = a.cast("double"), b.cast("double")
    sign = F.signum(a)
    zero = F.when((a == 0) | F.isnan(a), NAN).when(F.startswith(b.cast("string"), F.lit("-")), -sign * INF).otherwise(sign * INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def log(x: Column) -> Column:
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.ln(x))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": divide,
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
}
UNARY: dict[str, Callable[[Column], Column]] = {"abs": F.abs, "neg": lambda x: -x, "sqrt": F.sqrt, "exp": F.exp, "log": log}


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """Shapes aligned at their ends; equal sizes, or 1."""
    out = []
    for k in range(1, max(len(a), len(b)) + 1):
        x, y = (s[-k] if k <= len(s) else 1 for s in (a, b))
        if x != y and 1 not in (x, y):
            raise ValueError(f"shapes {a} and {b} do not fit")
        out.append(y if x == 1 else x)
    return tuple(reversed(out))


# one array a row


def values(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def zipped(op: str, a: Column, b: Column) -> Column:
    """Element by element over arrays of one length; another length raises."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, BINARY[op])).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("array lengths differ")).cast("array<boolean>" if op in ("eq", "gt", "lt") else "array<double>"))


def with_scalar(op: str, a: Column, s: float) -> Column:
    return F.transform(a, lambda x: BINARY[op](x, F.lit(s)))


def power(a: Column, p: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(p)))


def mapped(op: str, a: Column) -> Column:
    return F.transform(a, UNARY[op])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(zipped("mul", a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def at(a: Column, shape: tuple[int, ...], *index: int) -> Column:
    """An element by its full index; out of bounds raises here."""
    if len(index) != len(shape) or any(not 0 <= i < n for i, n in zip(index, shape, strict=False)):
        raise IndexError(index)
    return F.element_at(a, flat_index(shape, index) + 1)


def put(a: Column, shape: tuple[int, ...], index: tuple[int, ...], value: float) -> Column:
    k = flat_index(shape, index)
    return F.transform(a, lambda x, i: F.when(i == k, F.lit(value)).otherwise(x))


def flat_index(shape: tuple[int, ...], index: tuple[int, ...]) -> int:
    return sum(i * s for i, s in zip(index, strides(shape), strict=True))


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(math.prod(shape[k + 1 :]) for k in range(len(shape)))


def sliced(a: Column, n: int, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """A one-dimensional array of n elements cut as Python cuts a list."""
    places = range(n)[slice(start, stop, step)]
    if places.step == 1:
        return F.slice(a, places.start + 1, len(places))
    return F.transform(F.array(*map(F.lit, places)), lambda i: F.element_at(a, i + 1)) if len(places) else F.slice(a, 1, 0)


def reduced(op: str, a: Column, shape: tuple[int, ...], axis: int) -> Column:
    """sum, mean, min or max along an axis of a small row-major array; axis -1 takes all, as one element."""
    if not 0 <= axis < len(shape):
        whole = {"sum": total, "mean": mean, "min": F.array_min, "max": F.array_max}[op](a)
        return F.array(whole)
    inner, n = math.prod(shape[axis + 1 :]), shape[axis]
    out = [k for k in range(math.prod(shape)) if k // inner % n == 0]
    lines = F.transform(F.array(*map(F.lit, out)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.element_at(a, (k + j * inner + 1).cast("int"))))
    return F.transform(lines, {"sum": total, "mean": mean, "min": F.array_min, "max": F.array_max}[op])


# long form


@dataclass(frozen=True)
class Long:
    """Coordinates i0, i1, ... and a value v, a row an element."""

    df: DataFrame
    shape: tuple[int, ...]

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def flat(self) -> Column:
        return reduce(lambda x, y: x + y, (F.col(a) * s for a, s in zip(self.axes, strides(self.shape), strict=True)), F.lit(0).cast("long"))

    def preview(self, n: int = 12) -> str:
        """Shape, size and the first n values in row-major order."""
        first = self.df.select(self.flat().alias("at"), "v").orderBy("at").limit(n).collect()
        data = " ".join(str(r.v) for r in first) + (" ..." if self.size > n else "")
        return f"Long(shape={list(self.shape)}, size={self.size}, data=[{data}])"

    def map(self, fn: Callable[[Column], Column]) -> Long:
        return Long(self.df.withColumn("v", fn(F.col("v"))), self.shape)

    def scalar(self, op: str, s: float) -> Long:
        return self.map(lambda v: BINARY[op](v, F.lit(s)))

    def unary(self, op: str) -> Long:
        return self.map(UNARY[op])

    def flatten(self) -> Long:
        return Long(self.df.select(self.flat().alias("i0"), "v"), (self.size,))

    def reshape(self, *shape: int) -> Long:
        if math.prod(shape) != self.size:
            raise ValueError(f"{self.size} elements cannot have shape {shape}")
        f = self.flat()
        return Long(self.df.select(*((F.floor(f / s).cast("long") % n).alias(f"i{k}") for k, (s, n) in enumerate(zip(strides(shape), shape, strict=True))), "v"), tuple(shape))

    def transpose(self) -> Long:
        n = self.ndim
        return Long(self.df.select(*(F.col(f"i{n - 1 - k}").alias(f"i{k}") for k in range(n)), "v"), tuple(reversed(self.shape)))

    def slice(self, *specs: slice) -> Long:
        """Python's slices by axis, missing axes whole; coordinates are counted anew."""
        if any(s.step == 0 for s in specs):
            raise ValueError("a step cannot be 0")
        df, shape = self.df, list(self.shape)
        for k, spec in enumerate(specs):
            r, a = range(self.shape[k])[spec], F.col(f"i{k}")
            if not len(r):
                df, shape[k] = df.where(F.lit(False)), 0
                continue
            df = df.where(a.between(min(r[0], r[-1]), max(r[0], r[-1])) & ((a - r[0]) % abs(r.step) == 0))
            df, shape[k] = df.withColumn(f"i{k}", ((a - r[0]) / r.step).cast("long")), len(r)
        return Long(df, tuple(shape))

    def combine(self, op: str, other: Long) -> Long:
        """Element-wise with broadcasting; axes of size 1 are left out of the join's keys."""
        shape = broadcast_shape(self.shape, other.shape)
        n = len(shape)
        sides = []
        for s, x in (("a", self), ("b", other)):
            lead = n - x.ndim
            wide = {k + lead: f"i{k}" for k in range(x.ndim) if x.shape[k] == shape[k + lead] and (x.shape[k] != 1 or shape[k + lead] == 1)}
            wide = {k: c for k, c in wide.items() if shape[k] != 1}
            sides.append((wide, x.df.select(*(F.col(c).alias(f"{s}{k}") for k, c in wide.items()), F.col("v").alias(f"{s}_v"))))
        (ka, a), (kb, b) = sides
        shared = [F.col(f"a{k}") == F.col(f"b{k}") for k in ka if k in kb]
        if not shared and self.size > 1 and other.size > 1 and self.ndim + other.ndim > 0 and ka and kb:
            out = a.join(b, F.lit(True))  # an outer product: every pair is an element of the result
        else:
            out = a.join(b, reduce(lambda x, y: x & y, shared)) if shared else a.crossJoin(F.broadcast(b) if other.size == 1 else b)
        coordinate = lambda k: F.col(f"a{k}") if k in ka else F.col(f"b{k}") if k in kb else F.lit(0).cast("long")
        return Long(out.select(*(coordinate(k).alias(f"i{k}") for k in range(n)), BINARY[op](F.col("a_v"), F.col("b_v")).alias("v")), shape)

    def reduce(self, op: str, axis: int = -1) -> Long:
        """sum, mean, min or max along an axis, correct for any rank; another axis takes all elements."""
        fn = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[op]("v").alias("v")
        if not 0 <= axis < self.ndim or self.ndim == 1:
            return Long(self.df.agg(fn).select(F.lit(0).cast("long").alias("i0"), "v"), (1,))
        rest = [a for k, a in enumerate(self.axes) if k != axis]
        out = self.df.groupBy(*rest).agg(fn)
        return Long(out.select(*(F.col(a).alias(f"i{k}") for k, a in enumerate(rest)), "v"), tuple(n for k, n in enumerate(self.shape) if k != axis))

    def matmul(self, other: Long) -> Long:
        """Join on the inner axis, sum by the outer ones; partial sums are made before the shuffle."""
        if self.ndim != 2 or other.ndim != 2 or self.shape[1] != other.shape[0]:
            raise ValueError(f"shapes {self.shape} and {other.shape} cannot be multiplied")
        a = self.df.select("i0", F.col("i1").alias("k"), F.col("v").alias("a"))
        b = other.df.select(F.col("i0").alias("k"), "i1", F.col("v").alias("b"))
        return Long(a.join(b, "k").groupBy("i0", "i1").agg(F.sum(F.col("a") * F.col("b")).alias("v")), (self.shape[0], other.shape[1]))

    def norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))


def from_flat(df: DataFrame, shape: tuple[int, ...], index: str = "i0", value: str = "v") -> Long:
    return Long(df.select(F.col(index).cast("long").alias("i0"), F.col(value).alias("v")), (math.prod(shape),)).reshape(*shape)


def full(spark: SparkSession, value: float, *shape: int) -> Long:
    return from_flat(spark.range(math.prod(shape)).select(F.col("id").alias("i0"), F.lit(float(value)).alias("v")), shape)


def zeros(spark: SparkSession, *shape: int) -> Long:
    return full(spark, 0.0, *shape)


def ones(spark: SparkSession, *shape: int) -> Long:
    return full(spark, 1.0, *shape)


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> Long:
    """Half open; empty for step 0. Elements are start + i * step, without drift."""
    n = max(0, math.ceil((stop - start) / step)) if step else 0
    return Long(spark.range(n).select(F.col("id").alias("i0"), (F.lit(float(start)) + F.col("id") * float(step)).alias("v")), (n,))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> Long:
    """Both ends included, the last exactly stop."""
    n = max(0, n)
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    v = F.when((F.col("id") == n - 1) & (F.lit(n) > 1), float(stop)).otherwise(F.lit(float(start)) + F.col("id") * step)
    return Long(spark.range(n).select(F.col("id").alias("i0"), v.alias("v")), (n,))


def random(spark: SparkSession, seed: int, *shape: int) -> Long:
    """Uniform in [0, 1); the same for the same seed and partitioning."""
    return from_flat(spark.range(math.prod(shape)).select(F.col("id").alias("i0"), F.rand(seed).alias("v")), shape)


def random_normal(spark: SparkSession, seed: int, mean: float, std: float, *shape: int) -> Long:
    return from_flat(spark.range(math.prod(shape)).select(F.col("id").alias("i0"), (F.randn(seed) * std + mean).alias("v")), shape)
