"""Linear algebra: small dense matrices, one a row, by numpy in Arrow batches; large ones by block matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import Long

#: A pivot below this makes a matrix singular.
TINY = 1e-12


def _square(x) -> np.ndarray:
    a = np.asarray(x, np.float64)
    n = int(round(len(a) ** 0.5))
    if n * n != len(a):
        raise ValueError(f"{len(a)} elements are no square matrix")
    return a.reshape(n, n)


def _singular(a: np.ndarray) -> bool:
    """Whether elimination with partial pivoting meets a pivot under TINY."""
    u = a.copy()
    for k in range(len(u)):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        if abs(u[p, k]) < TINY:
            return True
        u[[k, p]] = u[[p, k]]
        u[k + 1 :] -= np.outer(u[k + 1 :, k] / u[k, k], u[k])
    return False


def det(a: Column) -> Column:
    """Determinant of row-major square arrays; 0 for a singular one."""
    ship()

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else 0.0 if _singular(_square(x)) else float(np.linalg.det(_square(x))) for x in s], dtype="float64")

    return run(a)


def inv(a: Column) -> Column:
    """Inverse, row-major; a singular matrix raises."""
    ship()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else _inverse(_square(x)).ravel() for x in s])

    return run(a)


def _inverse(a: np.ndarray) -> np.ndarray:
    if _singular(a):
        raise ValueError("the matrix is singular")
    return np.linalg.inv(a)


def solve(a: Column, b: Column) -> Column:
    """x with a x = b; b may be a vector or a row-major matrix of as many rows. A singular matrix raises."""
    ship()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for m, r in batches:
            out = []
            for x, y in zip(m, r, strict=True):
                if x is None or y is None:
                    out.append(None)
                    continue
                s = _square(x)
                if _singular(s):
                    raise ValueError("the matrix is singular")
                out.append(np.linalg.solve(s, np.asarray(y, np.float64).reshape(len(s), -1)).ravel())
            yield pd.Series(out)

    return run(a, b)


def svd(a: Column, rows: int, cols: int) -> Column:
    """struct<u, s, vt>, row-major: u is rows x cols, vt cols x cols; columns of u for zero singular values are zero."""
    ship()

    @F.pandas_udf("u array<double>, s array<double>, vt array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in batches:
            out = []
            for x in c:
                if x is None:
                    out.append((None, None, None))
                    continue
                u, s, vt = np.linalg.svd(np.asarray(x, np.float64).reshape(rows, cols), full_matrices=rows < cols)
                s = np.pad(s, (0, cols - len(s)))
                u = np.pad(u, ((0, 0), (0, max(0, cols - u.shape[1]))))[:, :cols] * (s > TINY)
                out.append((u.ravel(), s, vt.ravel()))
            yield pd.DataFrame(out, columns=["u", "s", "vt"])

    return run(a)


def block_matmul(a: Long, b: Long, block: int = 1024) -> Long:
    """The product by distributed blocks, for matrices of many elements a row."""
    spark = a.df.sparkSession
    product = _blocks(a, block).multiply(_blocks(b, block)).toCoordinateMatrix().entries
    return Long(spark.createDataFrame(product.map(lambda e: (e.i, e.j, float(e.value))), "i0 long, i1 long, v double"), (a.shape[0], b.shape[1]))


def _blocks(x: Long, block: int):
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    entries = x.df.select("i0", "i1", "v").rdd.map(lambda r: MatrixEntry(r[0], r[1], r[2]))
    return CoordinateMatrix(entries, *x.shape).toBlockMatrix(block, block)


def singular_values(x: Long, k: int) -> list[float]:
    """The k largest singular values of a tall matrix; its columns must fit in a driver's k x columns."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix, MatrixEntry

    entries = x.df.select("i0", "i1", "v").rdd.map(lambda r: MatrixEntry(r[0], r[1], r[2]))
    return CoordinateMatrix(entries, *x.shape).toIndexedRowMatrix().computeSVD(k).s.toArray().tolist()


def gram(df: DataFrame, key: str, vector: str, index: str = "place") -> DataFrame:
    """By key, the row-major sum of x x' over vectors: long form, so no vector meets another's task."""
    long = df.select(key, F.posexplode(vector).alias("i", "x"), F.col(vector).alias("y")).select(key, "i", "x", F.posexplode("y").alias("j", "w"))
    return long.groupBy(key, "i", "j").agg(F.sum(F.col("x") * F.col("w")).alias("v"))
