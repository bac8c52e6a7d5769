"""Parallel map, reduce, filter and for-each over a column: what Spark's tasks do anyway."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.predicates import Predicate
from . import frame


class Pool:
    """A number of partitions to work in; none, or less than one, leaves partitioning to Spark."""

    def __init__(self, workers: int = 0):
        self.workers = workers if workers > 0 else os.cpu_count() or 1
        self._asked = workers > 0

    def spread(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.workers) if self._asked and df.rdd.getNumPartitions() < self.workers else df

    def map(self, df: DataFrame, name: str, fn: Callable[[Column], Column]) -> DataFrame:
        """Null stays null."""
        return df.withColumn(name, F.when(F.col(name).isNotNull(), fn(F.col(name))))

    def reduce(self, df: DataFrame, name: str, start: Any, fn: Callable[[Any, Any], Any]) -> Any:
        """An associative fn over valid values: folded in each partition, then joined; start is applied once."""

        def part(rows):
            got = None
            for r in rows:
                if r[0] is not None:
                    got = r[0] if got is None else fn(got, r[0])
            if got is not None:
                yield got

        parts = df.select(name).rdd.mapPartitions(part)
        return fn(start, parts.treeReduce(fn)) if not parts.isEmpty() else start

    def filter(self, df: DataFrame, name: str, condition: Column) -> DataFrame:
        return df.where(F.col(name).isNotNull() & condition)

    def apply(self, df: DataFrame, name: str, fn: Callable[[Column], Column]) -> DataFrame:
        """A column put through fn, which sees nulls."""
        return frame.apply(df, name, fn)

    def where(self, df: DataFrame, predicate: Predicate) -> DataFrame:
        return frame.where(df, predicate)

    def for_each(self, df: DataFrame, name: str, fn: Callable[[list], None]) -> None:
        """fn gets the values of a partition, nulls too."""
        self.spread(df.select(name)).foreachPartition(lambda rows: fn([r[0] for r in rows]))
