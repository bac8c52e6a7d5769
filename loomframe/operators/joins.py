"""Equi-joins on columns of the same name, where null matches null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import need

TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), ordered: bool = False) -> DataFrame:
    """Columns in alphabetical order, keys once; other names on both sides get suffixes. ordered sorts by key.

    The condition is null-safe equality, which stays a hash or sort-merge key, so Spark picks broadcast,
    shuffled hash or sort-merge by size, and adaptive execution splits skewed partitions.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how not in TYPES:
        raise ValueError(f"no join {how}; there are {', '.join(TYPES)}")
    if not keys:
        raise ValueError("a join needs keys")
    need(left, *keys)
    need(right, *keys)
    for k in keys:
        a, b = left.schema[k].dataType, right.schema[k].dataType
        if a != b:
            raise TypeError(f"key {k} is {a.simpleString()} on the left and {b.simpleString()} on the right")
    suffixes = suffixes if any(suffixes) else ("_x", "_y")
    both = (set(left.columns) & set(right.columns)) - set(keys)
    names = [{c: c + s if c in both else c for c in f.columns if c not in keys} for f, s in ((left, suffixes[0]), (right, suffixes[1]))]
    made = [*keys, *names[0].values(), *names[1].values()]
    if len(set(made)) < len(made):
        raise ValueError(f"suffixes {suffixes} leave two columns of one name")
    l_key, r_key = ({k: f"__{s}{i}" for i, k in enumerate(keys)} for s in "lr")
    a = left.select(*(F.col(k).alias(l_key[k]) for k in keys), *(F.col(c).alias(n) for c, n in names[0].items()))
    b = right.select(*(F.col(k).alias(r_key[k]) for k in keys), *(F.col(c).alias(n) for c, n in names[1].items()))
    condition = reduce(lambda x, y: x & y, (F.col(l_key[k]).eqNullSafe(F.col(r_key[k])) for k in keys))
    out = a.join(b, condition, TYPES[how])
    key = {"right": lambda k: F.col(r_key[k]), "outer": lambda k: F.coalesce(l_key[k], r_key[k])}.get(how, lambda k: F.col(l_key[k]))
    out = out.select(*(key(k).alias(k) for k in keys), *names[0].values(), *names[1].values()).select(*sorted(made))
    return out.orderBy(*(F.asc_nulls_first(k) for k in keys)) if ordered else out
