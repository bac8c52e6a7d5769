"""A predicate language that compiles to Column expressions, so filters reach the scan.

null_policy "low" (the default): a null cell lies below every value, so it satisfies
lt, lte and ne; in "sql" comparisons with null are false. Connectives are two-valued under
either: `not_` makes what it negates true or false first, and a filter drops what is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    """A condition that becomes a Column once the null policy is known."""

    build: Callable[[str], Column]

    def to_column(self, null_policy: str = "low") -> Column:
        if null_policy not in ("low", "sql"):
            raise ValueError(f"null_policy is 'low' or 'sql', not {null_policy!r}")
        return self.build(null_policy)

    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return or_(self, other)

    def __invert__(self) -> Predicate:
        return not_(self)


def _plain(make: Callable[[], Column]) -> Predicate:
    """A comparison as it is, which a scan can take over; a filter counts null as false."""
    return Predicate(lambda _: make())


def _low(name: str, make: Callable[[Column], Column]) -> Predicate:
    """A comparison that null cells satisfy, unless nulls are SQL's."""

    def build(policy: str) -> Column:
        c = F.col(name)
        return c.isNull() | make(c) if policy == "low" else make(c)

    return Predicate(build)


@dataclass(frozen=True)
class Col:
    """A column to be compared. Columns are made when a frame asks for them, so no session is needed before."""

    name: str

    def eq(self, v: Any) -> Predicate:
        return self.is_null() if v is None else _plain(lambda: F.col(self.name) == v)

    def ne(self, v: Any) -> Predicate:
        return self.is_not_null() if v is None else _low(self.name, lambda c: c != v)

    def gt(self, v: Any) -> Predicate:
        return _plain(lambda: F.col(self.name) > v)

    def gte(self, v: Any) -> Predicate:
        return _plain(lambda: F.col(self.name) >= v)

    def lt(self, v: Any) -> Predicate:
        return _low(self.name, lambda c: c < v)

    def lte(self, v: Any) -> Predicate:
        return _low(self.name, lambda c: c <= v)

    def isin(self, *values: Any) -> Predicate:
        some = [v for v in values if v is not None]
        member = _plain(lambda: F.col(self.name).isin(some)) if some else or_()
        return or_(member, self.is_null()) if len(some) < len(values) else member

    def is_null(self) -> Predicate:
        return _plain(lambda: F.col(self.name).isNull())

    def is_not_null(self) -> Predicate:
        return _plain(lambda: F.col(self.name).isNotNull())

    def contains(self, part: str) -> Predicate:
        return _plain(lambda: F.col(self.name).contains(part))

    def starts_with(self, prefix: str) -> Predicate:
        return _plain(lambda: F.col(self.name).startswith(prefix))

    def matches(self, pattern: str) -> Predicate:
        """Unanchored. A pattern that does not compile raises here and not in a task."""
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"not a regular expression: {pattern!r} ({e})") from e
        return _plain(lambda: F.col(self.name).rlike(pattern))


def col(name: str) -> Col:
    return Col(name)


def and_(*parts: Predicate | None) -> Predicate:
    """All hold; true without parts; a missing part makes it false."""
    if any(p is None for p in parts):
        return Predicate(lambda _: F.lit(False))
    return Predicate(lambda policy: reduce(lambda a, b: a & b, (p.build(policy) for p in parts), F.lit(True)) if len(parts) != 1 else parts[0].build(policy))


def or_(*parts: Predicate | None) -> Predicate:
    """Any holds; false without parts; missing parts are passed over."""
    some = [p for p in parts if p is not None]
    return Predicate(lambda policy: reduce(lambda a, b: a | b, (p.build(policy) for p in some)) if some else F.lit(False))


def not_(part: Predicate | None) -> Predicate:
    """Two-valued; false for a missing part."""
    return Predicate(lambda policy: ~F.coalesce(part.build(policy), F.lit(False)) if part is not None else F.lit(False))
