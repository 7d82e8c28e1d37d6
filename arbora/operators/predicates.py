"""Selectors: two-valued predicates as Columns.

Every selector gives true or false, never null: a missing value satisfies nothing but an
explicit match with null. So ``ne`` is the complement of ``eq``, but ``gt`` and ``le`` are not
complements on null. Built from built-in functions only, so Catalyst can push them down.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Element = Callable[[Column], Column]


class Ref:
    """Marks an argument as a column to compare with, instead of a literal."""

    def __init__(self, column: Column):
        self.column = column


def ref(column) -> Ref:
    return Ref(F.col(column) if isinstance(column, str) else column)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sure(p: Column) -> Column:
    """Null becomes false."""
    return F.coalesce(p, F.lit(False))


def _same(x: Column, v) -> Column:
    if isinstance(v, Ref):
        return x.eqNullSafe(v.column)
    if v is None:
        return x.isNull()
    if isinstance(v, bool):
        return x.cast("string").eqNullSafe(F.lit(str(v).lower()))
    return (x.cast("string") if isinstance(v, str) else x).eqNullSafe(F.lit(v))


def any_of(ps: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, ps, F.lit(False))


def all_of(ps: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, ps, F.lit(True))


def eq(x, *values) -> Column:
    """Equal to any of the values; null equals null. A string literal compares with the text form."""
    return any_of(_same(_col(x), v) for v in values)


def ne(x, *values) -> Column:
    return ~eq(x, *values)


def in_(x, collection: Column) -> Column:
    x = _col(x)
    return F.exists(F.coalesce(collection, F.array()), lambda e: e.eqNullSafe(x))


def notin(x, collection: Column) -> Column:
    return ~in_(x, collection)


def _bound(v) -> Column:
    return v.column if isinstance(v, Ref) else F.lit(v)


def gt(x, v) -> Column:
    return sure(_col(x) > _bound(v))


def ge(x, v) -> Column:
    return sure(_col(x) >= _bound(v))


def lt(x, v) -> Column:
    return sure(_col(x) < _bound(v))


def le(x, v) -> Column:
    return sure(_col(x) <= _bound(v))


def between(x, low, high) -> Column:
    return sure((_col(x) >= _bound(low)) & (_col(x) <= _bound(high)))


def outside(x, low, high) -> Column:
    return sure((_col(x) < _bound(low)) | (_col(x) > _bound(high)))


def like(x, *patterns) -> Column:
    """A regular expression is found in the text; ``None`` matches null; a ref is a plain substring."""
    x = _col(x)

    def one(p) -> Column:
        if p is None:
            return x.isNull()
        if isinstance(p, Ref):
            return sure(x.cast("string").contains(p.column)) | (x.isNull() & p.column.isNull())
        return sure(x.cast("string").rlike(p))

    return any_of(map(one, patterns))


def unlike(x, *patterns) -> Column:
    return ~like(x, *patterns)


def _elements(xs) -> Column:
    return F.coalesce(_col(xs), F.array())


def _each(selectors: tuple[Element, ...]) -> Element:
    return lambda e: all_of(s(e) for s in selectors)


def any_(xs, *selectors: Element) -> Column:
    return F.exists(_elements(xs), _each(selectors)) if selectors else F.size(_elements(xs)) > 0


def none(xs, *selectors: Element) -> Column:
    return ~any_(xs, *selectors)


def all_(xs, *selectors: Element) -> Column:
    return F.forall(_elements(xs), _each(selectors))


def notall(xs, *selectors: Element) -> Column:
    return ~all_(xs, *selectors)


def count_of(xs, *selectors: Element) -> Column:
    return F.size(F.filter(_elements(xs), _each(selectors)) if selectors else _elements(xs))


def mt(xs, n: int, *selectors: Element) -> Column:
    return count_of(xs, *selectors) > n


def me(xs, n: int, *selectors: Element) -> Column:
    return count_of(xs, *selectors) >= n


def ft(xs, n: int, *selectors: Element) -> Column:
    return count_of(xs, *selectors) < n


def fe(xs, n: int, *selectors: Element) -> Column:
    return count_of(xs, *selectors) <= n


def num(xs, low: int, high: int, *selectors: Element) -> Column:
    return count_of(xs, *selectors).between(low, high)


def and_(*ps: Column) -> Column:
    return all_of(ps)


def or_(*ps: Column) -> Column:
    return any_of(ps)


def not_(*ps: Column) -> Column:
    return ~all_of(ps)


nand = not_


def nor(*ps: Column) -> Column:
    return ~any_of(ps)
