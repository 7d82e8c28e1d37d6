"""Bags and sets of rows or of array elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_arrays(*xs: Column) -> Column:
    """Concatenation, nulls left out."""
    return F.filter(F.concat(*(F.coalesce(x, F.array()) for x in xs)), lambda e: e.isNotNull())


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def evict(df: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy the test, and the rest."""
    t = F.coalesce(test, F.lit(False))
    return df.where(t), df.where(~t)


def pick(df: DataFrame, seed: int = 0) -> DataFrame:
    """One row at random."""
    return df.orderBy(F.rand(seed)).limit(1)
