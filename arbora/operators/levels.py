"""Post-processing of grouped results, level by level, in long form.

Level n is the prefix of the first n keys. A rule for a level keeps or replaces its entries;
what falls away takes its parents with it as soon as they are empty, since a prefix without
rows is no group. Rules listed after a deeper level's run on what is left by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.predicates import sure


@dataclass
class Level:
    """``test`` is over aggregates of the prefix (``pre``) or plain columns; ``value`` replaces the subtree."""

    depth: int
    test: Column | None = None
    value: Column | None = None


def keep_level(df: DataFrame, keys: list[str], depth: int, test: Column) -> DataFrame:
    """Entries of the level whose prefix satisfies an aggregate test, e.g. ``F.sum('value') > 3``."""
    prefix = keys[:depth]
    good = df.groupBy(*prefix).agg(sure(test).alias("_ok")).where("_ok").select(*prefix)
    on = [df[k].eqNullSafe(good[k]) for k in prefix]
    return df.join(good, on, "left_semi")


def replace_level(df: DataFrame, keys: list[str], depth: int, value: Column, into: str = "value") -> DataFrame:
    """Entries of the level as one value each; deeper keys go."""
    return df.groupBy(*keys[:depth]).agg(value.alias(into))


def transform(df: DataFrame, keys: list[str], rules: list[Level], value: str = "value") -> tuple[DataFrame, list[str]]:
    """Applies the rules in turn; returns the rows and the keys that are left."""
    for r in rules:
        if r.test is not None:
            df = df.where(sure(r.test)) if r.depth == len(keys) else keep_level(df, keys, r.depth, r.test)
        if r.value is not None:
            if r.depth == len(keys):
                df = df.withColumn(value, r.value)
            else:
                df, keys = replace_level(df, keys, r.depth, r.value, value), keys[: r.depth]
    return df, keys


def not_standalone(df: DataFrame, row: str, column: str) -> DataFrame:
    """Cells that are not alone in both their row and their column."""
    alone = (F.count("*").over(Window.partitionBy(row)) == 1) & (F.count("*").over(Window.partitionBy(column)) == 1)
    return df.withColumn("_alone", alone).where(~F.col("_alone")).drop("_alone")


def transpose(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.select(*(F.col({row: column, column: row}.get(c, c)).alias(c) for c in df.columns))


def tree_path(keys: list[str], glue: str = "/") -> Column:
    """Keys from the entry up to the root."""
    return F.concat_ws(glue, *reversed(keys))


def cell_context(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Each cell with the sums of its row, its column and the whole matrix."""
    rows = df.groupBy(row).agg(F.sum(value).alias("of_row"))
    columns = df.groupBy(column).agg(F.sum(value).alias("of_column"))
    whole = df.agg(F.sum(value).alias("of_matrix"))  # one row
    return df.join(rows, row).join(columns, column).crossJoin(F.broadcast(whole))
