"""Unnesting with parents in scope, and recursion with a path-based loop guard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arbora.core.storage import cut


def unfold(df: DataFrame, collection: Column, into: str, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """A row for each element; the kept columns of the parent stay beside it. Rows without elements go, unless outer.

    ``keep`` names the parent columns that later steps use, so that no more travels.
    """
    f = F.explode_outer if outer else F.explode
    return df.select(*(keep if keep is not None else df.columns), f(collection).alias(into))


def unfold_map(df: DataFrame, m: Column, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep if keep is not None else df.columns), F.explode(m).alias("key", "value"))


def nested(df: DataFrame, *levels: tuple[DataFrame, str, str]) -> DataFrame:
    """Parent rows joined down foreign keys: each level is (rows, parent's key, own foreign key)."""
    for rows, parent_key, foreign_key in levels:
        df = df.join(rows, df[parent_key] == rows[foreign_key])
    return df


def recurse(df: DataFrame, roots: Column, id_col: str, parent_col: str, include_root: bool = True, depth: int | None = None, stop: Column | None = None, most: int = 100) -> DataFrame:
    """root, id, depth, path of everything below the roots, along a parent reference.

    An element that is among its own ancestors is given once more, then not expanded. One for
    which ``stop`` holds (over the columns of ``df``) is given, not expanded; a root that is not given
    is expanded in any case. ``depth`` limits
    the levels below the root; without it, more than ``most`` raise. Every step is one join over
    the level before, which is cut from its plan, so that time follows the number of levels; the
    loop ends when a level is empty. Edges are cut as well, being read by every step.
    """
    ends = F.lit(False) if stop is None else F.coalesce(stop, F.lit(False))
    edges = cut(df.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_parent"), ends.alias("_stop")).where("_parent IS NOT NULL"))
    level = df.where(roots).select(F.col(id_col).alias("root"), F.col(id_col).alias("id"), F.lit(0).alias("depth"), F.array(id_col).alias("path"), (ends if include_root else F.lit(False)).alias("_end"))
    out, d = (level if include_root else level.limit(0)), 0
    while depth is None or d < depth:
        open_ = level.where(~F.col("_end") & ~F.array_contains(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.col("id")))
        d += 1
        rows = Observation()
        level = cut(open_.join(edges, open_["id"] == edges["_parent"]).select(
            "root", F.col("_id").alias("id"), F.lit(d).alias("depth"), F.concat("path", F.array("_id")).alias("path"), F.col("_stop").alias("_end")
        ).observe(rows, F.count("*").alias("n")))
        if not rows.get["n"]:
            break
        if depth is None and d > most:
            raise ValueError(f"more than {most} levels; give a depth")
        out = out.unionByName(level)
    return out.drop("_end")


def recurse_sql(df: DataFrame, root_sql: str, id_col: str, parent_col: str, include_root: bool = True, depth: int | None = None, stop_sql: str = "false") -> DataFrame:
    """The same with conditions as SQL.

    Not one recursive common table expression: Spark raises beyond 1,000,000 rows of such a one
    (``spark.sql.cteRecursionRowLimit``), while levels have no bound of rows.
    """
    return recurse(df, F.expr(root_sql), id_col, parent_col, include_root, depth, F.expr(stop_sql))


def parents(path: Column, glue: str = "/") -> Column:
    """The chain of parents as text, nearest first."""
    return F.array_join(F.transform(F.reverse(path), lambda x: x.cast("string")), glue)


def flatten_arrays(root: Column, *steps: Callable[[Column], Column]) -> Column:
    """Nested iteration inside a row: elements of the last step over those of the ones before."""
    out = steps[0](root)
    for s in steps[1:]:
        out = F.flatten(F.transform(out, lambda e, s=s: s(e)))
    return out
