"""Keyed aggregation. A nested map of any depth is kept in long form: key columns and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.core.storage import pieces


def count_by(df: DataFrame, *keys: Column, into: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(into))


def group_by(df: DataFrame, keys: list[Column], value: Column, order: list[str], into: str = "values", distinct: bool = False) -> DataFrame:
    """Values of each key in the given order, nulls kept; or the distinct values, sorted."""
    if distinct:
        return df.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(into))
    item = F.struct(*order, value.alias("_v"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_v"]).alias(into))


def index_by(df: DataFrame, keys: list[Column], value: Column, into: str = "value") -> DataFrame:
    """One value a key; several non-null ones are a collision, which raises."""
    out = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.max(value).alias(into))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("Key collision"))).otherwise(F.col(into))
    return out.withColumn(into, checked).drop("_n")


def overlay(target: DataFrame, source: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Source entries over target entries, with their nulls: presence decides, not the value."""
    t = target.select(*keys, F.col(value).alias("_t"), F.lit(True).alias("_in_t"))
    s = source.select(*keys, F.col(value).alias("_s"), F.lit(True).alias("_in_s"))
    out = t.join(s, keys, "full")
    return out.select(*keys, F.when(F.coalesce("_in_s", F.lit(False)), F.col("_s")).otherwise(F.col("_t")).alias(value))


def compress(df: DataFrame, path: str, value: str, glue: str = "/") -> DataFrame:
    """Folds chains of single children into one key: ``path`` is an array of keys, one row a leaf.

    Every prefix of a path is one node; a key is glued to the one before unless its parent
    has several children. A parent has them if its least child is not its greatest, which one window
    tells. First keys are never glued, so the root's children are not compared: they would be one
    group of all rows. Paths travel with the places of their keys, and are dealt to as many tasks
    as the input's size asks for (``pieces``).
    """
    n = pieces(df)
    rows = df.select(path, value).where(F.size(path) > 0).repartition(n, path)
    # places of keys below the first; parent and key are read from the path where they are compared
    places = F.when(F.size(path) > 1, F.sequence(F.lit(1), F.size(path) - 1))
    steps = rows.select(path).distinct().select(path, F.explode(places).alias("_i"))
    parent, key = F.slice(path, F.lit(1), F.col("_i")), F.get(F.col(path), F.col("_i"))
    w = Window.partitionBy("_parent")
    steps = steps.withColumn("_parent", parent).repartition(n, "_parent")
    steps = steps.withColumn("_several", F.min(key).over(w) < F.max(key).over(w)).where("_several")
    starts = steps.select(path, "_i").repartition(n, path).groupBy(path).agg(F.collect_list("_i").alias("_starts"))
    tail = F.slice(F.transform(path, lambda k, i: F.struct(k.alias("key"), F.coalesce(F.array_contains("_starts", i), F.lit(False)).alias("starts"))), F.lit(2), F.size(path))
    folded = F.aggregate(
        tail, F.array(F.element_at(path, 1)).cast("array<string>"),
        lambda acc, x: F.when(x["starts"], F.concat(acc, F.array(x["key"]))).otherwise(
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(glue), x["key"])))
        ),
    )
    return rows.join(starts, path, "left").select(folded.alias(path), value)


def matrix(df: DataFrame, row: str, column: str, columns: list, value: str, how: str = "sum") -> DataFrame:
    """One column for each given column key."""
    return df.groupBy(row).pivot(column, columns).agg(getattr(F, how)(value))


def totals(df: DataFrame, row: str, column: str, value: str, into: str = "total") -> DataFrame:
    """Cells, row totals, column totals and the grand total, told apart by ``level`` (0, 1, 2, 3)."""
    return df.cube(row, column).agg(F.sum(value).alias(into), F.grouping_id().cast("int").alias("level"))


def share(value: Column, *parent: str) -> Column:
    """Value over the sum of its parent's values."""
    return value / F.sum(value).over(Window.partitionBy(*parent))


def unique_only(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that have exactly one member."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").drop("n")


def in_every_sample(df: DataFrame, sample: str, *keys: str) -> DataFrame:
    """Keys that occur in every sample."""
    n = df.agg(F.countDistinct(sample).alias("_all"))
    return df.groupBy(*keys).agg(F.countDistinct(sample).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all"), "left_semi").select(*keys)


def path_counts(df: DataFrame, path: str, into: str = "n") -> DataFrame:
    """How many rows go through each prefix of a path, such as the frames of sampled stacks."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.slice(path, F.lit(1), k))
    return df.where(F.size(path) > 0).select(F.explode(prefixes).alias(path)).groupBy(path).agg(F.count("*").alias(into))


def trimmed(path: Column, suspend: str | None = None, resume: str | None = None) -> Column:
    """A path without the frames after one that matches ``suspend``, up to one that matches ``resume``; a frame between tells how many were left out.

    Frames left out up to the end are not told. Null stays null; a null frame matches nothing.
    """
    none = F.array().cast("array<string>")

    def hit(frame: Column, pattern: str | None) -> Column:
        return F.lit(False) if pattern is None else F.coalesce(frame.rlike(pattern), F.lit(False))

    def step(s: Column, frame: Column) -> Column:
        shown = (s["left"] < 0) | hit(frame, resume)
        note = F.when(s["left"] > 0, F.array(F.format_string("... %d skipped ...", s["left"]))).otherwise(none)
        left = F.when(shown, F.when(hit(frame, suspend), F.lit(0)).otherwise(F.lit(-1))).otherwise(s["left"] + 1)
        return F.struct(F.when(shown, F.concat(s["kept"], note, F.array(frame))).otherwise(s["kept"]).alias("kept"), left.alias("left"))

    # left: how many frames were left out so far, -1 while frames are shown
    return F.aggregate(path, F.struct(none.alias("kept"), F.lit(-1).alias("left")), step)["kept"]


def by_member_set(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys grouped by the set of their members."""
    sets = df.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("members"))
    return sets.groupBy("members").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def put(df: DataFrame, updates: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Upsert: the updates' entries replace those of the same keys."""
    return overlay(df, updates, keys, value)


def peek(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The first leaf in the order of the keys, and how deep it lies."""
    return df.orderBy(*(F.col(k).asc_nulls_first() for k in keys)).limit(1).select(value, F.lit(len(keys)).alias("depth"))


def counters(df: DataFrame, *keys: str) -> DataFrame:
    """level, n: how many different key paths there are on each level, and (level 0) how many records."""
    prefixes = [F.struct(*keys[: i + 1]) for i in range(len(keys))]
    counted = df.agg(F.count("*").alias("n0"), *(F.count_distinct(p).alias(f"n{i + 1}") for i, p in enumerate(prefixes)))
    return counted.select(F.posexplode(F.array(*counted.columns)).alias("level", "n"))


# Aggregates over an array: nulls are skipped, an empty or all-null array gives null.


def array_sum(xs: Column, kind: str = "long") -> Column:
    present = F.filter(xs, lambda e: e.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0).cast(kind), lambda a, e: a + e))


def array_avg(xs: Column) -> Column:
    present = F.filter(xs, lambda e: e.isNotNull())
    return F.try_divide(F.aggregate(present, F.lit(0.0), lambda a, e: a + e.cast("double")), F.size(present))


def size_of(x: Column, kind: str) -> Column:
    """Length of a collection, map or text; null for null and for anything else."""
    if kind.startswith(("array", "map")):
        return F.when(x.isNotNull(), F.size(x))
    return F.length(x) if kind == "string" else F.lit(None).cast("int")
