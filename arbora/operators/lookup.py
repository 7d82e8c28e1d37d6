"""Lookups as joins. None of them fetches per row; Catalyst and AQE choose the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _renamed(right: DataFrame, keys: dict[str, str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Right columns under a prefix, keys under the left's names with a mark."""
    marks = {r: f"_key_{i}" for i, r in enumerate(keys.values())}
    cols = [F.col(c).alias(f"{prefix}{c}") for c in right.columns]
    return right.select(*cols, *(F.col(r).alias(m) for r, m in marks.items())), list(marks.values())


def _on(left: DataFrame, keys: dict[str, str], marks: list[str]) -> list[Column]:
    return [left[k] == F.col(m) for k, m in zip(keys, marks, strict=True)]


def lookup(left: DataFrame, right: DataFrame, keys: dict[str, str], prefix: str = "", how: str = "left") -> DataFrame:
    """Join by equal keys (left name to right name); right columns get the prefix."""
    r, marks = _renamed(right, keys, prefix)
    return left.join(r, _on(left, keys, marks), how).drop(*marks)


def lookup_by_id_or_name(left: DataFrame, right: DataFrame, key: str, id_col: str, name_col: str, values: list[str], prefix: str = "") -> DataFrame:
    """The row whose id is the key, else the one whose name is: two equi joins instead of one OR."""
    k = F.col(key).cast("string")
    by_id = right.select(F.col(id_col).cast("string").alias("_i"), F.struct(*values).alias("_by_id"))
    by_name = right.groupBy(F.col(name_col).alias("_n")).agg(F.min(F.struct(*values)).alias("_by_name"))
    out = left.withColumn("_k", k).join(by_id, F.col("_k") == F.col("_i"), "left").join(by_name, F.col("_k") == F.col("_n"), "left")
    found = F.coalesce("_by_id", "_by_name")
    return out.withColumns({f"{prefix}{v}": found[v] for v in values}).drop("_k", "_i", "_n", "_by_id", "_by_name")


def unique_or_null(left: DataFrame, right: DataFrame, keys: dict[str, str], values: list[str], prefix: str = "") -> DataFrame:
    """The one matching row's values; null if there is none or more than one."""
    r = right.groupBy(*keys.values()).agg(F.count("*").alias("_n"), *(F.first(v).alias(v) for v in values)).where("_n = 1").drop("_n")
    return lookup(left, r, keys, prefix)


def lookup_count(left: DataFrame, right: DataFrame, keys: dict[str, str], into: str = "n") -> DataFrame:
    """Number of matching rows, 0 if none: aggregated before the join."""
    r = right.groupBy(*keys.values()).agg(F.count("*").alias(into))
    out = lookup(left, r, keys, "_c_")
    return out.withColumn(into, F.coalesce(f"_c_{into}", F.lit(0))).drop(*(c for c in out.columns if c.startswith("_c_")))


def lookup_first(left: DataFrame, right: DataFrame, keys: dict[str, str], order: list[Column], n: int = 1, prefix: str = "") -> DataFrame:
    """The first n matching rows by the given total order; a left row without match stays once."""
    w = Window.partitionBy(*keys.values()).orderBy(*order)
    r = right.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return lookup(left, r, keys, prefix).drop(f"{prefix}_rn")


def lookup_list(left: DataFrame, right: DataFrame, keys: dict[str, str], value: Column, order: list[str], into: str) -> DataFrame:
    """All matching values in order, nulls kept; an empty list if there is none. Without an order they come in any."""
    items = F.collect_list(F.struct(*order, value.alias("_v")))
    r = right.groupBy(*keys.values()).agg(F.transform(F.array_sort(items) if order else items, lambda s: s["_v"]).alias(into))
    out = lookup(left, r, keys, "_l_")
    return out.withColumn(into, F.coalesce(f"_l_{into}", F.array())).drop(*(c for c in out.columns if c.startswith("_l_")))


def with_match(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    r, marks = _renamed(right.select(*keys.values()), keys, "_r_")
    return left.join(r, _on(left, keys, marks), "left_semi")


def without_match(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    r, marks = _renamed(right.select(*keys.values()), keys, "_r_")
    return left.join(r, _on(left, keys, marks), "left_anti")


def key_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().exceptAll(right.distinct())


def free_iteration(*sides: DataFrame, most: int = 100_000) -> DataFrame:
    """All combinations of small dimension tables; sides of more than ``most`` rows together raise, but for the first."""
    rows = 1
    for s in sides[1:]:
        rows *= max(1, s.limit(most + 1).count())
        if rows > most:
            raise ValueError(f"more than {most} combinations for each row; join by a key instead")
    out = sides[0]
    for s in sides[1:]:
        out = out.crossJoin(F.broadcast(s))
    return out


def interval_join(points: DataFrame, spans: DataFrame, keys: dict[str, str], at: str, low: str, high: str, prefix: str = "", bucket: float | None = None) -> DataFrame:
    """Points inside closed intervals of equal keys.

    With ``bucket`` (units of ``at`` as a number or seconds) both sides also join on the bucket's
    number, spans once for each bucket they touch, so that a frequent key is dealt out by time.
    """
    r, marks = _renamed(spans, keys, prefix)
    on = _on(points, keys, marks)
    inside = (F.col(at) >= F.col(f"{prefix}{low}")) & (F.col(at) <= F.col(f"{prefix}{high}"))
    if bucket:
        kinds = dict(points.dtypes) | {f"{prefix}{c}": t for c, t in spans.dtypes}

        def number(c: str) -> Column:
            x = F.col(c).cast("timestamp").cast("double") if kinds[c].startswith("timestamp") else F.col(c)
            return F.floor(x / bucket)

        points = points.withColumn("_bucket", number(at))
        r = r.withColumn("_b", F.explode(F.sequence(number(f"{prefix}{low}"), number(f"{prefix}{high}"))))
        on = [*_on(points, keys, marks), F.col("_bucket") == F.col("_b")]
    return points.join(r, [*on, inside]).drop(*marks, "_bucket", "_b")


def correlate(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One row for each key of any source, with each source's other columns under its name."""
    out = None
    for name, df in sources.items():
        df = df.select(F.col(key), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key))
        out = df if out is None else out.join(df, key, "full")
    return out


def get(m: Column, *keys) -> Column:
    """Value at nested keys, null if any is missing."""
    for k in keys:
        m = F.try_element_at(m, k if isinstance(k, Column) else F.lit(k))
    return m
