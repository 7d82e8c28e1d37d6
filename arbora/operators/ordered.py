"""What depends on the order of rows. Every function asks for a total order within its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.core.storage import cut
from arbora.operators.predicates import sure


def previous(value: Column, keys: list[str], order: list[Column]) -> Column:
    """The value of the row before."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))


def carry_forward(value: Column, when: Column, keys: list[str], order: list[Column]) -> Column:
    """The value of the last row, this one included, for which ``when`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a struct, so that a carried null is told from none
    return F.last(F.when(sure(when), F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"]


def next_when(value: Column, when: Column, keys: list[str], order: list[Column]) -> Column:
    """The value of the first later row for which ``when`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return F.first(F.when(sure(when), F.struct(value.alias("v"))), ignorenulls=True).over(w)["v"]


def pair(df: DataFrame, start: Column, end: Column, at: str, keys: list[str], order: list[Column]) -> DataFrame:
    """Start rows with the time of the next end row of their keys, as ``ended``; those without go."""
    out = df.withColumn("ended", next_when(F.col(at), end, keys, order))
    return out.where(sure(start) & F.col("ended").isNotNull())


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sort_keys(*keys: str) -> list[Column]:
    """Order columns from ``name`` or ``name desc``; nulls come first in both directions."""
    out = []
    for k in keys:
        name, _, way = k.strip().partition(" ")
        out.append(F.col(name).desc_nulls_first() if way.strip().lower() == "desc" else F.col(name).asc_nulls_first())
    return out


def sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*sort_keys(*keys))


def numbered(df: DataFrame, *keys: str, into: str = "rn") -> DataFrame:
    """Every row with its number, from 1, in the order of the keys, which must be total.

    Rows are sorted in ranges, numbered in each and moved by the rows of the ranges before; the
    driver sees one row a range. The sorted rows are cut from their plan, so that both passes see
    the same ranges, whichever executor is lost.
    """
    # the upper bits of the identifier are the range, the lower 33 the place in it
    rows = cut(sort(df, *keys).withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_at", 33).cast("int").alias("_range")).agg(F.count("*").alias("_n")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before.append((r["_range"], total))
        total += r["_n"]
    moved = F.broadcast(df.sparkSession.createDataFrame(before, "_range int, _before long"))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return rows.withColumn("_range", F.shiftright("_at", 33).cast("int")).join(moved, "_range").withColumn(into, at).drop("_at", "_range", "_before")


def sort_array(xs: Column, key=None, desc: bool = False) -> Column:
    """Stable sort of an array by a key of its elements, nulls first in both directions."""
    tagged = F.transform(xs, lambda e, i: F.struct(e.alias("e"), (key(e) if key else e).alias("k"), i.alias("i")))

    def compare(a, b):
        less, more = (1, -1) if desc else (-1, 1)
        return (
            F.when(a["k"].isNull() & b["k"].isNull(), a["i"] - b["i"]).when(a["k"].isNull(), F.lit(-1)).when(b["k"].isNull(), F.lit(1))
            .when(a["k"] < b["k"], F.lit(less)).when(a["k"] > b["k"], F.lit(more)).otherwise(a["i"] - b["i"])
        )

    return F.transform(F.array_sort(tagged, compare), lambda s: s["e"])
