"""Projection, filtering of collections, decisions by rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.operators.predicates import Element, all_of, sure


def coalesce_collection(x: Column, kind: str) -> Column:
    """A collection from any value, by its type: null is empty, a map its entries, a scalar a singleton."""
    if kind.startswith("array"):
        return F.coalesce(x, F.array())
    if kind.startswith("map"):
        return F.map_entries(x)
    return F.when(x.isNull(), F.array().cast(f"array<{kind}>")).otherwise(F.array(x))


def select(xs: Column, selector: Element | None = None, n: int | None = None) -> Column:
    """Elements that satisfy the selector, at most n; null if there is none; the element itself for n = 1."""
    out = F.filter(xs, selector) if selector else xs
    if n == 1:
        return F.try_element_at(out, F.lit(1))
    if n is not None:
        out = F.slice(out, 1, n)
    return F.when(F.size(out) > 0, out)


def switch(discriminant: Column, cases: list[tuple[str, Column]], default: Column | None = None) -> Column:
    """The first expression whose pattern is found in the discriminant; null goes to the default alone."""
    out = None
    for pattern, value in cases:
        hit = sure(discriminant.cast("string").rlike(pattern))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    last = F.lit(None) if default is None else default
    return last if out is None else out.otherwise(last)


def partition(x: Column, thresholds: list[tuple[float, Column]], default: Column | None = None) -> Column:
    """The expression of the highest threshold that x reaches."""
    out = None
    for low, value in sorted(thresholds, key=lambda t: -t[0]):
        out = F.when(x >= low, value) if out is None else out.when(x >= low, value)
    return out.otherwise(F.lit(None) if default is None else default)


def assign(df: DataFrame, *blocks: dict[str, Column]) -> DataFrame:
    """Synthetic attributes; columns of one block see the state before it, later blocks see them."""
    for block in blocks:
        df = df.withColumns(block)
    return df


def construct(fields: dict[str, Column], merge: Column | None = None) -> Column:
    """A map of named values as strings; ``merge`` is a map that goes first, later names win."""
    own = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v)))
    if merge is None:
        return own
    kept = F.map_filter(merge, lambda k, v: ~k.isin(*fields)) if fields else merge
    return F.map_concat(kept, own)


def decompose(xs: Column, names: list[str]) -> dict[str, Column]:
    """A list's elements as columns; missing ones are null, more are dropped."""
    return {name: F.try_element_at(xs, F.lit(i + 1)) for i, name in enumerate(names)}


@dataclass
class Action:
    accept: bool
    selectors: list[Column] = field(default_factory=list)
    id: str | None = None
    value: Column | None = None

    @property
    def test(self) -> Column:
        return all_of(self.selectors)


@dataclass
class Rule:
    """Header selectors say whether the rule applies, actions what it decides; all by first match."""

    headers: list[Column] = field(default_factory=list)
    actions: list[Action] = field(default_factory=list)
    id: str | None = None

    @property
    def applies(self) -> Column:
        return all_of(self.headers)


DECISION = "struct<ruleId:string,actionId:string,accept:boolean>"


def decision(rules: list[Rule], headers: list[Column] | None = None) -> Column:
    """ruleId, actionId, accept of the first action that holds, top down; null if none does."""
    out = None
    for k, r in enumerate(rules):
        applies = headers[k] if headers else r.applies
        for a in r.actions:
            value = F.struct(F.lit(r.id).alias("ruleId"), F.lit(a.id).alias("actionId"), F.lit(a.accept).alias("accept"))
            out = F.when(applies & a.test, value) if out is None else out.when(applies & a.test, value)
    return F.lit(None).cast(DECISION) if out is None else out.otherwise(F.lit(None).cast(DECISION))


def decide(df: DataFrame, rules: list[Rule], keep: str = "_decision") -> DataFrame:
    """Accepted rows with their decision."""
    return df.withColumn(keep, decision(rules)).where(sure(F.col(f"{keep}.accept")))


def two_phase(primary: DataFrame, rules: list[Rule], unnest, keep: str = "_decision") -> DataFrame:
    """Headers judge primary rows before they are unnested; actions judge the secondary rows.

    ``unnest`` maps a DataFrame to its secondary rows; the header flags travel with it.
    """
    flags = {f"_rule{k}": r.applies for k, r in enumerate(rules)}
    rows = primary.withColumns(flags).where(" OR ".join(flags))
    rows = unnest(rows).withColumn(keep, decision(rules, [F.col(f) for f in flags]))
    return rows.where(sure(F.col(f"{keep}.accept"))).drop(*flags)


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each rule's column: the value (or text) of its first action that holds; a rejecting one raises."""
    columns = {}
    for r in rules:
        out = None
        for a in r.actions:
            value = (F.lit(a.id) if a.value is None else a.value) if a.accept else F.raise_error(F.lit(a.id or f"rejected by {r.id}"))
            out = F.when(r.applies & a.test, value) if out is None else out.when(r.applies & a.test, value)
        columns[r.id] = F.lit(None).cast("string") if out is None else out
    return df.withColumns(columns)
