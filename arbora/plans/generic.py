"""The declared query: source, selection, unnesting, computations, output or grouping, post-processing, layout.

Everything up to the layout is one lazy plan. Headers of selection rules filter primary rows
before they are unnested; computations of one block see the state before the block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.lang import expr, syntax
from arbora.lang.macros import expand
from arbora.lang.rules import compile_rules
from arbora.operators.levels import Level, transform
from arbora.operators.select import decision, evaluate
from arbora.operators.predicates import sure
from arbora.render import tables
from arbora.sources import tables as sources


@dataclass
class Query:
    """Texts of the query's parts; see the README for each."""

    source: DataFrame | str = ""
    filter: str = ""
    ordering: str = ""
    selector: str = ""
    subquery: str = ""
    computations: str = ""
    output: str = ""
    grouping: str = ""
    postprocessing: list[Level] = field(default_factory=list)
    layout: str = ""
    max_rows: int = 0
    max_captions: int = 6
    parameters: dict = field(default_factory=dict)
    macros: dict = field(default_factory=dict)
    catalog: dict = field(default_factory=dict)
    type_name: str = ""
    title: str = ""


def _lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.splitlines()) if x]


def _source(spark: SparkSession, q: Query) -> DataFrame:
    if isinstance(q.source, DataFrame):
        df = q.source
    elif q.source.startswith("Rule:"):
        args = {n[0]: syntax.Parser(v).literal().value for n, v in map(syntax.assignment, _lines(q.filter))}
        return sources.call(spark, q.source[5:].strip(), **args)
    elif q.source == "Expression":
        return _of_expression(spark, q)
    elif q.source == "ResourceObject":
        head, *more = _lines(q.filter)
        application, _, kind = (x.strip() for x in head.partition(":"))
        return sources.resources(spark, application, kind, **{n.strip(): v.strip() for n, _, v in (line.partition("=") for line in more)})
    else:
        df = spark.table(q.source) if "/" not in q.source else spark.read.parquet(q.source)
    if q.filter:
        df = df.where(sources.compile_filter(expand(q.filter, q.macros)))
    return df.orderBy(*sources.sort_keys(*q.ordering.split(","))) if q.ordering else df


def _of_expression(spark: SparkSession, q: Query) -> DataFrame:
    """The elements of an expression's result: objects as rows, other values in one column."""
    s = expr.of(spark.range(1).select(), parameters=q.parameters, catalog=q.catalog)
    items = expr.collection(expr.compile_expr(q.filter, s, q.macros))
    df = s.frame[0].select(F.explode(items.column).alias("value"))
    return df.select("value.*") if df.schema[0].dataType.typeName() == "struct" else df


def _numbered(df: DataFrame) -> DataFrame:
    """Rows numbered as the source gives them, before lookups can move them: the order of a group's cells."""
    return df.withColumn("_order", F.monotonically_increasing_id())


def plan(spark: SparkSession, q: Query) -> tuple[DataFrame, list[str]]:
    """The result's rows, and the key columns if it is grouped."""
    df = _source(spark, q)
    more = {"parameters": q.parameters, "catalog": q.catalog}

    def scope(frame: DataFrame) -> expr.Scope:
        s = expr.of(frame, q.type_name, **more)
        return s

    rules = flags = None
    order = ["_order"] if q.grouping and q.output else []
    if order and not q.subquery:
        df = _numbered(df)
    if q.selector:
        rules, _ = compile_rules(q.selector, scope(df), macros=q.macros) if not q.subquery else (None, None)
        if q.subquery:
            heads, _ = compile_rules(_headers_only(expand(q.selector, q.macros)), scope(df))
            flags = {f"_rule{k}": r.applies for k, r in enumerate(heads)}
            df = df.withColumns(flags).where(" OR ".join(flags))
    if q.subquery:
        names, source = syntax.assignment(q.subquery)
        name = names[0] if names else "item"
        s = scope(_numbered(df) if order else df)
        items = expr.collection(expr.compile_expr(source, s, q.macros))
        if order:
            order.append("_place")
            df = s.frame[0].select("*", F.posexplode(items.column).alias("_place", name))
        else:
            df = s.frame[0].select("*", F.explode(items.column).alias(name))
    for block in filter(str.strip, q.computations.split("\n\n")):
        s = scope(df)
        if block.lstrip().startswith("Attribute("):
            found, _ = compile_rules(block, s, macros=q.macros, values=True)
            df = evaluate(s.frame[0], found)
            continue
        columns = {}
        for line in _lines(block):
            names, source = syntax.assignment(expand(line, q.macros))
            value = expr.compile_expr(source, s)
            for i, n in enumerate(names):
                columns[n] = value.column if len(names) == 1 else F.try_element_at(value.column, F.lit(i + 1))
        df = s.frame[0].withColumns(columns)
    if q.selector:
        s = scope(df)
        if q.subquery:
            rules, _ = compile_rules(_actions_only(expand(q.selector, q.macros)), s)
        else:
            rules, _ = compile_rules(q.selector, s, macros=q.macros)
        df = s.frame[0].withColumn("_decision", decision(rules, [F.col(f) for f in flags] if flags else None)).where(sure(F.col("_decision.accept")))
        df = df.drop(*(flags or ()))
    if q.max_rows:
        df = df.limit(q.max_rows)
    if not q.grouping:
        return (expr.select_text(df, *_lines(q.output), name=q.type_name, macros=q.macros, **more) if q.output else df), []
    s, keys = scope(df), []
    columns = {}
    for i, line in enumerate(_lines(q.grouping)):
        names, source = syntax.assignment(expand(line, q.macros))
        keys.append(names[0] if names else f"key{i + 1}")
        columns[keys[-1]] = expr.compile_expr(source, s).column
    cell = expr.compile_expr(q.output, s, q.macros) if q.output else None
    df = s.frame[0].select(*(c.alias(k) for k, c in columns.items()), *([cell.column.alias("_cell")] if cell else []), *order)
    if cell:
        value = F.transform(F.array_sort(F.collect_list(F.struct(*order, "_cell"))), lambda x: x["_cell"])
    else:
        value = F.count("*")
    df = df.groupBy(*keys).agg(value.alias("value"))
    df, keys = transform(df, keys, q.postprocessing)
    return df.orderBy(*(F.col(k).asc_nulls_first() for k in keys)), keys


def _headers_only(text: str) -> str:
    from arbora.lang.rules import call

    out, text = [], syntax.without_comments(text).strip()
    while text:
        tag, args, text = call(text)
        out.append(f"{tag}({', '.join(args)})" if tag != "config" else "")
        while text.lstrip().startswith("."):
            _, _, text = call(text.lstrip()[1:])
        text = text.lstrip().removeprefix(";").lstrip()
    return "\n".join(out)


def _actions_only(text: str) -> str:
    """The rules with their identifiers and actions, headers left out (they are flags by then)."""
    from arbora.lang.rules import _arguments, call

    out, text = [], syntax.without_comments(text).strip()
    while text:
        tag, args, text = call(text)
        if tag != "config":
            id_, _ = _arguments(args)
            line = f'{tag}("{id_}")' if id_ else f"{tag}()"
            while text.lstrip().startswith("."):
                kind, inner, text = call(text.lstrip()[1:])
                line += f".{kind}({', '.join(inner)})"
            out.append(line)
        text = text.lstrip().removeprefix(";").lstrip()
    return "\n".join(out)


def run(spark: SparkSession, q: Query) -> str:
    """The rendered result, below its title if it has one."""
    return (f"<h1>{tables.escape(q.title)}</h1>" if q.title else "") + _rendered(*plan(spark, q), q)


def save(spark: SparkSession, q: Query, path: str) -> None:
    """The result as files: ungrouped rows by Spark's CSV writer, whatever their number, groups as rendered."""
    df, keys = plan(spark, q)
    if not keys:
        return tables.write_csv(df, path)
    text = (f"<h1>{tables.escape(q.title)}</h1>" if q.title else "") + _rendered(df, keys, q)
    spark.createDataFrame([(text,)], ["value"]).coalesce(1).write.text(path)


def _rendered(df: DataFrame, keys: list[str], q: Query) -> str:
    if not keys:
        return tables.html_table(df)
    cells = tables.tree(df, keys, "value")
    rotate, totals = "rotate" in q.layout, "total" in q.layout
    if len(keys) > 1 and q.layout.startswith("Matrix"):
        return tables.matrix(_paired(cells, len(keys)), totals, rotate)
    if len(keys) > 1 and q.layout.startswith("Multiple matrices"):
        return tables.sections(cells, len(keys) - 2, lambda c: tables.matrix(c, totals, rotate), captions=q.max_captions)
    if q.layout.startswith("Multiple tables"):
        return tables.sections(cells, len(keys) - 1, lambda c: tables.matrix({k: {"": v} for k, v in c.items()}), captions=q.max_captions)
    return tables.pprint(cells)


def _paired(cells: dict, depth: int) -> dict:
    """Deeper levels under one row's key."""
    if depth == 2:
        return cells
    return {f"{k} / {k2}": v2 for k, v in cells.items() for k2, v2 in _paired(v, depth - 1).items()}
