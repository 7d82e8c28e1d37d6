"""HTML of values inside a row, as Columns: links, tables of collections, grids of nested maps, bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions import color, text

WIDTH = 1000


def _text(c: Column, kind: T.DataType) -> Column:
    return text.html_escape(F.coalesce(text.as_text(c, kind.simpleString()), F.lit("")))


def _wrap(tag: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag.split()[0]}>"))


def let(x: Column, f) -> Column:
    """f of x, which is computed once: inside lambdas Spark computes an expression wherever it stands."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _joined(xs: Column) -> Column:
    return F.array_join(xs, "")


def link(url: Column, label: Column, hint: Column | None = None, style: Column | None = None) -> Column:
    """An anchor; a span for the address ``#``, a label for ``-``; a tooltip by hint, with an id from its content.

    A style without a colon is a colour; an empty label is a dot. Label and hint are escaped already.
    """
    look = F.lit("")
    if style is not None:
        full = F.when(style.contains(":"), style).otherwise(F.concat(F.lit("color: "), style, F.lit(";")))
        look = F.when(style == "", F.lit("")).otherwise(F.concat(F.lit(' style="'), full, F.lit('"')))
    shown = F.when(label == "", F.lit("⬤")).otherwise(label)
    own = F.md5(F.concat_ws("\n", url, label, hint if hint is not None else F.lit("")))
    toggle = F.concat(F.lit(' for="'), own, F.lit('"'))
    out = (
        F.when(url == "#", F.concat(F.lit("<span"), look, F.lit(">"), shown, F.lit("</span>")))
        .when(url == "-", F.concat(F.lit("<label"), look, toggle, F.lit(">"), shown, F.lit("</label>")))
        .otherwise(F.concat(F.lit("<a"), look, F.lit(' href="'), url, F.lit('" target="_blank">'), shown, F.lit("</a>")))
    )
    if hint is None:
        return out
    control = F.when(url == "-", F.lit("")).otherwise(F.concat(F.lit("<label"), look, toggle, F.lit("></label>")))
    tip = F.concat(F.lit('<span class="pinnable-tooltip-container">'), out, F.lit('<input type="checkbox" id="'), own, F.lit('">'), control, F.lit('<div class="pinnable-tooltip-content">'), hint, F.lit("</div></span>"))
    return F.when(hint == "", out).otherwise(tip)


def table(xs: Column, kind: T.DataType, horizontal: bool = False) -> Column:
    """A collection as a table: fields of objects as columns (rows if horizontal), other values as one column."""
    fields = [(f.name, f.dataType) for f in kind.fields] if isinstance(kind, T.StructType) else [(None, kind)]

    def cell(e: Column, name: str | None, t: T.DataType) -> Column:
        return _wrap("td", _text(e if name is None else e[name], t))

    def line(name: str | None, t: T.DataType) -> Column:
        return _wrap("tr", F.lit("" if name is None else f"<th>{name}</th>"), _joined(F.transform(xs, lambda e: cell(e, name, t))))

    if horizontal:
        return _wrap("table", *(line(*f) for f in fields))
    head = [] if fields[0][0] is None else [F.lit("<tr>" + "".join(f"<th>{n}</th>" for n, _ in fields) + "</tr>")]
    return _wrap("table", *head, _joined(F.transform(xs, lambda e: _wrap("tr", *(cell(e, n, t) for n, t in fields)))))


def grid(m: Column, kind: T.MapType, totals: bool = False) -> Column:
    """A map of maps as a matrix: all keys of the inner maps in order as columns; sums if asked for.

    The map is computed once, and each of its cells is looked up once.
    """
    inner = kind.valueType

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("double"), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))

    def shown(x: Column) -> Column:
        return _wrap("td", F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")))

    def laid_out(x: Column) -> Column:
        rows, columns = x["rows"], x["columns"]
        cells = F.transform(rows, lambda r: let(F.try_element_at(x["m"], r), lambda own: F.transform(columns, lambda c: F.try_element_at(own, c))))
        return let(cells, lambda cells: drawn(rows, columns, cells))

    def drawn(rows: Column, columns: Column, cells: Column) -> Column:
        head = F.concat(F.lit("<tr><th></th>"), _joined(F.transform(columns, lambda c: _wrap("th", _text(c, inner.keyType)))), F.lit("<th>Total</th></tr>" if totals else "</tr>"))
        body = _joined(F.zip_with(rows, cells, lambda r, own: _wrap(
            "tr", _wrap("th", _text(r, kind.keyType)), _joined(F.transform(own, lambda n: _wrap("td", _text(n, inner.valueType)))),
            *([shown(total(own))] if totals else []),
        )))
        if not totals:
            return _wrap("table", head, body)
        sums = F.transform(columns, lambda _, i: shown(total(F.transform(cells, lambda own: F.get(own, i)))))
        return _wrap("table", head, body, _wrap("tr", F.lit("<th>Total</th>"), _joined(sums), shown(total(F.flatten(cells)))))

    parts = let(m, lambda m: F.struct(m.alias("m"), F.array_sort(F.map_keys(m)).alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_values(m), F.map_keys)))).alias("columns")))
    return let(parts, laid_out)


def bars(series: dict[str, Column], scale: float = 1.0, overlaid: bool = False, shown: dict[str, Column] | None = None) -> Column:
    """One bar for each label, beside each other or from one origin; together at most 1000 units wide.

    A tooltip tells the value, or what ``shown`` has for its label.
    """
    told = series | (shown or {})
    values = {k: F.greatest(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(0.0)) for k, v in series.items()}
    most = (F.greatest(*values.values()) if len(values) > 1 else next(iter(values.values()))) if overlaid else reduce(lambda a, b: a + b, values.values())
    fit = F.least(F.lit(float(scale)), F.coalesce(F.try_divide(F.lit(float(WIDTH)), most), F.lit(float(scale))))
    form = "position:absolute;left:0;" if overlaid else "display:inline-block;"
    return F.concat(*(
        F.concat(F.lit(f'<span style="{form}width:'), F.round(v * fit).cast("int").cast("string"), F.lit("px;background:"), color.auto(F.lit(k)), F.lit(f'" title="{k}: '), F.coalesce(told[k].cast("string"), F.lit("")), F.lit('">&nbsp;</span>'))
        for k, v in values.items()
    ))
