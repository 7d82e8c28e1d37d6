"""Output of collected rows: CSV, HTML tables, matrices with totals, sections, indented text.

Rendering is the last step and runs on the driver over ``toLocalIterator``, so that one
partition is held at a time; ``most`` guards the size of what is rendered.
"""

from __future__ import annotations

import datetime as dt
import html
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 100_000


class Html(str):
    """A text that is escaped already; ``number`` is what totals add up."""

    number: float | None = None

    def __new__(cls, text: str, number: float | None = None):
        out = super().__new__(cls, text)
        out.number = number
        return out


def escape(v) -> str:
    return v if isinstance(v, Html) else "" if v is None else html.escape(text(v), quote=True)


def text(v) -> str:
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def rows(df: DataFrame, most: int = MOST) -> Iterable[tuple]:
    for i, r in enumerate(df.toLocalIterator()):
        if i >= most:
            raise ValueError(f"more than {most} rows to render; write a file instead")
        yield tuple(r)


def csv_lines(df: DataFrame, separator: str = ",", quote: str = '"', header: bool = True, header_prefix: str = "", most: int = MOST) -> Iterable[str]:
    """Texts in quotes (doubled inside), moments by ISO, null as nothing."""

    def cell(v) -> str:
        if isinstance(v, str):
            return f"{quote}{v.replace(quote, quote * 2)}{quote}"
        return v.strftime("%Y-%m-%dT%H:%M:%S") if isinstance(v, dt.datetime) else text(v)

    if header:
        yield header_prefix + separator.join(cell(c) for c in df.columns)
    for r in rows(df, most):
        yield separator.join(map(cell, r))


def write_csv(df: DataFrame, path: str, separator: str = ",", header: bool = True) -> None:
    """The same layout by Spark's writer, for results of any size."""
    cols = [F.when(F.col(c).isNotNull(), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.csv(path, sep=separator, header=header, escape='"', nullValue="", emptyValue='""')


def html_table(df: DataFrame, horizontal: bool = False, most: int = MOST) -> str:
    """Names on top, or with ``horizontal`` at the left, a column for each row."""
    data = list(rows(df, most))
    if horizontal:
        body = "".join(f"<tr><th>{escape(c)}</th>{''.join(f'<td>{escape(r[i])}</td>' for r in data)}</tr>" for i, c in enumerate(df.columns))
        return f"<table>{body}</table>"
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join(f"<tr>{''.join(f'<td>{escape(v)}</td>' for v in r)}</tr>" for r in data)
    return f"<table><tr>{head}</tr>{body}</table>"


def tree(df: DataFrame, keys: list[str], value: str, most: int = MOST) -> dict:
    """Long form to nested dicts, in the order of the rows."""
    out: dict = {}
    for r in rows(df.select(*keys, value), most):
        at = out
        for k in r[:-2]:
            at = at.setdefault(k, {})
        at[r[-2]] = r[-1]
    return out


def number(v) -> float | int | None:
    if isinstance(v, Html):
        return v.number
    return v if isinstance(v, int | float) and not isinstance(v, bool) else len(v) if isinstance(v, list | tuple) else None


def total(values: list) -> str:
    numbers = [n for n in map(number, values) if n is not None]
    if not numbers:
        return ""
    s = sum(numbers)
    return str(s) if all(isinstance(n, int) for n in numbers) else f"{s:.2f}"


def matrix(cells: dict, totals: bool = False, rotate: bool = False, mapper: Callable | None = None) -> str:
    """Rows by first keys, columns by the union of second keys; row and grand totals with several columns."""
    if rotate:
        turned: dict = {}
        for r, cols in cells.items():
            for c, v in cols.items():
                turned.setdefault(c, {})[r] = v
        cells = turned
    columns = list(dict.fromkeys(c for cols in cells.values() for c in cols))
    show = mapper or (lambda v: Html("<br>".join(map(escape, v))) if isinstance(v, list | tuple) else v)
    wide = totals and len(columns) > 1
    lines = ["<tr><th></th>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + ("<th>Total</th>" if wide else "") + "</tr>"]
    for r, cols in cells.items():
        line = f"<th>{escape(r)}</th>" + "".join(f"<td>{escape(show(cols[c])) if c in cols else ''}</td>" for c in columns)
        lines.append(f"<tr>{line}{f'<td>{total(list(cols.values()))}</td>' if wide else ''}</tr>")
    if totals:
        sums = "".join(f"<td>{total([cols[c] for cols in cells.values() if c in cols])}</td>" for c in columns)
        grand = f"<td>{total([v for cols in cells.values() for v in cols.values()])}</td>" if wide else ""
        lines.append(f"<tr><th>Total</th>{sums}{grand}</tr>")
    return f"<table>{''.join(lines)}</table>"


def sections(cells: dict, depth: int, render: Callable[[dict], str], level: int = 2, captions: int = 6) -> str:
    """Upper levels as captions h2, h3 and so on over what is rendered of the rest."""
    if depth == 0:
        return render(cells)
    tag = f"h{min(level, captions)}"
    return "".join(f"<{tag}>{escape(k)}</{tag}>{sections(v, depth - 1, render, level + 1, captions)}" for k, v in cells.items())


def navigation(cells: dict, depth: int) -> str:
    if depth == 0:
        return ""
    return "<ul>" + "".join(f"<li>{escape(k)}{navigation(v, depth - 1)}</li>" for k, v in cells.items()) + "</ul>"


def pprint(v, indent: int = 0, step: str = "  ") -> str:
    """Nested dicts and lists as indented text."""
    pad = step * indent
    if isinstance(v, dict):
        return "\n".join(f"{pad}{text(k)}:\n{pprint(x, indent + 1, step)}" if isinstance(x, dict | list) else f"{pad}{text(k)}: {text(x)}" for k, x in v.items())
    if isinstance(v, list | tuple):
        return "\n".join(pprint(x, indent, step) if isinstance(x, dict | list) else f"{pad}{text(x)}" for x in v)
    return f"{pad}{text(v)}"
