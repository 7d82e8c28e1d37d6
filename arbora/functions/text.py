"""Text and number functions as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """A numeric text as a number: digits, digits with L, or a decimal; null if it is none of these."""
    return F.when(x.rlike(r"^[-+]?\d+L?$"), F.regexp_replace(x, "L$", "").try_cast("double")).when(x.rlike(r"^[-+]?\d*\.\d*$"), x.try_cast("double"))


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Truncating for whole numbers; null for a zero divisor."""
    return F.call_function("try_divide", a.cast("double"), b).cast("long") if whole else F.try_divide(a, b)


def repeat(x: Column, n: Column) -> Column:
    return F.call_function("repeat", x, n.cast("int"))


def group_list(pattern: str) -> list[tuple[str | None, str]]:
    """The capturing groups in order: name (or none) and what stands inside."""
    found: list[list] = []
    open_: list[int] = []
    i, in_class = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            # a bracket that comes first stands for itself
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            continue
        elif c == "(":
            named = re.match(r"\(\?<([A-Za-z]\w*)>", pattern[i:])
            if named or pattern[i + 1 : i + 2] != "?":
                found.append([named and named[1], i + (named.end() if named else 1), None])
                open_.append(len(found) - 1)
            else:
                open_.append(-1)
        elif c == ")" and (k := open_.pop()) >= 0:
            found[k][2] = i
        i += 1
    return [(name, pattern[a:z]) for name, a, z in found]


def groups(pattern: str) -> int:
    return len(group_list(pattern))


def group_names(pattern: str) -> list[str]:
    return [name for name, _ in group_list(pattern) if name]


def group_at(x: Column, pattern: str, k: int) -> Column:
    """The k-th group of the first match; null if it took no part in it.

    Spark gives an empty text for such a group, which is told from a match of nothing by whether
    the group can match nothing at all.
    """
    value, inside = F.regexp_extract(x, pattern, k), group_list(pattern)[k - 1][1]
    return F.when((value != "") | F.lit("").rlike(f"^(?:{inside})$"), value)


def match(x: Column, pattern: str) -> Column:
    """The first match: its text, its one group, a list of groups, or a map of named ones; null without a match."""
    found = group_list(pattern)
    names = [(name, k) for k, (name, _) in enumerate(found, 1) if name]
    if names:
        value = F.create_map(*(c for name, k in names for c in (F.lit(name), group_at(x, pattern, k))))
    elif not found:
        value = F.regexp_extract(x, pattern, 0)
    elif len(found) == 1:
        value = group_at(x, pattern, 1)
    else:
        value = F.array(*(group_at(x, pattern, k) for k in range(1, len(found) + 1)))
    return F.when(x.rlike(pattern), value)


def extract(x: Column, pattern: str) -> Column:
    """All matches, as texts, single groups or lists of groups; an empty list without a match."""
    n = groups(pattern)
    if n <= 1:
        return F.coalesce(F.regexp_extract_all(x, F.lit(pattern), n), F.array())
    each = [F.regexp_extract_all(x, F.lit(pattern), i + 1).alias(f"g{i + 1}") for i in range(n)]
    return F.transform(F.arrays_zip(*each), lambda s: F.array(*(s[f"g{i + 1}"] for i in range(n))))


def replace(x: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(x, pattern, replacement)


def join(xs: Column, glue: str = "\n") -> Column:
    """Elements as text; a null element leaves an empty place."""
    return F.array_join(F.transform(xs, lambda e: e.cast("string")), glue, "")


def as_text(x: Column, kind: str) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss") if kind.startswith(("timestamp", "date")) else x.cast("string")


def formatted(x: Column, kind: str, pattern: str | None = None, default: Column | None = None) -> Column:
    """One placeholder of a template; null gives the default, else the word null."""
    if pattern is None:
        text = as_text(x, kind)
    elif kind.startswith(("timestamp", "date")):
        text = F.date_format(x, pattern)
    else:
        text = F.when(x.isNotNull(), F.format_string(pattern if pattern.startswith("%") else f"%{pattern}", x))
    return F.coalesce(text, F.lit("null") if default is None else default)


def quoted(x: Column, kind: str) -> Column:
    """A value as a literal of a filter text; null raises."""
    if kind == "string":
        text = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"'))
    elif kind.startswith(("timestamp", "date")):
        text = F.concat(F.lit("DATE$"), F.unix_millis(x.cast("timestamp")).cast("string"))
    elif kind.startswith("array"):
        text = F.concat(F.lit("{ "), F.array_join(F.transform(x, lambda e: F.concat(F.lit('"'), e.cast("string"), F.lit('"'))), ", "), F.lit(" }"))
    else:
        text = x.cast("string")
    return F.when(x.isNull(), F.raise_error(F.lit("null cannot be quoted"))).otherwise(text)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# Standard macros.


def limit(x: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being dots."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def hard_wrap(x: Column, n: int) -> Column:
    return F.regexp_replace(x, f"(.{{{n}}})(?=.)", "$1\n")


def soft_wrap(x: Column, n: int) -> Column:
    return F.regexp_replace(x, f"(.{{1,{n}}})(\\s+|$)", "$1\n")


def abbreviate(x: Column, n: int = 3) -> Column:
    """The first n letters of each word."""
    return F.regexp_replace(x, f"\\b(\\w{{1,{n}}})\\w*", "$1")


def parse_csv(x: Column) -> Column:
    return F.transform(F.split(x, r"\s*,\s*"), F.trim)


def leading_digit_range(n: Column) -> Column:
    """The range of numbers with the same first digit and length, such as 300-399."""
    size = F.pow(F.lit(10), F.length(n.cast("string")) - 1).cast("long")
    low = F.floor(n / size) * size
    return F.concat(low.cast("string"), F.lit("-"), (low + size - 1).cast("string"))


def duration(ms: Column) -> Column:
    """Milliseconds as days, hours, minutes and seconds: 1d 02:03:04."""
    s = F.floor(ms / 1000)
    return F.concat(F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d "))).otherwise(""), F.format_string("%02d:%02d:%02d", F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60))


def clob(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
