"""Filter texts of table scans, such as ``name.startsWith("A") && !(age < 3 || city.in({"x", "y"}))``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<date>DATE\$-?\d+)|(?P<number>[-+]?\d+(?:\.\d+)?)|(?P<op>&&|\|\||==|!=|<=|>=|[!<>(){},.])|(?P<name>[A-Za-z_]\w*))')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read the filter at: {text[at:at + 20]}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def take(self, expected: str = "") -> tuple[str, str]:
        t = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if expected and t[1] != expected:
            raise ValueError(f"expected {expected}, found {t[1] or 'the end'}")
        self.at += 1
        return t

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() == "&&":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.peek() == "!":
            self.take()
            return ~F.coalesce(self.one(), F.lit(False))
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        name = self.take()[1]
        while self.peek() == "." and self.peek(2) != "(":
            self.take()
            name += "." + self.take()[1]
        x = F.col(name)
        if self.peek() == ".":
            self.take()
            return self.method(x)
        op = self.take()[1]
        kind, v = self.take()
        if v == "null":
            return x.isNull() if op == "==" else x.isNotNull()
        v = self.value(kind, v)
        return {"==": x == v, "!=": x != v, "<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]

    def method(self, x: Column) -> Column:
        name = self.take()[1]
        self.take("(")
        values = []
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                values.append(self.value(*self.take()))
                if self.peek() == ",":
                    self.take()
            self.take("}")
        elif self.peek() != ")":
            values.append(self.value(*self.take()))
        self.take(")")
        if name == "in":
            return x.isin(*values) if values else F.lit(False)
        if name in ("isNull", "notNull"):
            return x.isNull() if name == "isNull" else x.isNotNull()
        return {"startsWith": x.startswith, "endsWith": x.endswith, "contains": x.contains}[name](values[0])

    def value(self, kind: str, v: str):
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", v[1:-1]))
        if kind == "date":
            return F.timestamp_millis(F.lit(int(v[5:])))
        if kind == "number":
            return F.lit(float(v) if "." in v else int(v))
        return F.lit({"true": True, "false": False}[v])


def compile_filter(text: str) -> Column:
    p = _Parser(text)
    out = p.either()
    if p.at < len(p.tokens):
        raise ValueError(f"unexpected {p.peek()}")
    return out
