"""Selector and rule texts to predicates and decisions.

    ruleset  := ['config' '(' entry, ... ')'] rule*
    rule     := TAG '(' [id ','] selector, ... ')' ('.' action)*
    action   := ('accept'|'when'|'reject'|'fail') '(' ["id" ','] selector, ... ')'
    selector := NAME '(' args ')'
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.lang import syntax
from arbora.lang.expr import Scope, Value, collection, compile_expr
from arbora.lang.macros import expand
from arbora.operators import predicates as P
from arbora.operators.select import Action, Rule

VALUES = {"eq", "ne", "in", "notin", "gt", "ge", "lt", "le", "between", "outside", "like", "unlike"}
COLLECTIONS = {"any", "none", "all", "notall", "mt", "me", "ft", "fe", "num"}
LOGIC = {"and": P.and_, "or": P.or_, "not": P.not_, "nand": P.nand, "nor": P.nor}
CALL = re.compile(r"\s*([A-Za-z_]\w*)\s*\(", re.S)


def call(text: str) -> tuple[str, list[str], str]:
    """Name, arguments and what follows of ``name(args)...``."""
    m = CALL.match(text)
    if not m:
        raise ValueError(f"cannot read: {text}")
    p = syntax.Parser(text)
    p.at = m.end()
    raw = p.raw()
    return m[1], syntax.split(raw), text[p.at :]


def constant(text: str, scope: Scope):
    if text.startswith("ref(") or text.startswith("ref ("):
        _, (inner,), _ = call(text)
        return P.Ref(compile_expr(_unquoted(inner), scope).column)
    literal = syntax.Parser(text).literal()
    if literal is None:
        raise ValueError(f"not a value: {text}")
    return literal.value


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1]) if len(text) > 1 and text[0] == text[-1] == '"' else text


def compile_selector(text: str, scope: Scope) -> Column:
    """One selector, or several separated by commas, all of which must hold."""
    parts = syntax.split(text)
    return P.all_of(_one(p, scope) for p in parts)


def _one(text: str, scope: Scope) -> Column:
    name, args, _ = call(text)
    if name in LOGIC:
        return LOGIC[name](*(_one(a, scope) for a in args))
    x = compile_expr(_unquoted(args[0]) or "@", scope)
    if name in ("in", "notin"):
        xs = collection(compile_expr(_unquoted(args[1]), scope))
        return (P.in_ if name == "in" else P.notin)(x.column, xs.column)
    if name in VALUES:
        return getattr(P, name)(x.column, *(constant(a, scope) for a in args[1:]))
    if name in COLLECTIONS:
        xs = collection(x)
        counts = {"num": 2, "mt": 1, "me": 1, "ft": 1, "fe": 1}.get(name, 0)
        selectors = [lambda e, a=a: _one(a, scope.inner(Value(e, xs.type.elementType))) for a in args[1 + counts :]]
        f = getattr(P, {"any": "any_", "all": "all_"}.get(name, name))
        return f(xs.column, *(int(a) for a in args[1 : 1 + counts]), *selectors)
    raise ValueError(f"no selector {name}")


def _arguments(args: list[str]) -> tuple[str | None, list[str]]:
    """An identifier in front, if there is one, and the selectors."""
    if args and not CALL.match(args[0]):
        return _unquoted(args[0]), args[1:]
    return None, args


def config(args: list[str]) -> dict:
    out = {}
    for a in args:
        name, inner, _ = call(a)
        if inner and CALL.match(inner[0]):
            out[name] = config(inner)
        else:
            values = [syntax.Parser(i).literal() for i in inner]
            values = [i if v is None else v.value for i, v in zip(inner, values, strict=True)]
            out[name] = values[0] if len(values) == 1 else values
    return out


def compile_rules(text: str, scope: Scope, action_scope: Scope | None = None, macros: dict | None = None, values: bool = False) -> tuple[list[Rule], dict]:
    """Rules and settings. ``action_scope``: what actions see, if not what headers see.

    ``values``: an action's identifier is an expression for the value, not a text.
    """
    text = syntax.without_comments(expand(text, macros or {})).strip()
    rules, settings = [], {}
    while text:
        tag, args, text = call(text)
        if tag == "config":
            settings = config(args)
        else:
            id_, headers = _arguments(args)
            rule = Rule([_one(h, scope) for h in headers], [], id_)
            while text.lstrip().startswith("."):
                kind, args, text = call(text.lstrip()[1:])
                id_, tests = _arguments(args)
                inner = action_scope or scope
                value = compile_expr(id_, inner).column if values and id_ and kind in ("accept", "when") else None
                rule.actions.append(Action(kind in ("accept", "when"), [_one(t, inner) for t in tests], id_, value))
            rules.append(rule)
        text = text.lstrip().removeprefix(";").lstrip()
    return rules, settings


def literal(value) -> Column:
    return F.lit(value)
