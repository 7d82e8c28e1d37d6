"""Expression trees to Columns, typed by the schema and scoped by the iteration.

A scope is a stack of levels, the current object last; ``^`` goes up it. Types are known while
compiling, so that a collection is told from a scalar, text from numbers, and whole from
decimal arithmetic, and no function runs row by row in Python. A lookup adds a join to the
frame the expression is compiled for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions import color, text, time
from arbora.lang import syntax
from arbora.lang.filters import compile_filter
from arbora.lang.macros import expand
from arbora.operators import keyed, lookup, ordered
from arbora.operators.ordered import sort_array
from arbora.operators.select import partition, select, switch
from arbora.render import columns

NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOMENT = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Value:
    column: Column
    type: T.DataType

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)


@dataclass
class Scope:
    """``levels``: (type name, value) from the root down; ``parameters`` for ``env``."""

    levels: list[tuple[str, Value]]
    parameters: dict = field(default_factory=dict)
    catalog: dict = field(default_factory=dict)
    frame: list = field(default_factory=list)  # the DataFrame, if lookups may join to it
    cache: dict = field(default_factory=dict)
    order: tuple[list[str], list[Column]] | None = None  # keys and order of rows, for what looks back
    iteration: tuple[Scope, Value] | None = None  # the scope with a frame, and the collection this one is an element of
    lookups: dict = field(default_factory=dict)

    def inner(self, v: Value, name: str = "", of: Value | None = None) -> Scope:
        return Scope([*self.levels, (name, v)], self.parameters, self.catalog, [], self.cache, self.order, (self, of) if of and self.frame else None)

    @property
    def this(self) -> Value:
        return self.levels[-1][1]


@dataclass
class Entity:
    """What a lookup by name joins: a table, its id and its name column."""

    rows: DataFrame
    id: str
    name: str


def null() -> Value:
    return Value(F.lit(None), T.NullType())


def of(df: DataFrame, name: str = "", **more) -> Scope:
    return Scope([(name, Value(None, df.schema))], frame=[df], **more)


def collection(v: Value) -> Value:
    """null is empty, a map its entries, a scalar a singleton; by the type."""
    if v.is_array:
        return Value(F.coalesce(v.column, F.array().cast(v.type.simpleString())), v.type)
    if isinstance(v.type, T.MapType):
        entry = T.StructType().add("key", v.type.keyType).add("value", v.type.valueType)
        return Value(F.coalesce(F.map_entries(v.column), F.array()), T.ArrayType(entry))
    kind = T.ArrayType(v.type)
    return Value(F.when(v.column.isNull(), F.array().cast(kind.simpleString())).otherwise(F.array(v.column)), kind)


def compile_expr(source: str, scope: Scope, macros: dict[str, str] | None = None) -> Value:
    return lower(syntax.parse(expand(source, macros or {})), scope)


def lower(node, scope: Scope) -> Value:
    if isinstance(node, syntax.Alternatives):
        values = [v for v in (lower(o, scope) for o in node.options) if not isinstance(v.type, T.NullType)]
        if not values:
            return null()
        kind = values[0].type
        return Value(F.coalesce(*(v.column.cast(kind) if v.type != kind else v.column for v in values)), kind)
    if isinstance(node, syntax.Operation):
        return operate(node.op, lower(node.left, scope), lower(node.right, scope))
    return chain(node, scope)


def chain(node: syntax.Chain, scope: Scope) -> Value:
    value, conditions, parent = scope.this, [], len(scope.levels) - 1
    for i, part in enumerate(node.parts):
        if isinstance(part, syntax.Literal):
            value = Value(F.lit(part.value), T.NullType() if part.kind == "void" else T.DataType.fromDDL(part.kind))
        elif isinstance(part, syntax.Group):
            value = lower(part.inner, scope if i == 0 else scope.inner(value))
        elif isinstance(part, syntax.Step):
            if part.name.startswith("^"):
                parent = up(part, scope, parent)
                value = scope.levels[parent][1] if parent >= 0 else null()
            elif part.name in ("@", "@@"):
                value = scope.this if i == 0 else value
            else:
                value = attribute(value, part, scope)
        else:
            if value.column is not None and i:
                conditions.append(value.column)
            after = node.parts[i + 1] if i + 1 < len(node.parts) else None
            value = instruct(value, part, scope, after.name if isinstance(after, syntax.Step) else None)
    if value.column is None and isinstance(value.type, T.StructType):
        value = Value(F.struct(*value.type.names), value.type)
    # a chain stops at null, whatever its instructions would make of one
    if conditions and not isinstance(value.type, T.NullType):
        present = conditions[0].isNotNull()
        for c in conditions[1:]:
            present = present & c.isNotNull()
        value = Value(F.when(present, value.column), value.type)
    return value


def up(step: syntax.Step, scope: Scope, at: int) -> int:
    mark, name = ("^^", step.name[2:]) if step.name.startswith("^^") else ("^", step.name[1:])
    if mark == "^" and not name:
        found = at - 1
    elif mark == "^^" and not name:
        found = 0
    else:
        hits = [k for k in range(at) if scope.levels[k][0] == name]
        found = (hits[-1] if mark == "^" else hits[0]) if hits else -1
    if found < 0 and not step.optional:
        raise ValueError(f"{step.name} has no parent")
    return found


def attribute(v: Value, step: syntax.Step, scope: Scope) -> Value:
    t = v.type
    if isinstance(t, T.StructType):
        if step.name in t.names:
            column = F.col(f"`{step.name}`") if v.column is None else v.column.getField(step.name)
            out = Value(column, t[step.name].dataType)
            if step.argument is not None:
                out = Value(F.try_element_at(out.column, lower(step.argument, scope).column), out.type.valueType if isinstance(out.type, T.MapType) else out.type.elementType)
            return out
        extended = next((f for f in t.fields if f.name == "attributes" and isinstance(f.dataType, T.MapType)), None)
        if extended is not None:
            column = F.col("attributes") if v.column is None else v.column.getField("attributes")
            return Value(F.try_element_at(column, F.lit(step.name)), extended.dataType.valueType)
    elif isinstance(t, T.MapType):
        return Value(F.try_element_at(v.column, F.lit(step.name)), t.valueType)
    elif isinstance(t, T.NullType):
        return null()
    if step.optional:
        return null()
    raise ValueError(f"no attribute {step.name} in {t.simpleString()}")


def numeric(v: Value) -> Value:
    """A text in an arithmetic place is a number, if it reads as one."""
    return Value(text.number(v.column), T.DoubleType()) if isinstance(v.type, T.StringType) else v


def operate(op: str, a: Value, b: Value) -> Value:
    if op in ("==", "!="):
        if isinstance(a.type, T.StringType) and isinstance(b.type, NUMBER):
            a = numeric(a)
        elif isinstance(b.type, T.StringType) and isinstance(a.type, NUMBER):
            b = numeric(b)
        same = a.column.eqNullSafe(b.column)
        return Value(same if op == "==" else ~same, T.BooleanType())
    if op in ("<", "<=", ">", ">="):
        return Value({"<": a.column < b.column, "<=": a.column <= b.column, ">": a.column > b.column, ">=": a.column >= b.column}[op], T.BooleanType())
    if isinstance(a.type, MOMENT) or isinstance(b.type, MOMENT):
        if isinstance(a.type, MOMENT) and isinstance(b.type, MOMENT):
            return Value(time.seconds_between(a.column, b.column), T.LongType())
        moment, n = (a, b) if isinstance(a.type, MOMENT) else (b, a)
        sign = -n.column if op == "-" else n.column
        move = time.plus_millis if isinstance(n.type, T.LongType) else time.plus_seconds
        return Value(move(moment.column, sign), T.TimestampType())
    if op == "*" and isinstance(a.type, T.StringType) != isinstance(b.type, T.StringType):
        s, n = (a, b) if isinstance(a.type, T.StringType) else (b, a)
        return Value(text.repeat(s.column, n.column), T.StringType())
    a, b = numeric(a), numeric(b)
    whole = isinstance(a.type, WHOLE) and isinstance(b.type, WHOLE)
    kind = T.LongType() if whole else T.DoubleType()
    x, y = a.column.cast(kind), b.column.cast(kind)
    if op == "/":
        return Value(F.call_function("try_divide", x, y).cast(kind) if not whole else F.when(y != 0, F.call_function("div", x, y)), kind)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)


def template(source: str, scope: Scope, html: bool = False, url: bool = False) -> Value:
    """``text ${[%format,]expr[,default]} text $"expr"``; what is put in is escaped for HTML or a URL."""
    parts, at = [], 0
    while (k := source.find("$", at)) >= 0:
        if source.startswith("${", k):
            end = _closing(source, k + 2, "}")
            bits = syntax.split(source[k + 2 : end])
            pattern = bits.pop(0)[1:] if bits and bits[0].startswith("%") else None
            v = compile_expr(bits[0], scope)
            default = compile_expr(bits[1], scope).column.cast("string") if len(bits) > 1 else None
            piece = text.formatted(v.column, v.type.simpleString(), pattern, default)
            piece = text.html_escape(piece) if html else F.url_encode(piece) if url else piece
        elif source.startswith('$"', k):
            end = source.index('"', k + 2)
            v = compile_expr(source[k + 2 : end], scope)
            piece = text.quoted(v.column, v.type.simpleString())
        else:
            parts.append(F.lit(source[at : k + 1]))
            at = k + 1
            continue
        parts += [F.lit(source[at:k]), piece]
        at = end + 1
    parts.append(F.lit(source[at:]))
    return Value(F.concat(*parts), T.StringType())


def _closing(source: str, at: int, end: str) -> int:
    depth = 0
    while at < len(source):
        c = source[at]
        if c == end and not depth:
            return at
        depth += (c == "{") - (c == "}")
        at += 1
    raise ValueError(f"{source} stays open")


def _element(v: Value, scope: Scope, source: str):
    """A function of an array's element, and its type."""
    kind = v.type.elementType
    probe = compile_expr(source, scope.inner(Value(F.lit(None).cast(kind.simpleString()), kind), of=v))
    return (lambda e: compile_expr(source, scope.inner(Value(e, kind), of=v)).column), probe.type


def _selector(v: Value, scope: Scope, source: str):
    from arbora.lang.rules import compile_selector

    return lambda e: compile_selector(source, scope.inner(Value(e, v.type.elementType), of=v))


def _keys(raw: str) -> tuple[bool, list[str], str | None]:
    ordered = raw.strip().startswith(">")
    parts = syntax.split(raw.strip().removeprefix(">"), ",")
    return ordered, syntax.split(parts[0], "#"), parts[1] if len(parts) > 1 else None


def flattened(v: Value, levels: list[str], scope: Scope) -> Value:
    """Nested iteration inside a row; inner levels see outer elements as parents."""
    if deep := _RECURSION.fullmatch(levels[0]):
        return recursive(v, deep, levels[1:], scope)
    own = collection(compile_expr(levels[0], scope.inner(v) if v is not scope.this else scope))
    if len(levels) == 1:
        return own
    kind = flattened(Value(F.lit(None).cast(own.type.elementType.simpleString()), own.type.elementType), levels[1:], scope.inner(Value(F.lit(None).cast(own.type.elementType.simpleString()), own.type.elementType))).type

    def inner(e):
        element = Value(e, own.type.elementType)
        s = scope.inner(element)
        return flattened(s.this, levels[1:], s).column

    return Value(F.flatten(F.transform(own.column, inner)), kind)


#: An expression that is applied to its own results again, with the root (*) or without (+), and a limit.
_RECURSION = re.compile(r"(.*[\w)\]])\s*([*+])\s*(?:,\s*(.*))?", re.S)


def recursive(v: Value, deep: re.Match, rest: list[str], scope: Scope) -> Value:
    """Depth-first recursion over nested data: as deep as its type goes, which a schema bounds.

    A number limits the levels; a selector says which elements are given, but not expanded. Levels
    of different types keep the fields that all of them have.
    """
    source, mark, limit = deep[1], deep[2], (deep[3] or "").strip()
    most = int(limit) if limit.isdigit() else None

    def below(x: Value, s: Scope, depth: int, tested: bool = True) -> Value | None:
        """Results for everything under x; a root that is not given is not tested either."""
        if most is not None and depth >= most:
            return None
        try:
            xs = collection(compile_expr(source, s))
        except ValueError:  # the type has no such attribute: it ends here
            return None
        if isinstance(xs.type.elementType, T.NullType):
            return None
        if limit and most is None and tested:
            from arbora.lang.rules import compile_selector

            xs = Value(F.when(compile_selector(limit, s), F.array().cast(xs.type.simpleString())).otherwise(xs.column), xs.type)
        return each(xs, s, depth + 1)

    def each(xs: Value, s: Scope, depth: int) -> Value:
        kind = xs.type.elementType
        probe = Value(F.lit(None).cast(kind.simpleString()), kind)
        t = node(probe, s.inner(probe), depth).type

        def one(e):
            x = Value(e, kind)
            return node(x, s.inner(x), depth).column

        return Value(F.flatten(F.transform(xs.column, one)), t)

    def node(x: Value, s: Scope, depth: int) -> Value:
        own = flattened(x, rest, s) if rest else Value(F.array(x.column if x.column is not None else F.struct(*x.type.names)), T.ArrayType(x.type))
        more = below(x, s, depth)
        if more is None:
            return own
        t = _common(own.type.elementType, more.type.elementType)
        return Value(F.concat(_only(own, t).column, _only(more, t).column), T.ArrayType(t))

    s = scope if v is scope.this else scope.inner(v)
    if mark == "*":
        return node(v, s, 0)
    out = below(v, s, 0, tested=False)
    if out is None:
        raise ValueError(f"{source} leads nowhere from {v.type.simpleString()}")
    return out


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or not (isinstance(a, T.StructType) and isinstance(b, T.StructType)):
        return a
    return T.StructType([f for f in a.fields if any(g.name == f.name and g.dataType == f.dataType for g in b.fields)])


def _only(xs: Value, kind: T.DataType) -> Value:
    if xs.type.elementType == kind or not isinstance(kind, T.StructType):
        return xs
    return Value(F.transform(xs.column, lambda e: F.struct(*(e[n].alias(n) for n in kind.names))), T.ArrayType(kind))


def instruct(v: Value, node: syntax.Instruction, scope: Scope, wanted: str | None = None) -> Value:
    """``wanted``: the attribute that the next step takes of the result."""
    name, raw = node.name, node.raw
    kind = v.type.simpleString()
    S = T.StringType()
    if not name[:1].islower():
        return entity(v, node, scope, wanted)
    if name == "map":
        xs = collection(v)
        f, t = _element(xs, scope, raw)
        return Value(F.transform(xs.column, f), T.ArrayType(t))
    if name in ("sum", "avg", "min", "max"):
        xs = collection(v)
        if raw:
            f, t = _element(xs, scope, raw)
            xs = Value(F.transform(xs.column, f), T.ArrayType(t))
        t = xs.type.elementType
        if name == "sum":
            t = T.LongType() if isinstance(t, WHOLE) else T.DoubleType()
            return Value(keyed.array_sum(xs.column, t.simpleString()), t)
        if name == "avg":
            return Value(keyed.array_avg(xs.column), T.DoubleType())
        return Value((F.array_min if name == "min" else F.array_max)(xs.column), t)
    if name == "size":
        return Value(keyed.size_of(v.column, kind), T.IntegerType())
    if name in ("upcase", "downcase"):
        return Value((F.upper if name == "upcase" else F.lower)(v.column), S)
    if name == "join":
        return Value(text.join(collection(v).column, "\n" if raw is None else raw.replace("\\n", "\n")), S)
    if name == "select":
        xs, bits = collection(v), syntax.split(raw)
        n = int(bits.pop(0)) if bits and bits[0].isdigit() else None
        out = select(xs.column, _selector(xs, scope, ", ".join(bits)) if bits else None, n)
        return Value(out, xs.type.elementType if n == 1 else xs.type)
    if name == "sort":
        xs = collection(v)
        column = xs.column
        for key in reversed(syntax.split(raw or "") or [""]):  # stable, so from the last key to the first
            desc = key.endswith(" desc")
            key = key.removesuffix(" desc")
            column = sort_array(column, _element(xs, scope, key)[0] if key else None, desc)
        return Value(column, xs.type)
    if name in ("count", "group", "index"):
        return keyed_map(name, collection(v), raw, scope)
    if name == "get":
        out = v
        for k in node.args:
            out = Value(F.try_element_at(out.column, compile_expr(k, scope).column), out.type.valueType if isinstance(out.type, T.MapType) else out.type.elementType)
        return out
    if name == "union":
        parts = [collection(compile_expr(a, scope if v is scope.this else scope.inner(v))) for a in node.args]
        return Value(F.filter(F.concat(*(p.column for p in parts)), lambda e: e.isNotNull()), parts[0].type)
    if name == "construct":
        return constructed(v, node.args, scope)
    if name == "flatten":
        return flattened(v, syntax.split(raw, "#"), scope)
    if name in ("switch", "partition"):
        return branched(name, v, node.args, scope)
    if name == "match":
        names, n = text.group_names(raw), text.groups(raw)
        return Value(text.match(v.column, raw), T.MapType(S, S) if names else S if n <= 1 else T.ArrayType(S))
    if name == "extract":
        return Value(text.extract(v.column, raw), T.ArrayType(S if text.groups(raw) <= 1 else T.ArrayType(S)))
    if name == "replace":
        pattern, _, to = raw.partition(",")
        return Value(text.replace(v.column, pattern, to), S)
    if name in ("format", "html"):
        return template(raw or "", scope if v is scope.this else scope.inner(v), name == "html")
    if name == "link":
        bits = syntax.split(raw or "")
        if len(bits) < 2:
            raise ValueError("a link needs an address and a text")
        inner = scope if v is scope.this else scope.inner(v)
        parts = [template(b, inner, html=k in (1, 2), url=k == 0).column for k, b in enumerate(bits[:4])]
        return Value(columns.link(*parts), S)
    if name in ("table", "htable"):
        xs = collection(v)
        return Value(columns.table(xs.column, xs.type.elementType, name == "htable"), S)
    if name == "grid":
        if not (isinstance(v.type, T.MapType) and isinstance(v.type.valueType, T.MapType)):
            raise ValueError(f"a grid needs a map of maps, not {kind}")
        return Value(columns.grid(v.column, v.type, (raw or "").strip() == "total"), S)
    if name in ("barchart", "linechart"):
        inner, scale, series = scope if v is scope.this else scope.inner(v), 1.0, {}
        for k, bit in enumerate(syntax.split(raw or "")):
            names, source = syntax.assignment(bit)
            if not k and not names and re.fullmatch(r"\d+(\.\d+)?", bit):
                scale = float(bit)
            else:
                series[names[0] if names else source] = compile_expr(source, inner).column
        return Value(columns.bars(series, scale, name == "linechart"), S)
    if name == "env":
        p = scope.parameters.get(raw)
        return null() if p is None else Value(F.lit(p), T.StringType() if isinstance(p, str) else T.DoubleType() if isinstance(p, float) else T.BooleanType() if isinstance(p, bool) else T.LongType())
    if name == "now":
        return Value(time.now(raw or ""), T.TimestampType())
    if name == "date":
        if not raw:
            return Value(F.timestamp_millis(v.column.cast("long")), T.TimestampType())
        if raw[:1].isdigit():
            return Value(time.literal(raw), T.TimestampType())
        if raw[:1] in "+-":
            return Value(time.moved(v.column, raw), T.TimestampType())
        return Value(time.parse(v.column.cast("string"), raw), T.TimestampType())
    if name == "heat":
        stops = [s.partition("=") for s in syntax.split(raw or "")]
        return Value(color.heat(v.column, tuple((c.strip(), float(n or 100 * i)) for i, (c, _, n) in enumerate(stops)) or color.DEFAULT), S)
    if name in ("cache", "recache", "swapcache"):
        return kept(name, raw, scope)
    if name == "pprint":
        return Value(F.to_json(v.column, {"pretty": "true"}), S)
    if name == "toXml":
        if not isinstance(v.type, T.StructType):
            raise ValueError(f"toXml needs an object, not {kind}")
        column = F.struct(*v.type.names) if v.column is None else v.column
        return Value(F.to_xml(column, {"rowTag": raw or "ROW"}), S)
    if name == "parseXml":
        if not raw:
            raise ValueError("parseXml needs the object's type, such as parseXml(id INT, name STRING)")
        return Value(F.from_xml(v.column, F.lit(raw)), T.StructType.fromDDL(raw))
    if name == "inspect":
        parts = [lv.column.cast("string") for _, lv in reversed(scope.levels) if lv.column is not None]
        return Value(F.concat_ws(raw or " < ", *parts), S)
    raise ValueError(f"no instruction {name}")


def kept(name: str, raw: str, scope: Scope) -> Value:
    """``cache`` keeps the first value under a key, ``recache`` the latest; ``swapcache`` gives the one before.

    Within a row that is the value kept earlier in its expressions. Without one, ``swapcache`` looks
    back to the row before, for which the scope needs an order of rows.
    """
    key, _, source = raw.partition(",")
    optional, key = key.endswith("?"), key.rstrip("?")
    before = scope.cache.get(key)
    if not source:
        if before is None and not optional:
            raise ValueError(f"nothing is kept under {key}")
        return before or null()
    if name == "cache" and before is not None:
        return before
    value = compile_expr(source, scope)
    scope.cache[key] = value
    if name != "swapcache":
        return value
    if before is not None:
        return before
    if scope.order is None:
        raise ValueError(f"swapcache({key}, ...) needs an order of rows, or a value kept before")
    return Value(ordered.previous(value.column, *scope.order), value.type)


def keyed_map(name: str, xs: Value, raw: str | None, scope: Scope) -> Value:
    """Nested maps of counts, lists or single values by the keys of a collection's elements."""
    ordered, keys, mapper = _keys(raw) if raw else (False, ["@"], None)
    key, key_type = _element(xs, scope, keys[0])
    value, value_type = _element(xs, scope, mapper) if mapper else ((lambda e: e), xs.type.elementType)
    found = F.array_distinct(F.transform(xs.column, key))
    found = F.array_sort(F.filter(found, lambda k: k.isNotNull())) if ordered else F.filter(found, lambda k: k.isNotNull())

    def leaf(k):
        own = F.filter(xs.column, lambda e: key(e).eqNullSafe(k))
        if len(keys) > 1:
            rest = "#".join(keys[1:]) + (f",{mapper}" if mapper else "")
            return columns.let(own, lambda own: keyed_map(name, Value(own, xs.type), rest, scope).column)
        if name == "count":
            return F.size(own)
        if name == "group":
            return F.transform(own, value)
        return F.when(F.size(F.filter(own, lambda e: value(e).isNotNull())) > 1, F.raise_error(F.lit("Key collision"))).otherwise(value(F.element_at(own, 1)))

    if len(keys) > 1:
        inner = keyed_map(name, xs, "#".join(keys[1:]) + (f",{mapper}" if mapper else ""), scope).type
    else:
        inner = T.IntegerType() if name == "count" else T.ArrayType(value_type) if name == "group" else value_type
    return Value(F.map_from_entries(F.transform(found, lambda k: F.struct(k, leaf(k)))), T.MapType(key_type, inner))


def constructed(v: Value, lines: list[str], scope: Scope) -> Value:
    s, fields, merged = scope if v is scope.this else scope.inner(v), {}, None
    for line in lines:
        names, source = syntax.assignment(line)
        value = compile_expr(source, s)
        if names and names[-1] == "*":
            merged = value.column
        elif len(names) > 1:
            for i, n in enumerate(names):
                fields[n] = F.try_element_at(value.column, F.lit(i + 1)).cast("string")
        else:
            fields[names[0] if names else source] = value.column.cast("string")
    from arbora.operators.select import construct

    return Value(construct(fields, merged), T.MapType(T.StringType(), T.StringType()))


def branched(name: str, v: Value, args: list[str], scope: Scope) -> Value:
    cases, default, kind = [], None, None
    for i, a in enumerate(args):
        test, eq, source = a.partition("=")
        if not eq and i == 0 and name == "switch" and len(args) > 1 and "=" in args[1]:
            v = compile_expr(a, scope if v is scope.this else scope.inner(v))
            continue
        value = compile_expr(source if eq else a, scope)
        kind = kind or value.type
        if eq:
            cases.append((test.strip() if name == "switch" else float(test), value.column))
        else:
            default = value.column
    return Value((switch if name == "switch" else partition)(v.column, cases, default), kind)


@dataclass
class _Search:
    """What ``:Class(...)`` asks for: conditions on attributes, fixed filters, and the form of the answer."""

    keys: list[tuple[str, str, str]]
    fixed: list[str]
    values: list[str]
    count: bool
    many: bool
    order: list[str]
    limit: int | None


def _search(raw: str, e: Entity) -> _Search:
    raw, values = raw.strip(), e.rows.columns
    count, many = raw.startswith("?"), raw.startswith("[")
    raw = raw.removeprefix("?").removeprefix("[").removesuffix("]").removeprefix(">").strip()
    if raw.startswith("{"):
        names, _, raw = raw[1:].partition("}")
        values = [x.strip() for x in names.split(",")]
    bits = syntax.split(raw)
    keys, fixed = [], []
    for part in filter(None, map(str.strip, _conjuncts(bits[0] if bits else ""))):
        hit = re.fullmatch(r'(\w+)\s*(==|!=|<=|>=|<|>)\s*\$"([^"]*)"', part)
        keys.append(hit.groups()) if hit else fixed.append(part)
    limit = next((int(b) for b in bits[1:] if b.isdigit()), None)
    return _Search(keys, fixed, values, count, many, [b for b in bits[1:] if not b.isdigit()] or [e.id], limit)


def _conjuncts(text: str) -> list[str]:
    """Parts between ``&&`` outside of brackets and quotes."""
    out, depth, at = [""], 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|&&|[({\[]|[)}\]]|.', text, re.S):
        depth += (m[0] in "({[") - (m[0] in ")}]")
        if m[0] == "&&" and not depth:
            out.append("")
        else:
            out[-1] += m[0]
    return out


_COMPARE = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _answer(rows: DataFrame, names: list[str], q: _Search, item: T.DataType, into: str) -> tuple[DataFrame, T.DataType]:
    """For each combination of ``names``: the number of rows, the rows in order, the first, or the only one."""
    value = F.struct(*q.values)
    if q.count:
        return rows.groupBy(*names).agg(F.count("*").alias(into)), T.LongType()
    if not q.many:
        one = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.first(value).alias(into)).where("_n = 1")
        return one.drop("_n"), item
    place = Window.partitionBy(*(names or [F.lit(0)])).orderBy(*ordered.sort_keys(*q.order))
    found = rows.select(*names, value.alias("_v"), F.row_number().over(place).alias("_rn"))
    found = found.where(F.col("_rn") <= q.limit) if q.limit else found
    if q.limit == 1:
        return found.select(*names, F.col("_v").alias(into)), item
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_v"))), lambda x: x["_v"])
    return found.groupBy(*names).agg(listed.alias(into)), T.ArrayType(item)


def _absent(column: Column, kind: T.DataType, q: _Search) -> Column:
    """No match: none, an empty list, or null."""
    if q.count:
        return F.coalesce(column, F.lit(0).cast("long"))
    return F.coalesce(column, F.array().cast(kind.simpleString())) if isinstance(kind, T.ArrayType) else column


def entity(v: Value, node: syntax.Instruction, scope: Scope, wanted: str | None = None) -> Value:
    """A lookup by name joins the entity's table to the frame: by id or name, or by a filter.

    The filter's parts ``attr op $"expr"`` compare with the object at hand, others are fixed. Inside
    an iteration the elements' keys are joined once for all rows that have the same ones.
    """
    owner, elements = (scope, None) if scope.frame else scope.iteration or (None, None)
    if owner is None:
        raise ValueError(f"a lookup of {node.name} needs a frame or an iteration over its rows; unnest first")
    e = scope.catalog[node.name]
    n = len([c for c in owner.frame[0].columns if c.startswith("_lookup")])
    into = f"_lookup{n}"
    if not node.raw:
        if elements is not None:
            raise ValueError(f"inside an iteration, look {node.name} up by {e.id}==$\"...\"")
        key = f"_key{n}"
        found = e.rows.select(F.col(e.id), F.col(e.name), F.struct(*e.rows.columns).alias(into)).alias("r")
        owner.frame[0] = lookup.lookup_by_id_or_name(owner.frame[0].withColumn(key, v.column), found, key, e.id, e.name, [into]).drop(key)
        return Value(F.col(into), T.StructType(e.rows.schema.fields))
    q = _search(node.raw, e)
    narrowed = not q.many and wanted in q.values and len(q.values) > 1
    if narrowed:  # no more of the row travels than the next step takes
        q.values = [wanted]
    item = T.StructType([e.rows.schema[c] for c in q.values])
    rows = e.rows
    for part in q.fixed:
        rows = rows.where(compile_filter(part))
    out = _in_iteration(node, scope, owner, elements, q, rows, item, into) if elements is not None else _in_frame(owner, q, rows, item, into)
    if len(q.values) == 1 and isinstance(out.type, T.StructType) and not narrowed:
        return Value(out.column.getField(q.values[0]), out.type[0].dataType)
    return out


def _matches(probe: DataFrame, names: list[str], rows: DataFrame, q: _Search) -> tuple[DataFrame, list[str]]:
    """Rows with the columns they are found by; plain equality needs no join with what is looked for."""
    if all(op == "==" for _, op, _ in q.keys):
        return rows.select("*", *(F.col(a).alias(n) for n, (a, _, _) in zip(names, q.keys, strict=True))), names
    on = [_COMPARE[op](rows[a], probe[n]) for n, (a, op, _) in zip(names, q.keys, strict=True)]
    return probe.select(*names).distinct().join(rows, on), names


def _in_frame(owner: Scope, q: _Search, rows: DataFrame, item: T.DataType, into: str) -> Value:
    names = [f"_key{into}_{i}" for i in range(len(q.keys))]
    compiled = [compile_expr(text, owner).column for _, _, text in q.keys]  # this may join to the frame
    df = owner.frame[0].withColumns(dict(zip(names, compiled, strict=True)))
    found, kind = _answer(*_matches(df, names, rows, q), q, item, into)
    df = df.join(found, names, "left") if names else df.crossJoin(F.broadcast(found.agg(F.first(into).alias(into))))  # one row
    owner.frame[0] = df.drop(*names).withColumn(into, _absent(F.col(into), kind, q))
    return Value(F.col(into), kind)


def _in_iteration(node: syntax.Instruction, scope: Scope, owner: Scope, elements: Value, q: _Search, rows: DataFrame, item: T.DataType, into: str) -> Value:
    kind = elements.type.elementType

    def key(e):
        s = Scope([*owner.levels, (scope.levels[-1][0], Value(e, kind))], owner.parameters, owner.catalog)
        return F.struct(*(compile_expr(text, s).column.alias(f"k{i}") for i, (_, _, text) in enumerate(q.keys)))

    memo = (node.name, node.raw, tuple(q.values), str(elements.column))
    if memo not in owner.lookups:
        # rows find their answers by a hash of their keys. Rows of different keys that share one
        # share a map of all their answers, which is as good, being asked by the keys themselves
        keys, names = F.array_distinct(F.transform(elements.column, key)), [f"k{i}" for i in range(len(q.keys))]
        df = owner.frame[0].withColumn("_set", F.xxhash64(F.array_sort(keys)))
        pairs = df.select("_set", F.explode(keys).alias("k")).select("_set", "k.*").distinct()
        found, answer = _answer(*_matches(pairs, names, rows, q), q, item, into)
        back = pairs.join(found, names).groupBy("_set").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*names), into))).alias(into))
        owner.frame[0] = df.join(back, "_set", "left").drop("_set")
        owner.lookups[memo] = into, answer
    into, answer = owner.lookups[memo]
    return Value(_absent(F.try_element_at(F.col(into), key(scope.this.column)), answer, q), answer)


def select_text(df: DataFrame, *lines: str, name: str = "", macros: dict | None = None, **more) -> DataFrame:
    """Output columns from lines of ``[name=]expression``; the default name is the text."""
    scope, out = of(df, name, **more), []
    for line in lines:
        names, source = syntax.assignment(expand(line, macros or {}))
        out.append(compile_expr(source, scope).column.alias(names[0] if names else source))
    return scope.frame[0].select(*out)
