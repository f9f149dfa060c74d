"""Scalar functions: nulls and conditions, strings, numbers, arrays, sequences."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import INTEGERS, NUMBERS, SPARK, TEXTS, Expr, SchemaError, comparable, expr, is_array, made, require

LITERAL = re.compile(r"[.^$*+?()\[\]{}|\\]")


def _common(items: list[Expr], what: str) -> str:
    kinds = [i.type for i in items if i.type != "any"]
    for k in kinds[1:]:
        if not comparable(kinds[0], k, items[0].dialect):
            raise TypeError(f"{what}: {kinds[0]} and {k} don't fit together")
    if kinds and all(k in NUMBERS for k in kinds):
        return max(kinds, key=NUMBERS.index)
    return kinds[0] if kinds else "any"


# -- nulls and conditions ---------------------------------------------------------------


def coalesce(value: Any, default: Any) -> Expr:
    return coalesce_many(value, [default])


def coalesce_many(value: Any, others: Iterable[Any]) -> Expr:
    items = [expr(value), *map(expr, others)]
    return made(items, F.coalesce(*[i.column for i in items]), _common(items, "coalesce"), all(i.nullable for i in items))


ifnull = coalesce


def nullif(a: Any, b: Any) -> Expr:
    a, b = expr(a), expr(b)
    _common([a, b], "nullif")
    return made([a, b], F.nullif(a.column, b.column), a.type, True)


def _extreme(name: str, f):
    def g(left: Any, right: Any) -> Expr:
        items = [expr(left), expr(right)]
        return made(items, f(*[i.column for i in items]), _common(items, name), all(i.nullable for i in items))

    g.__name__ = name
    return g


greatest = _extreme("greatest", F.greatest)
least = _extreme("least", F.least)


@dataclass(frozen=True)
class Case:
    """case().when(c, v).when(c, v).end() or .else_(d)."""

    branches: tuple = ()

    def when(self, condition: Any, value: Any) -> Case:
        c, v = expr(condition), expr(value)
        require(c, ("bool",), "when")
        if self.branches:
            _common([self.branches[0][1], v], "case")
        return Case((*self.branches, (c, v)))

    def _made(self, default: Expr | None) -> Expr:
        if not self.branches:
            raise TypeError("case needs a branch")
        (c, v), *rest = self.branches
        column = F.when(c.column, v.column)
        for c, v in rest:
            column = column.when(c.column, v.column)
        values = [v for _, v in self.branches] + ([default] if default else [])
        column = column.otherwise(default.column) if default else column
        return made([x for b in self.branches for x in b] + ([default] if default else []), column, _common(values, "case"), default is None or any(v.nullable for v in values))

    def end(self) -> Expr:
        return self._made(None)

    def else_(self, default: Any) -> Expr:
        return self._made(expr(default))


def case() -> Case:
    return Case()


# -- casts, aliases, raw SQL --------------------------------------------------------------


def alias(value: Any, name: str) -> Expr:
    return expr(value).alias(name)


def raw(sql: str, kind: str = "any") -> Expr:
    return Expr(F.expr(sql), kind, True, "scalar")


raw_nullable = raw


def raw_non_null(sql: str, kind: str = "any") -> Expr:
    return Expr(F.expr(sql), kind, False, "scalar")


def sql(template: str, *values: Any, kind: str = "any") -> Expr:
    """A template with {} for expressions: sql("{} + 1", col)."""
    parts, items = template.split("{}"), [expr(v) for v in values]
    if len(parts) != len(items) + 1:
        raise TypeError(f"{len(parts) - 1} places for {len(items)} values")
    if not items:
        return Expr(F.expr(template), kind)
    return made(items, _inlined(parts, items), kind, True)


def _inlined(parts: list[str], items: list[Expr]) -> Column:
    """Column operators written between two values or around one."""
    names = [f"__{i}" for i in range(len(items))]
    text = "".join(p + (f"s.{names[i]}" if i < len(items) else "") for i, p in enumerate(parts))
    packed = F.array(F.struct(*[x.column.alias(n) for x, n in zip(items, names)]))
    return F.element_at(F.transform(packed, lambda s: _body(text, s, names)), 1)


def _body(text: str, s: Column, names: list[str]) -> Column:
    """Evaluates a template's arithmetic with Python's own operators on columns."""
    import ast

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            table = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Mod: lambda: a % b}
            return table[type(node.op)]()
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Attribute):
            return s[node.attr]
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.Call):
            return F.call_function(node.func.id, *[walk(a) for a in node.args])
        raise TypeError(f"template: {ast.dump(node)[:80]}")

    return walk(ast.parse(text.strip(), mode="eval").body)


def cast(value: Any, kind: str) -> Expr:
    e = expr(value)
    safe = kind in TEXTS or e.type == "any" or e.type in TEXTS or comparable(e.type, kind, e.dialect) or {e.type, kind} <= {*INTEGERS, "bool"}
    if not safe or kind not in SPARK:
        raise TypeError(f"no cast from {e.type} to {kind}")
    return made([e], e.column.cast(SPARK[kind]), kind)


def typeof_(value: Any) -> Expr:
    """SQLite's storage class of the value."""
    e = expr(value)
    t = F.typeof(e.column)
    name = F.when(e.column.isNull(), F.lit("null")).when(t.isin("tinyint", "smallint", "int", "bigint", "boolean"), F.lit("integer")).when(t.isin("float", "double") | t.startswith("decimal"), F.lit("real")).when(t == "binary", F.lit("blob")).otherwise(F.lit("text"))
    return made([e], name, "text", False)


typeof = typeof_


# -- strings ------------------------------------------------------------------------------


def _text(name: str, f, kind: str = "text", rest: tuple = ()):
    """f gets columns; rest names the families of further arguments."""

    def g(value: Any, *more: Any) -> Expr:
        if len(more) != len(rest):
            raise TypeError(f"{name} takes {1 + len(rest)} arguments")
        e, others = expr(value), [expr(m) for m in more]
        require(e, (*TEXTS, "uuid", *(("blob",) if name in ("length", "octet_length") else ())), name)
        for o, family in zip(others, rest):
            require(o, family, name)
        column = f(e.column, *[o.column for o in others])
        return made([e, *others], column.cast(SPARK[kind]) if kind != "text" else column, kind)

    g.__name__ = name
    return g


def _first_match(c: Column, p: Column, r: Column, flags: str = "") -> Column:
    """Replaces the first match only: what stands before it is matched lazily."""
    return F.regexp_replace(c, F.concat(F.lit(f"(?s{flags})^(.*?)(?:"), p, F.lit(")")), F.concat(F.lit("$1"), _shifted(r)))


def _shifted(r: Column) -> Column:
    r"""\1 in a replacement is the pattern's group 1, which is Java's $2 here."""
    for n in range(8, 0, -1):
        r = F.replace(r, F.lit(f"\\{n}"), F.lit(f"${n + 1}"))
    return F.replace(r, F.lit("\\&"), F.lit("$0"))


def _signed(c: Column, n: Column, keep_left: bool) -> Column:
    """left and right; a negative number drops from the other end."""
    size = F.length(c)
    take = F.when(n >= 0, F.least(n, size)).otherwise(F.greatest(size + n, F.lit(0)))
    return F.substr(c, F.lit(1), take) if keep_left else F.substr(c, size - take + 1, take)


def _substr(c: Column, start: Column, n: Column) -> Column:
    """From a place before the text the length counts from there."""
    end = F.greatest(start + n, F.lit(1))
    begin = F.greatest(start, F.lit(1))
    return F.substr(c, begin, F.greatest(end - begin, F.lit(0)))


def _initcap(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+|[^A-Za-z0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


upper, lower = _text("upper", F.upper), _text("lower", F.lower)
trim, ltrim, rtrim = _text("trim", F.trim), _text("ltrim", F.ltrim), _text("rtrim", F.rtrim)
length = _text("length", F.length, "int8")
char_length = _text("char_length", F.char_length, "int8")
octet_length = _text("octet_length", F.octet_length, "int8")
substr = _text("substr", _substr, rest=(INTEGERS, INTEGERS))
replace_ = _text("replace", F.replace, rest=(TEXTS, TEXTS))
instr = _text("instr", lambda c, s: F.call_function("instr", c, s), "int8", (TEXTS,))
strpos = instr
left = _text("left", lambda c, n: _signed(c, n, True), rest=(INTEGERS,))
right = _text("right", lambda c, n: _signed(c, n, False), rest=(INTEGERS,))
split_part = _text("split_part", F.split_part, rest=(TEXTS, INTEGERS))
lpad = _text("lpad", lambda c, n, f: F.call_function("lpad", c, n, f), rest=(INTEGERS, TEXTS))
rpad = _text("rpad", lambda c, n, f: F.call_function("rpad", c, n, f), rest=(INTEGERS, TEXTS))
initcap = _text("initcap", _initcap)
reverse = _text("reverse", F.reverse)
repeat = _text("repeat", lambda c, n: F.call_function("repeat", c, n), rest=(INTEGERS,))
starts_with = _text("starts_with", F.startswith, "bool", (TEXTS,))
translate = _text("translate", lambda c, a, b: F.call_function("translate", c, a, b), rest=(TEXTS, TEXTS))
regexp_replace = _text("regexp_replace", _first_match, rest=(TEXTS, TEXTS))
COLLATIONS = {"NOCASE": "UTF8_LCASE", "BINARY": "UTF8_BINARY", "C": "UTF8_BINARY", "RTRIM": "UTF8_BINARY_RTRIM"}


def collate(value: Any, name: str) -> Expr:
    e = expr(value)
    require(e, TEXTS, "collate")
    return made([e], F.collate(e.column, COLLATIONS.get(name, name)), "text")


def concat(a: Any, b: Any) -> Expr:
    """a || b: null if either is."""
    items = [expr(a), expr(b)]
    for i in items:
        require(i, (*TEXTS, *NUMBERS), "concat")
    return made(items, F.concat(*[i.column for i in items]), "text")


string_concat = concat


def concat_ws(separator: str, values: Iterable[Any]) -> Expr:
    items = [expr(v) for v in values]
    return made(items, F.concat_ws(separator, *[i.column for i in items]), "text", False)


def regexp_replace_flags(value: Any, pattern: str, replacement: str, flags: str) -> Expr:
    e = expr(value)
    require(e, TEXTS, "regexp_replace_flags")
    if set(flags) - set("gi"):
        raise ValueError(f"unknown flags {flags!r}")
    i = "i" if "i" in flags else ""
    if "g" not in flags:
        return made([e], _first_match(e.column, F.lit(pattern), F.lit(replacement), i), "text")
    return made([e], F.regexp_replace(e.column, f"(?{i}){pattern}" if i else pattern, re.sub(r"\\(\d)", r"$\1", replacement)), "text")


def regexp_match(value: Any, pattern: str, flags: str = "") -> Expr:
    """The groups of the first match (or the whole match) as an array, or null."""
    e = expr(value)
    require(e, TEXTS, "regexp_match")
    java = f"(?{flags}){pattern}" if flags else pattern
    groups = re.compile(pattern).groups
    found = F.array(*[F.regexp_extract(e.column, java, g) for g in (range(1, groups + 1) if groups else [0])])
    return made([e], F.when(F.rlike(e.column, F.lit(java)), found), "text[]", True)


regexp_match_flags = regexp_match


# -- numbers ------------------------------------------------------------------------------


def _number(name: str, f, kind: str | None = None, rest: int = 0, nullable: bool | None = None):
    def g(value: Any, *more: Any) -> Expr:
        if len(more) != rest:
            raise TypeError(f"{name} takes {1 + rest} arguments")
        items = [expr(value), *map(expr, more)]
        for i in items:
            require(i, NUMBERS, name)
        k = kind or items[0].type
        column = f(items[0], *[i.column for i in items[1:]])
        return made(items, column.cast(SPARK[k]) if k not in ("any", "numeric") else column, k, nullable)

    g.__name__ = name
    return g


def _domain(make, allowed):
    """Outside of a function's domain SQLite gives null and PostgreSQL an error."""
    def f(e: Expr, *more: Column) -> Column:
        ok, value = allowed(e.column), make(e.column, *more)
        if e.dialect == "sqlite":
            return F.when(ok, value)
        return F.when(ok | e.column.isNull(), value).otherwise(F.raise_error(F.lit("input is out of range")).cast("double"))

    return f


abs_ = _number("abs", lambda e: F.abs(e.column))
round_ = _number("round", lambda e: F.round(e.column), "float8")
round_to = _number("round_to", lambda e, p: F.round(e.column, p), "float8", 1)
ceil = _number("ceil", lambda e: F.ceil(e.column), "float8")
floor = _number("floor", lambda e: F.floor(e.column), "float8")
trunc = _number("trunc", lambda e: F.when(e.column < 0, F.ceil(e.column)).otherwise(F.floor(e.column)), "float8")
sqrt = _number("sqrt", _domain(lambda c: F.sqrt(c), lambda c: c >= 0), "float8")
power = _number("power", lambda e, p: F.pow(e.column, p), "float8", 1)
exp = _number("exp", lambda e: F.exp(e.column), "float8")
ln = _number("ln", _domain(lambda c: F.ln(c), lambda c: c > 0), "float8")
log10 = _number("log10", _domain(lambda c: F.log10(c), lambda c: c > 0), "float8")
log2 = _number("log2", _domain(lambda c: F.log2(c), lambda c: c > 0), "float8")
log = _number("log", lambda b, v: F.ln(v) / F.ln(b.column), "float8", 1)
sign = _number("sign", lambda e: F.signum(e.column), "int4")


def mod_(a: Any, b: Any) -> Expr:
    return expr(a) % expr(b)


def pi() -> Expr:
    return Expr(F.pi(), "float8", False, "constant")


def random(dialect: str = "pg") -> Expr:
    """PostgreSQL: [0, 1); SQLite: any 64-bit integer."""
    if dialect == "sqlite":
        return Expr(((F.rand() - 0.5) * 1.8446744073709552e19).cast("bigint"), "int8", False, "scalar", None, "sqlite")
    return Expr(F.rand(), "float8", False, "scalar")


# -- arrays and sequences -----------------------------------------------------------------


def _arrays(l: Any, r: Any, name: str) -> tuple[Expr, Expr]:  # noqa: E741
    a, b = expr(l), expr(r)
    for x in (a, b):
        if not is_array(x.type) and x.type != "any":
            raise TypeError(f"{name}: {x.type} is no array")
    return a, b


def _within(inner: Column, outer: Column) -> Column:
    """Nulls are contained in nothing."""
    return (F.size(F.array_except(inner, outer)) == 0) & ~F.exists(inner, lambda x: x.isNull())


def array_contains(left: Any, right: Any) -> Expr:
    a, b = _arrays(left, right, "array_contains")
    return made([a, b], _within(b.column, a.column), "bool")


def array_contained(left: Any, right: Any) -> Expr:
    return array_contains(right, left)


def array_overlaps(left: Any, right: Any) -> Expr:
    a, b = _arrays(left, right, "array_overlaps")
    overlap = F.coalesce(F.arrays_overlap(a.column, b.column), F.lit(False))
    return made([a, b], F.when(a.column.isNotNull() & b.column.isNotNull(), overlap), "bool")


class Sequence:
    """A counter of the driver. Rows of a table are numbered by the writer instead."""

    def __init__(self, name: str, start: int = 1, increment: int = 1):
        self.name, self.increment, self.last, self.start = name, increment, None, start

    def nextval(self) -> int:
        self.last = self.start if self.last is None else self.last + self.increment
        return self.last

    def currval(self) -> int:
        if self.last is None:
            raise SchemaError(f"currval of sequence {self.name} is not yet defined")
        return self.last

    def setval(self, value: int, is_called: bool = True) -> int:
        if is_called:
            self.last = value
        else:
            self.last, self.start = None, value
        return value


def nextval(s: Sequence) -> int:
    return s.nextval()


def currval(s: Sequence) -> int:
    return s.currval()


def setval(s: Sequence, value: int, is_called: bool = True) -> int:
    return s.setval(value, is_called)


def nullable(e: Any) -> Expr:
    return replace(expr(e), nullable=True)

