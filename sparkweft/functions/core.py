"""Typed expressions: a Catalyst column with a SQL type, nullability and kind.

Rules that a SQL engine would report late, or not at all, are checked when an
expression is built: comparability, arithmetic result types, boolean operands.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGERS = ("int2", "int4", "int8")
FLOATS = ("float4", "float8")
TEXTS = ("text", "varchar", "char", "enum")
TEMPORALS = ("date", "time", "timestamp", "timestamptz")
JSONS = ("json", "jsonb")
NUMBERS = (*INTEGERS, *FLOATS, "numeric")
#: Spark's name of each SQL type.
SPARK = {
    "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "numeric": "decimal(38,18)", "text": "string", "varchar": "string", "char": "string",
    "enum": "string", "bool": "boolean", "blob": "binary", "date": "date", "time": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "uuid": "string", "json": "string", "jsonb": "string",
    "interval": "struct<months:int,days:int,micros:bigint>", "inet": "string", "bit": "string", "any": "string",
}


class QueryError(Exception):
    """Base of all errors of this package."""


class NotFound(QueryError):
    """A row was required and none was found."""


class ParameterError(QueryError):
    """Placeholders and bound values don't match."""


class SchemaError(QueryError):
    """Tables don't fit together."""


class TransactionError(QueryError):
    """A transaction was used after its end."""


def is_array(kind: str) -> bool:
    return kind.endswith("[]")


def comparable(a: str, b: str, dialect: str = "pg") -> bool:
    if "any" in (a, b) or a == b:
        return True
    for family in (NUMBERS, TEXTS, ("timestamp", "timestamptz", "date"), JSONS):
        if a in family and b in family:
            return True
    pair = {a, b}
    if pair & set(TEXTS) and pair & {*TEMPORALS, "uuid", *JSONS, "inet"}:
        return True
    if dialect == "sqlite" and (pair & set(TEXTS) and "blob" in pair or "bool" in pair and pair & set(INTEGERS)):
        return True
    return is_array(a) and is_array(b) and comparable(a[:-2], b[:-2], dialect)


def arithmetic_type(a: str, b: str) -> str:
    """Result type of a + b: the wider integer; float8 once a float meets an
    int4 or int8, a numeric, or a float8; float4 with int2 stays float4."""
    if "any" in (a, b):
        return "any"
    for kind in (a, b):
        if kind not in NUMBERS:
            raise TypeError(f"arithmetic needs numbers, not {kind}")
    if a in INTEGERS and b in INTEGERS:
        return max(a, b)
    if {a, b} <= {"float4", "int2"}:
        return "float4"
    return "float8" if a in FLOATS or b in FLOATS else "numeric"


@dataclass(frozen=True, eq=False)
class Expr:
    """column: Catalyst's; kind: constant, scalar, aggregate or window."""

    column: Column
    type: str = "any"
    nullable: bool = True
    kind: str = "scalar"
    name: str | None = None
    dialect: str = "pg"
    source: tuple[str, str] | None = None
    parts: tuple = field(default=(), repr=False)

    def alias(self, name: str) -> Expr:
        return replace(self, column=self.column.alias(name), name=name)

    def as_nullable(self) -> Expr:
        return replace(self, nullable=True)

    def __add__(self, other):
        return arithmetic("+", self, other)

    def __sub__(self, other):
        return arithmetic("-", self, other)

    def __mul__(self, other):
        return arithmetic("*", self, other)

    def __truediv__(self, other):
        return arithmetic("/", self, other)

    def __mod__(self, other):
        return arithmetic("%", self, other)

    def __radd__(self, other):
        return arithmetic("+", other, self)

    def __rsub__(self, other):
        return arithmetic("-", other, self)

    def __rmul__(self, other):
        return arithmetic("*", other, self)

    def __neg__(self):
        require(self, NUMBERS, "negation")
        return made([self], -self.column, self.type)

    def __and__(self, other):
        from .compare import and_

        return and_(self, other)

    def __or__(self, other):
        from .compare import or_

        return or_(self, other)

    def __invert__(self):
        from .compare import not_

        return not_(self)

    def __getattr__(self, name: str):
        """Method style: e.eq(x) is compare.eq(e, x)."""
        if name.startswith("__") or name == "parts":
            raise AttributeError(name)
        from . import aggregates, compare

        for module in (compare, aggregates):
            f = getattr(module, name if name not in ("and", "or", "not") else f"{name}_", None)
            if callable(f):
                return lambda *a, **k: f(self, *a, **k)
        raise AttributeError(name)


class All(Expr):
    """A conjunction of its parts."""


class Either(Expr):
    """A disjunction of its parts."""


class Not(Expr):
    """The negation of its one part."""


class Equal(Expr):
    """The equality of its two parts."""


def as_kind(kind: type, e: Expr) -> Expr:
    """The same expression, known to be of this kind."""
    return kind(*[getattr(e, f.name) for f in fields(e)])


def literal(value: Any) -> Expr:
    kinds = {bool: "bool", int: "int8" if isinstance(value, int) and abs(value) >= 1 << 31 else "int4", float: "float8", str: "text", Decimal: "numeric", datetime: "timestamp", date: "date", bytes: "blob"}
    if value is None:
        return Expr(F.lit(None), "any", True, "constant")
    if isinstance(value, (list, tuple)):
        inner = literal(value[0]).type if value else "any"
        return Expr(F.array(*[F.lit(v) for v in value]), f"{inner}[]", False, "constant")
    kind = kinds.get(type(value))
    if kind is None:
        raise TypeError(f"no SQL type for {type(value).__name__}")
    column = F.lit(value).cast("timestamp_ntz") if kind == "timestamp" else F.lit(value)
    return Expr(column, kind, False, "constant")


def expr(value: Any) -> Expr:
    return value if isinstance(value, Expr) else literal(value)


def exprs(values: Iterable[Any]) -> list[Expr]:
    return [expr(v) for v in values]


def made(args: list[Expr], column: Column, kind: str, nullable: bool | None = None) -> Expr:
    """A scalar of its arguments: null if one of them may be, aggregate if one is."""
    kinds = {a.kind for a in args}
    own = "window" if "window" in kinds else "aggregate" if "aggregate" in kinds else "constant" if kinds <= {"constant"} else "scalar"
    if own == "aggregate" and "scalar" in kinds:
        own = "mixed"
    if "mixed" in kinds:
        own = "mixed"
    dialect = next((a.dialect for a in args if a.kind != "constant"), "pg")
    return Expr(column, kind, any(a.nullable for a in args) if nullable is None else nullable, own, None, dialect, None, tuple(args))


def require(e: Expr, family: Iterable[str], what: str) -> None:
    if e.type != "any" and e.type not in family:
        raise TypeError(f"{what}: {e.type} is none of {', '.join(family)}")


def arithmetic(op: str, a: Any, b: Any) -> Expr:
    a, b = expr(a), expr(b)
    kind = arithmetic_type(a.type, b.type)
    x, y = a.column, b.column
    both_whole = a.type in INTEGERS and b.type in INTEGERS
    dialect = a.dialect if a.kind != "constant" else b.dialect
    if op in "/%" and dialect == "sqlite":
        y = F.when(y != 0, y)  # zero gives null; elsewhere it is an error
    nullable = True if op in "/%" and dialect == "sqlite" else None
    column = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y, "/": lambda: F.call_function("div", x, y) if both_whole else x / y}[op]()
    if kind in SPARK and kind not in ("any", "numeric"):
        column = column.cast(SPARK[kind])
    return made([a, b], column, kind, nullable)
