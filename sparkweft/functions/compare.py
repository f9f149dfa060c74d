"""Predicates and boolean logic, with SQL's three values."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import TEXTS, All, Either, Equal, Expr, Not, as_kind, comparable, expr, made, require


def _pair(a: Any, b: Any, what: str) -> tuple[Expr, Expr]:
    a, b = expr(_scalar(a)), expr(_scalar(b))
    dialect = a.dialect if a.kind != "constant" else b.dialect
    if not comparable(a.type, b.type, dialect):
        raise TypeError(f"{what}: {a.type} and {b.type} are not comparable")
    return a, b


def _scalar(value: Any) -> Any:
    """A SELECT as an operand is a scalar subquery."""
    return value.scalar() if hasattr(value, "scalar") and not isinstance(value, Expr) else value


def _compare(name: str, make):
    def f(left: Any, right: Any) -> Expr:
        a, b = _pair(left, right, name)
        whole = made([a, b], make(a.column, b.column), "bool")
        return as_kind(Equal, whole) if name == "eq" else whole

    f.__name__ = name
    return f


eq = _compare("eq", lambda a, b: a == b)
ne = _compare("ne", lambda a, b: a != b)
neq = ne
gt = _compare("gt", lambda a, b: a > b)
gte = _compare("gte", lambda a, b: a >= b)
lt = _compare("lt", lambda a, b: a < b)
lte = _compare("lte", lambda a, b: a <= b)


def is_distinct_from(left: Any, right: Any) -> Expr:
    a, b = _pair(left, right, "is_distinct_from")
    return made([a, b], ~a.column.eqNullSafe(b.column), "bool", False)


def is_not_distinct_from(left: Any, right: Any) -> Expr:
    a, b = _pair(left, right, "is_not_distinct_from")
    return made([a, b], a.column.eqNullSafe(b.column), "bool", False)


def _matcher(name: str, make, negate: bool = False):
    def f(value: Any, pattern: Any) -> Expr:
        e, p = expr(value), expr(pattern)
        require(e, (*TEXTS, "uuid"), name)
        require(p, TEXTS, name)
        got = make(e, p)
        return made([e, p], ~got if negate else got, "bool")

    f.__name__ = name
    return f


def _like(e: Expr, p: Expr) -> Column:
    """SQLite ignores the case of ASCII letters, PostgreSQL doesn't."""
    return F.ilike(e.column, p.column) if e.dialect == "sqlite" else F.like(e.column, p.column)


like = _matcher("like", _like)
not_like = _matcher("not_like", _like, True)
ilike = _matcher("ilike", lambda e, p: F.ilike(e.column, p.column))
not_ilike = _matcher("not_ilike", lambda e, p: F.ilike(e.column, p.column), True)
regex_match = _matcher("regex_match", lambda e, p: F.rlike(e.column, p.column))
regex_not_match = _matcher("regex_not_match", lambda e, p: F.rlike(e.column, p.column), True)
regex_match_ci = _matcher("regex_match_ci", lambda e, p: F.rlike(e.column, F.concat(F.lit("(?i)"), p.column)))
regex_not_match_ci = _matcher("regex_not_match_ci", lambda e, p: F.rlike(e.column, F.concat(F.lit("(?i)"), p.column)), True)


def between(value: Any, low: Any, high: Any) -> Expr:
    e, lo = _pair(value, low, "between")
    _, hi = _pair(value, high, "between")
    return made([e, lo, hi], e.column.between(lo.column, hi.column), "bool")


def not_between(value: Any, low: Any, high: Any) -> Expr:
    inside = between(value, low, high)
    return made([inside], ~inside.column, "bool")


def is_null(value: Any) -> Expr:
    e = expr(value)
    return made([e], e.column.isNull(), "bool", False)


def is_not_null(value: Any) -> Expr:
    e = expr(value)
    return made([e], e.column.isNotNull(), "bool", False)


def is_true(value: Any) -> Expr:
    e = expr(value)
    require(e, ("bool",), "is_true")
    return made([e], F.coalesce(e.column, F.lit(False)), "bool", False)


def is_false(value: Any) -> Expr:
    e = expr(value)
    require(e, ("bool",), "is_false")
    return made([e], F.coalesce(~e.column, F.lit(False)), "bool", False)


def not_(value: Any) -> Expr:
    e = expr(value)
    require(e, ("bool",), "not")
    return as_kind(Not, made([e], ~e.column, "bool"))


def _flat(conditions: tuple, empty: bool, join) -> Expr:
    if len(conditions) == 1 and isinstance(conditions[0], (list, tuple)):
        conditions = tuple(conditions[0])
    present = [expr(c) for c in conditions if c is not None]
    for c in present:
        require(c, ("bool",), "condition")
    if not present:
        return Expr(F.lit(empty), "bool", False, "constant")
    if len(present) == 1:
        return present[0]
    return as_kind(Either if not empty else All, made(present, reduce(join, [c.column for c in present]), "bool"))


def all_(*conditions: Any) -> Expr:
    """Conjunction; None is skipped, nothing is true."""
    return _flat(conditions, True, lambda a, b: a & b)


def any_(*conditions: Any) -> Expr:
    """Disjunction; None is skipped, nothing is false."""
    return _flat(conditions, False, lambda a, b: a | b)


def and_(left: Any, right: Any) -> Expr:
    return all_(left, right)


def or_(left: Any, right: Any) -> Expr:
    return any_(left, right)


def in_array(value: Any, values: list) -> Expr:
    """IN over a list; an empty list is false for every row, also for null."""
    e, items = expr(value), [_pair(value, v, "in_array")[1] for v in values]
    if not items:
        return made([e], F.lit(False), "bool", False)
    return made([e, *items], e.column.isin([i.column for i in items]), "bool")


def not_in_array(value: Any, values: list) -> Expr:
    inside = in_array(value, values)
    return made([inside], ~inside.column, "bool", inside.nullable)


def _operands(value: Any) -> tuple[list[Expr], Column]:
    parts = [expr(v) for v in (value if isinstance(value, tuple) else (value,))]
    return parts, parts[0].column if len(parts) == 1 else F.struct(*[p.column.alias(f"c{i}") for i, p in enumerate(parts)])


def in_subquery(value: Any, query: Any) -> Expr:
    """IN (SELECT ..), of one value or a tuple, wherever a condition may stand."""
    return Subquery.of("in", _operands(value)[0], query)


def not_in_subquery(value: Any, query: Any) -> Expr:
    """NOT IN (SELECT ..): a null in the subquery leaves no row."""
    return Subquery.of("not_in", _operands(value)[0], query)


def exists(query: Any) -> Expr:
    return Subquery.of("exists", [], query)


def not_exists(query: Any) -> Expr:
    return Subquery.of("not_exists", [], query)


class Subquery(Expr):
    """A condition on the rows of a query. Its column stands for itself anywhere; alone
    or in a conjunction of WHERE it is planned as a join (operators.select)."""

    @staticmethod
    def of(mode: str, parts: list[Expr], query: Any) -> Subquery:
        types = query.types()
        if parts and len(parts) != len(types):
            raise TypeError(f"{len(parts)} operands against {len(types)} columns of a subquery")
        for p, t in zip(parts, types):
            if not comparable(p.type, t, p.dialect):
                raise TypeError(f"{p.type} and {t} are not comparable")
        kind = made(parts, F.lit(True), "bool").kind if parts else "scalar"
        s = Subquery(query.condition_column(mode, parts), "bool", mode in ("in", "not_in"), "scalar" if kind == "constant" else kind, None, parts[0].dialect if parts else query.dialect, None, tuple(parts))
        object.__setattr__(s, "mode", mode)
        object.__setattr__(s, "query", query)
        return s
