"""The clauses as free functions, for code that composes queries from parts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from sparkweft.functions.core import expr

from .dml import Delete, Insert, Update, delete, insert, update
from .select import Select, Source

Clause = Callable[[Select], Select]


def select(*items: Any, dialect: str = "pg") -> Select:
    return Select(dialect, tuple(expr(i) for i in items))


def select_distinct(*items: Any, dialect: str = "pg") -> Select:
    return Select(dialect, tuple(expr(i) for i in items), True)


def from_(source: Source | Select) -> Clause:
    return lambda q: q.from_(source)


def where(*conditions: Any) -> Clause:
    return lambda q: q.where(*conditions)


def group_by(*keys: Any) -> Clause:
    return lambda q: q.group_by(*keys)


group_by_expr = group_by


def having(condition: Any) -> Clause:
    return lambda q: q.having(condition)


def order_by(*keys: Any) -> Clause:
    return lambda q: q.order_by(*keys)


def limit(n: int) -> Clause:
    return lambda q: q.limit(n)


def offset(n: int) -> Clause:
    return lambda q: q.offset(n)


def chain(query: Select, *clauses: Clause) -> Select:
    """chain(select(..), from_(t), where(..))"""
    for c in clauses:
        query = c(query)
    return query


def union(a: Select, b: Select) -> Select:
    return a.union(b)


def union_all(a: Select, b: Select) -> Select:
    return a.union_all(b)


def intersect(a: Select, b: Select) -> Select:
    return a.intersect(b)


def intersect_all(a: Select, b: Select) -> Select:
    return a.intersect_all(b)


def except_(a: Select, b: Select) -> Select:
    return a.except_(b)


def except_all(a: Select, b: Select) -> Select:
    return a.except_all(b)


def set_(statement: Update, changes: dict[str, Any]) -> Update:
    return statement.set(changes)


__all__ = ["Delete", "Insert", "Update", "chain", "delete", "except_", "except_all", "from_", "group_by", "group_by_expr", "having", "insert", "intersect", "intersect_all", "limit", "offset", "order_by", "select", "select_distinct", "set_", "union", "union_all", "update", "where"]
