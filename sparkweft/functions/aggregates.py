"""Aggregates, windows and frames."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .core import INTEGERS, NUMBERS, SPARK, TEXTS, Expr, expr, literal, require


def _aggregate(e: Expr | None, make, kind: str, nullable: bool = True, args: list[Expr] | None = None) -> Expr:
    """make builds the aggregate from its arguments' columns, so that a filter can
    wrap them afterwards."""
    args = args if args is not None else [e] if e is not None else []
    for a in args:
        if a.kind in ("aggregate", "window", "mixed"):
            raise TypeError("an aggregate can't be an argument of an aggregate")
    out = Expr(make(*[a.column for a in args]), kind, nullable, "aggregate", None, next((a.dialect for a in args), "pg"), None, tuple(args))
    object.__setattr__(out, "make", make)
    return out


def _sum_type(e: Expr) -> str:
    require(e, NUMBERS, "sum")
    if e.type == "float4":
        return "float8" if e.dialect == "pg" else "float8"
    return "int8" if e.type in INTEGERS else e.type


def count(value: Any = None) -> Expr:
    """COUNT(*) without an argument; never null."""
    if value is None or value == ():
        out = _aggregate(None, lambda *c: F.count(F.lit(1)) if not c else F.count(*c), "int8", False)
        return out
    return _aggregate(expr(value), F.count, "int8", False)


def count_distinct(value: Any) -> Expr:
    return _aggregate(expr(value), F.count_distinct, "int8", False)


def sum_(value: Any) -> Expr:
    e = expr(value)
    return _aggregate(e, F.sum, _sum_type(e))


def sum_distinct(value: Any) -> Expr:
    e = expr(value)
    return _aggregate(e, F.sum_distinct, _sum_type(e))


def avg(value: Any) -> Expr:
    e = expr(value)
    require(e, NUMBERS, "avg")
    return _aggregate(e, F.avg, "numeric" if e.type == "numeric" and e.dialect == "pg" else "float8")


def avg_distinct(value: Any) -> Expr:
    e = expr(value)
    require(e, NUMBERS, "avg_distinct")
    return _aggregate(e, lambda c: F.sum_distinct(c) / F.count_distinct(c), "float8")


def min_(value: Any) -> Expr:
    e = expr(value)
    return _aggregate(e, F.min, e.type)


def max_(value: Any) -> Expr:
    e = expr(value)
    return _aggregate(e, F.max, e.type)


def _statistic(name: str, f):
    def g(value: Any) -> Expr:
        e = expr(value)
        require(e, NUMBERS, name)
        return _aggregate(e, f, "float8")

    g.__name__ = name
    return g


stddev_pop = _statistic("stddev_pop", F.stddev_pop)
stddev_samp = _statistic("stddev_samp", F.stddev_samp)
var_pop = _statistic("var_pop", F.var_pop)
var_samp = _statistic("var_samp", F.var_samp)
variance = var_samp


def bool_and(value: Any) -> Expr:
    e = expr(value)
    require(e, ("bool",), "bool_and")
    return _aggregate(e, F.bool_and, "bool")


def bool_or(value: Any) -> Expr:
    e = expr(value)
    require(e, ("bool",), "bool_or")
    return _aggregate(e, F.bool_or, "bool")


every = bool_and


def _kept(c: Column) -> Column:
    """All values, nulls too; sorted, for a result that doesn't depend on the plan."""
    return F.transform(F.array_sort(F.collect_list(F.struct(c.alias("v")))), lambda s: s["v"])


def array_agg(value: Any) -> Expr:
    e = expr(value)
    return _aggregate(e, _kept, f"{e.type}[]")


def json_agg(value: Any) -> Expr:
    e = expr(value)
    return _aggregate(e, lambda c: F.to_json(_kept(c), {"ignoreNullFields": "false"}), "json")


def jsonb_agg(value: Any) -> Expr:
    return replace(json_agg(value), type="jsonb")


def json_object_agg(key: Any, value: Any) -> Expr:
    """Of keys that repeat the largest value stays (JSON objects have one value a key)."""
    k, v = expr(key), expr(value)
    require(k, TEXTS, "json_object_agg")

    def make(a: Column, b: Column) -> Column:
        entries = F.array_sort(F.collect_set(F.struct(a.alias("key"), b.alias("value"))))
        last = F.filter(entries, lambda x: ~F.exists(entries, lambda y: (y["key"] == x["key"]) & (y["value"] > x["value"])))
        return F.to_json(F.map_from_entries(last), {"ignoreNullFields": "false"})

    return _aggregate(None, make, "json", args=[k, v])


def jsonb_object_agg(key: Any, value: Any) -> Expr:
    return replace(json_object_agg(key, value), type="jsonb")


def total(value: Any) -> Expr:
    """SUM as a double, 0.0 over no rows."""
    e = expr(value)
    require(e, NUMBERS, "total")
    return _aggregate(e, lambda c: F.coalesce(F.sum(c.cast("double")), F.lit(0.0)), "float8", False)


def string_agg(value: Any, delimiter: str) -> Expr:
    """Joined in the order of the values themselves: no order is promised."""
    e = expr(value)
    require(e, TEXTS, "string_agg")
    return _aggregate(e, lambda c: F.nullif(F.array_join(F.array_sort(F.collect_list(c)), delimiter), F.when(F.count(c) == 0, F.lit(""))), "text")


def group_concat(value: Any) -> Expr:
    return string_agg(expr(value), ",")


@dataclass(frozen=True)
class Distinct:
    """DISTINCT e, as an argument of count, sum or avg."""

    value: Expr


def distinct(value: Any) -> Expr:
    e = expr(value)
    out = replace(e)
    object.__setattr__(out, "is_distinct", True)
    return out


def filter(aggregate: Expr, condition: Any) -> Expr:  # noqa: A001
    """FILTER (WHERE ..): the arguments become null in other rows."""
    make = aggregate.__dict__.get("make")
    c = expr(condition)
    require(c, ("bool",), "filter")
    if make is None:
        raise TypeError("filter follows an aggregate")
    args = list(aggregate.parts) or [literal(1)]
    only = [replace(a, column=F.when(c.column, a.column)) for a in args]
    return _aggregate(None, make, aggregate.type, aggregate.nullable, only)


# -- windows --------------------------------------------------------------------------

UNBOUNDED_PRECEDING, CURRENT_ROW, UNBOUNDED_FOLLOWING = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def preceding(n: int) -> int:
    return -n


def following(n: int) -> int:
    return n


@dataclass(frozen=True)
class Frame:
    partitions: tuple = ()
    orders: tuple = ()
    bounds: tuple | None = None

    def partition_by(self, *keys: Any) -> Frame:
        return replace(self, partitions=tuple(expr(k) for k in keys))

    def order_by(self, *keys: Any) -> Frame:
        return replace(self, orders=tuple(keys))

    def rows_between(self, start: int, end: int) -> Frame:
        return replace(self, bounds=("rows", start, end))

    def range_between(self, start: int, end: int) -> Frame:
        return replace(self, bounds=("range", start, end))

    def spec(self, needs_order: bool) -> WindowSpec:
        spec = Window.partitionBy(*[k.column for k in self.partitions] or [F.lit(0)])
        orders = [o.column if isinstance(o, Order) else expr(o).column for o in self.orders]
        if orders or needs_order:
            spec = spec.orderBy(*orders or [F.lit(0)])
        if self.bounds:
            kind, a, b = self.bounds
            spec = spec.rowsBetween(a, b) if kind == "rows" else spec.rangeBetween(a, b)
        return spec


def window() -> Frame:
    return Frame()


@dataclass(frozen=True)
class Order:
    """A sort key; nulls stand where the dialect puts them."""

    value: Expr
    descending: bool = False

    @property
    def column(self) -> Column:
        c = self.value.column
        if self.value.dialect == "sqlite":  # nulls are the smallest
            return c.desc_nulls_last() if self.descending else c.asc_nulls_first()
        return c.desc_nulls_first() if self.descending else c.asc_nulls_last()


def asc(value: Any) -> Order:
    return Order(expr(value))


def desc(value: Any) -> Order:
    return Order(expr(value), True)


@dataclass(frozen=True)
class WindowFunction:
    """Only over a window is it an expression."""

    make: Any
    type: str
    nullable: bool
    dialect: str = "pg"
    needs_order: bool = True

    def over(self, frame: Frame) -> Expr:
        c = self.make().over(frame.spec(self.needs_order))
        return Expr(c.cast(SPARK[self.type]) if self.type in ("int8", "float8") else c, self.type, self.nullable, "window", None, self.dialect)


def over(aggregate: Expr, frame: Frame) -> Expr:
    if aggregate.kind != "aggregate":
        raise TypeError("over follows an aggregate")
    return Expr(aggregate.column.over(frame.spec(False)), aggregate.type, aggregate.nullable, "window", None, aggregate.dialect)


def row_number() -> WindowFunction:
    return WindowFunction(F.row_number, "int8", False)


def rank() -> WindowFunction:
    return WindowFunction(F.rank, "int8", False)


def dense_rank() -> WindowFunction:
    return WindowFunction(F.dense_rank, "int8", False)


def ntile(n: int) -> WindowFunction:
    return WindowFunction(lambda: F.ntile(n), "int8", False)


def percent_rank() -> WindowFunction:
    return WindowFunction(F.percent_rank, "float8", False)


def cume_dist() -> WindowFunction:
    return WindowFunction(F.cume_dist, "float8", False)


def _valued(e: Expr, make, nullable: bool = True) -> WindowFunction:
    return WindowFunction(make, e.type if e.type not in ("int8", "float8") else e.type, nullable, e.dialect)


def lag(value: Any) -> WindowFunction:
    e = expr(value)
    return _valued(e, lambda: F.lag(e.column, 1))


def lead(value: Any) -> WindowFunction:
    e = expr(value)
    return _valued(e, lambda: F.lead(e.column, 1))


def _with_default(f, value: Any, offset: int, default: Any) -> WindowFunction:
    e, d = expr(value), expr(default)

    class Shifted:
        """The default fills only places outside the partition, so null values stay."""

        def over(self, spec: WindowSpec) -> Column:
            return F.when(f(F.lit(1), offset).over(spec).isNull(), d.column).otherwise(f(e.column, offset).over(spec))

    return _valued(e, Shifted, e.nullable or d.nullable)


def lag_with_default(value: Any, offset: int, default: Any) -> WindowFunction:
    return _with_default(F.lag, value, offset, default)


def lead_with_default(value: Any, offset: int, default: Any) -> WindowFunction:
    return _with_default(F.lead, value, offset, default)


def first_value(value: Any) -> WindowFunction:
    e = expr(value)
    return _valued(e, lambda: F.first_value(e.column))


def last_value(value: Any) -> WindowFunction:
    e = expr(value)
    return _valued(e, lambda: F.last_value(e.column))


def nth_value(value: Any, n: int) -> WindowFunction:
    e = expr(value)
    return _valued(e, lambda: F.nth_value(e.column, n))


