"""Relational queries: rows with their related rows nested inside.

A relation becomes one aggregation of the children by their key and one join:
many -> array of structs (empty, never null), one -> struct. Relations nest to
any depth; the deepest are built first. Limits count children per parent.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkweft.functions.aggregates import Order
from sparkweft.functions.core import Expr, SchemaError, expr

from .select import Source


@dataclass(frozen=True)
class Relation:
    """kind: many, one (there is always a row) or optional. keys: pairs of
    (parent column, child column); a junction has pairs on both sides."""

    name: str
    kind: str
    target: Source
    keys: tuple
    junction: Source | None = None
    far_keys: tuple = ()


def many(name: str, parent: Source, child: Source) -> Relation:
    """Children that refer to the parent by a declared key."""
    return Relation(name, "many", child, _keys(child, parent, False))


def one(name: str, parent: Source, target: Source) -> Relation:
    """The row the parent refers to."""
    keys = _keys(parent, target, True)
    optional = any(parent.table.column(a).nullable for a, _ in keys)
    return Relation(name, "optional" if optional else "one", target, keys)


def many_to_many(name: str, parent: Source, junction: Source, target: Source) -> Relation:
    return Relation(name, "many", target, _keys(junction, parent, False), junction, _keys(junction, target, True))


def _keys(holder: Source, referred: Source, forward: bool) -> tuple:
    found = [k for k in holder.table.foreign_keys if k.table == referred.table.name]
    if len(found) != 1:
        raise SchemaError(f"{len(found)} foreign keys lead from {holder.table.name} to {referred.table.name}")
    pairs = tuple(zip(found[0].columns, found[0].targets))
    return pairs if forward else tuple((b, a) for a, b in pairs)


@dataclass(frozen=True, eq=False)
class Query:
    """db-like entry: Query(source).with_(relation.where(..)).find_many()"""

    source: Source
    relations: tuple = ()
    condition: Expr | None = None
    orders: tuple = ()
    count: int | None = None
    skip: int = 0
    only: tuple | None = None
    relation: Relation | None = None

    @classmethod
    def of(cls, relation: Relation) -> Query:
        """The children's side: its where, order_by, limit .. act per parent."""
        return cls(relation.target, relation=relation)

    def with_(self, relation: Relation | Query) -> Query:
        q = relation if isinstance(relation, Query) else Query.of(relation)
        if q.relation.name in {r.relation.name for r in self.relations}:
            raise SchemaError(f"relation {q.relation.name} is loaded already")
        return replace(self, relations=(*self.relations, q))

    def where(self, condition: Any) -> Query:
        c = expr(condition)
        if c.type != "bool":
            raise TypeError("where takes a condition")
        return replace(self, condition=c if self.condition is None else self.condition & c)

    def order_by(self, *orders: Any) -> Query:
        return replace(self, orders=tuple(o if isinstance(o, Order) else Order(expr(o)) for o in orders))

    def limit(self, n: int) -> Query:
        if n < 0:
            raise ValueError("limit takes a natural number")
        return replace(self, count=n)

    def offset(self, n: int) -> Query:
        if self.count is None:
            raise SyntaxError("offset follows limit")
        return replace(self, skip=n)

    def first(self) -> Query:
        return self.limit(1)

    def columns(self, *names: str) -> Query:
        for n in names:
            self.source.table.column(n)
        return replace(self, only=names)

    def omit(self, *names: str) -> Query:
        for n in names:
            self.source.table.column(n)
        return replace(self, only=tuple(n for n in self.source.table.names if n not in names))

    # -- the plan --------------------------------------------------------------------

    def _rows(self) -> DataFrame:
        base = self.source.aliased()
        return base.where(self.condition.column) if self.condition is not None else base

    def _shown(self) -> list[str]:
        return [n for n in self.source.table.names if self.only is None or n in self.only]

    def _sort_keys(self) -> list[Column]:
        own = [o.column for o in self.orders]
        key = self.source.table.primary_key
        # Without a key all columns decide, so that every reading of a limit takes the same rows.
        return own + [self.source.c(k).column.asc() for k in key or self.source.table.names]

    def df(self) -> DataFrame:
        """Parents with a column per relation; parents are limited before children are met."""
        base = self._rows()
        if self.orders or self.count is not None:
            base = base.orderBy(*self._sort_keys())
        base = base.offset(self.skip) if self.skip else base
        base = base.limit(self.count).alias(self.source.label) if self.count is not None else base
        return self._nested(base, self.condition is not None or self.count is not None).select(*[self.source.c(n).column for n in self._shown()], *[F.col(f"`__rel_{r.relation.name}`").alias(r.relation.name) for r in self.relations])

    def _nested(self, base: DataFrame, restricted: bool) -> DataFrame:
        for q in self.relations:
            base = q._attached(base, self.source, restricted)
        return base

    def _attached(self, base: DataFrame, parent: Source, restricted: bool) -> DataFrame:
        """restricted: some parents are gone; then only children of the others take part."""
        r = self.relation
        rows, near = self._rows(), r.keys
        if r.junction:
            link = r.junction.aliased()
            on = _equal([(r.junction.c(a).column, self.source.c(b).column) for a, b in r.far_keys])
            rows = rows.join(link, on)
            own = [r.junction.c(b).column.alias(f"__k{i}") for i, (_, b) in enumerate(near)]
        else:
            own = [self.source.c(b).column.alias(f"__k{i}") for i, (_, b) in enumerate(near)]
        names = [f"__k{i}" for i in range(len(near))]
        rows = self._nested(rows, self.condition is not None)
        fields = [self.source.c(n).column.alias(n) for n in self._shown()] + [F.col(f"`__rel_{q.relation.name}`").alias(q.relation.name) for q in self.relations]
        numbered = F.row_number().over(Window.partitionBy(*names).orderBy("__order"))
        child = rows.select(*own, F.struct(*fields).alias("__row"), F.struct(*[_sortable(o, i) for i, o in enumerate(self._order_parts())]).alias("__order"))
        if restricted:
            child = child.join(base.select(*[parent.c(a).column.alias(n) for (a, _), n in zip(near, names)]), names, "left_semi")
        if r.kind != "many":
            child = child.withColumn("__n", numbered).where("__n = 1")
            single = child.select(*names, F.col("__row").alias(f"__rel_{r.name}"))
            return self._joined(base, parent, single, names, "inner" if r.kind == "one" else "left")
        if self.count is not None:
            child = child.withColumn("__n", numbered).where((F.col("__n") > self.skip) & (F.col("__n") <= self.skip + self.count))
        pairs = F.array_sort(F.collect_list(F.struct("__order", "__row")))  # without a comparator: sorted natively
        lists = child.groupBy(*names).agg(F.transform(pairs, lambda x: x["__row"]).alias(f"__rel_{r.name}"))
        out = self._joined(base, parent, lists, names, "left")
        kind = lists.schema[f"__rel_{r.name}"].dataType.simpleString()
        return out.withColumn(f"__rel_{r.name}", F.coalesce(F.col(f"`__rel_{r.name}`"), F.expr(f"cast(array() as {kind})")))

    def _order_parts(self) -> list[tuple[Column, bool, str]]:
        parts = [(o.value.column, o.descending, o.value.type) for o in self.orders]
        return parts + [(self.source.c(k).column, False, self.source.table.column(k).type) for k in self.source.table.primary_key or self.source.table.names]

    def _joined(self, base: DataFrame, parent: Source, child: DataFrame, names: list[str], how: str) -> DataFrame:
        on = _equal([(parent.c(a).column, F.col(n)) for (a, _), n in zip(self.relation.keys, names)])
        return base.join(child, on, how).drop(*names)

    def find_many(self) -> list[Row]:
        return self.df().collect()

    def find_first(self) -> Row | None:
        got = replace(self, count=1).df().collect()
        return got[0] if got else None


def _sortable(part: tuple[Column, bool, str], i: int) -> Column:
    """A value that sorts ascending: numbers and times are negated for DESC, texts
    become the complement of their bytes."""
    c, descending, kind = part
    if not descending:
        return F.struct(c.isNull().alias("n"), c.alias("v")).alias(f"o{i}")
    if kind in ("timestamp", "timestamptz", "date"):
        v = -F.unix_micros(c.cast("timestamp"))
    elif kind in ("text", "varchar", "char", "enum", "uuid", "json", "jsonb"):
        v = F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    elif kind == "bool":
        v = ~c
    else:
        v = -c
    return F.struct(c.isNotNull().alias("n"), v.alias("v")).alias(f"o{i}")


def _equal(pairs: list[tuple[Column, Column]]) -> Column:
    out = pairs[0][0] == pairs[0][1]
    for a, b in pairs[1:]:
        out = out & (a == b)
    return out


def hex_blobs(df: DataFrame) -> DataFrame:
    """Binary columns as hex text (null stays null), for JSON output."""
    return df.select(*[F.hex(f.name).alias(f.name) if f.dataType.simpleString() == "binary" else F.col(f.name) for f in df.schema.fields])
