"""SELECT: clauses in SQL's order, checked eagerly, planned as one DataFrame."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkweft.functions.aggregates import Order
from sparkweft.functions.compare import Subquery
from sparkweft.functions.core import All, Either, Equal, Expr, Not, NotFound, SchemaError, comparable, expr
from sparkweft.plans.schema import Table, table_of

CLAUSES = ("start", "from", "join", "where", "group", "having", "set", "order", "limit", "offset", "lock")
#: Clause -> clauses it may follow.
AFTER = {
    "from": {"start"}, "join": {"from", "join"}, "where": {"from", "join"}, "group": {"from", "join", "where"}, "having": {"group"},
    "set": {"from", "join", "where", "group", "having", "order", "limit", "offset", "set"}, "order": {"from", "join", "where", "group", "having", "set"},
    "limit": {"from", "join", "where", "group", "having", "set", "order"}, "offset": {"from", "limit", "set", "order", "join", "where", "group", "having"}, "lock": {"from", "join", "where", "order", "limit", "offset", "lock"},
}


@dataclass(frozen=True, eq=False)
class Source:
    """A table, view, CTE or subquery under an alias; its columns are attributes."""

    table: Table
    frame: DataFrame
    label: str

    def alias(self, name: str) -> Source:
        return replace(self, label=name)

    def c(self, column: str) -> Expr:
        d = self.table.column(column)
        return Expr(F.col(f"`{self.label}`.`{column}`"), d.type, d.nullable, "scalar", column, self.table.dialect, (self.label, column))

    def __getattr__(self, column: str) -> Expr:
        if column.startswith("__"):
            raise AttributeError(column)
        return self.c(column)

    @property
    def columns(self) -> list[Expr]:
        return [self.c(n) for n in self.table.names]

    def aliased(self) -> DataFrame:
        return self.frame.alias(self.label)


def sources_of(e: Any) -> set[str]:
    """The aliases an expression refers to."""
    if isinstance(e, Order):
        return sources_of(e.value)
    own = {e.source[0]} if e.source else set()
    return own.union(*[sources_of(p) for p in e.parts]) if e.parts else own


def conjuncts(e: Expr) -> list[Expr]:
    """The parts of a conjunction that holds subqueries; other conditions stay whole."""
    if not isinstance(e, All) or not _holds_subquery(e):
        return [e]
    return [c for p in e.parts for c in conjuncts(p)]


def _and(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, columns)


def _or(columns: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, columns)


def _holds_subquery(e: Expr) -> bool:
    return isinstance(e, Subquery) or any(_holds_subquery(p) for p in e.parts)


@dataclass(frozen=True, eq=False)
class Select:
    dialect: str = "pg"
    items: tuple = ()
    distinct_rows: bool = False
    distinct_on: tuple = ()
    source: Source | None = None
    joins: tuple = ()
    condition: tuple = ()
    keys: tuple = ()
    group_condition: Expr | None = None
    orders: tuple = ()
    count: int | None = None
    skip: int | None = None
    set_left: Any = None
    notes: tuple = ()
    state: str = "start"
    locks: tuple = field(default=())

    def _to(self, state: str, **changes: Any) -> Select:
        if self.state not in AFTER[state]:
            raise SyntaxError(f"{state} can't follow {self.state}")
        return replace(self, state=state, **changes)

    # -- clauses -------------------------------------------------------------------

    def from_(self, source: Source | Select) -> Select:
        return self._to("from", source=source if isinstance(source, Source) else source.into_cte("subquery"))

    def _join(self, how: str, target: Any, on: Any = None, natural: bool = False, using: tuple = ()) -> Select:
        if isinstance(target, tuple):
            target, on = target
        if natural:
            mine = {n for s in self._scope() for n in s.table.names}
            using = tuple(n for n in target.table.names if n in mine)
        if using:
            for n in using:
                target.table.column(n)
        elif on is None and how != "cross":
            on = self._by_foreign_key(target)
        elif on is not None and expr(on).type not in ("bool", "any"):
            raise TypeError("ON takes a condition")
        return self._to("join", joins=(*self.joins, (how, target, on, tuple(using))))

    def _scope(self) -> list[Source]:
        return [self.source, *[j[1] for j in self.joins]]

    def _by_foreign_key(self, target: Source) -> Expr:
        """ON from the declared keys, in either direction; parts of a key are AND-ed."""
        from sparkweft.functions.compare import all_, eq

        found = []
        for s in self._scope():
            for a, b in ((s, target), (target, s)):
                found += [(a, b, k) for k in a.table.foreign_keys if k.table == b.table.name]
        if len(found) != 1:
            raise SchemaError(f"{len(found)} foreign keys lead to {target.table.name}; give a condition")
        a, b, k = found[0]
        return all_(*[eq(a.c(x), b.c(y)) for x, y in zip(k.columns, k.targets)])

    def join(self, target: Any, on: Any = None) -> Select:
        return self._join("inner", target, on)

    inner_join = join

    def left_join(self, target: Any, on: Any = None) -> Select:
        return self._join("left", target, on)

    left_outer_join = left_join

    def right_join(self, target: Any, on: Any = None) -> Select:
        return self._join("right", target, on)

    right_outer_join = right_join

    def full_join(self, target: Any, on: Any = None) -> Select:
        return self._join("full", target, on)

    full_outer_join = full_join

    def cross_join(self, target: Any, on: Any = None) -> Select:
        return self._join("cross", target, on)

    def natural_join(self, target: Source) -> Select:
        return self._join("inner", target, natural=True)

    natural_inner_join = natural_join

    def natural_left_join(self, target: Source) -> Select:
        return self._join("left", target, natural=True)

    natural_left_outer_join = natural_left_join

    def natural_right_join(self, target: Source) -> Select:
        return self._join("right", target, natural=True)

    natural_right_outer_join = natural_right_join

    def natural_full_join(self, target: Source) -> Select:
        return self._join("full", target, natural=True)

    natural_full_outer_join = natural_full_join

    def join_using(self, target: Source, *columns: str) -> Select:
        return self._join("inner", target, using=columns)

    inner_join_using = join_using

    def left_join_using(self, target: Source, *columns: str) -> Select:
        return self._join("left", target, using=columns)

    left_outer_join_using = left_join_using

    def right_join_using(self, target: Source, *columns: str) -> Select:
        return self._join("right", target, using=columns)

    right_outer_join_using = right_join_using

    def full_join_using(self, target: Source, *columns: str) -> Select:
        return self._join("full", target, using=columns)

    full_outer_join_using = full_join_using

    def where(self, *conditions: Any) -> Select:
        from sparkweft.functions.compare import all_

        flat = conditions[0] if len(conditions) == 1 and isinstance(conditions[0], tuple) else conditions
        whole = all_(*flat)
        if whole.kind in ("aggregate", "window", "mixed"):
            raise TypeError("WHERE can't hold aggregates or windows")
        return self._to("where", condition=tuple(conjuncts(whole)))

    def group_by(self, *keys: Any) -> Select:
        flat = keys[0] if len(keys) == 1 and isinstance(keys[0], (tuple, list)) else keys
        return self._to("group", keys=tuple(expr(k) for k in flat))

    def having(self, condition: Any) -> Select:
        return self._to("having", group_condition=expr(condition))

    def order_by(self, *keys: Any) -> Select:
        flat = keys[0] if len(keys) == 1 and isinstance(keys[0], (tuple, list)) else keys
        return self._to("order", orders=tuple(k if isinstance(k, (Order, str)) else Order(expr(k)) for k in flat))

    def limit(self, n: int) -> Select:
        return self._to("limit", count=_natural(n, "limit"))

    def offset(self, n: int) -> Select:
        return self._to("offset", skip=_natural(n, "offset"))

    def _set(self, how: str, other: Select) -> Select:
        a, b = self.types(), other.types()
        if len(a) != len(b) or not all(comparable(x, y, self.dialect) for x, y in zip(a, b)):
            raise TypeError(f"{how}: {a} against {b}")
        if "set" not in AFTER or self.state not in AFTER["set"]:
            raise SyntaxError(f"{how} can't follow {self.state}")
        return Select(dialect=self.dialect, items=self.items, set_left=(how, self, other), state="set")

    def union(self, other: Select) -> Select:
        return self._set("union", other)

    def union_all(self, other: Select) -> Select:
        return self._set("union_all", other)

    def intersect(self, other: Select) -> Select:
        return self._set("intersect", other)

    def intersect_all(self, other: Select) -> Select:
        return self._set("intersect_all", other)

    def except_(self, other: Select) -> Select:
        return self._set("except", other)

    def except_all(self, other: Select) -> Select:
        return self._set("except_all", other)

    def _lock(self, kind: str) -> Select:
        """Reads are snapshots: locks are recorded, and lock nothing."""
        if self.dialect != "pg":
            raise SyntaxError(f"{kind} needs the pg dialect")
        return self._to("lock", locks=(*self.locks, kind))

    def for_update(self) -> Select:
        return self._lock("for update")

    def for_share(self) -> Select:
        return self._lock("for share")

    def for_no_key_update(self) -> Select:
        return self._lock("for no key update")

    def for_key_share(self) -> Select:
        return self._lock("for key share")

    def for_update_of(self, table: Source) -> Select:
        return self._lock(f"for update of {table.label}")

    def for_share_of(self, table: Source) -> Select:
        return self._lock(f"for share of {table.label}")

    def nowait(self) -> Select:
        return self._lock("nowait")

    def skip_locked(self) -> Select:
        return self._lock("skip locked")

    def comment(self, text: str) -> Select:
        """Becomes the description of the query's jobs."""
        return replace(self, notes=(*self.notes, text.replace("*/", "* /").replace("/*", "/ *")))

    def comment_tags(self, pairs: dict[str, str]) -> Select:
        from urllib.parse import quote

        return self.comment(",".join(f"{quote(k, safe='')}='{quote(str(v), safe='')}'" for k, v in sorted(pairs.items())))

    # -- what it is ---------------------------------------------------------------

    def _selected(self) -> list[Expr]:
        if self.items:
            return list(self.items)
        if self.set_left:
            return self.set_left[1]._selected()
        merged = {n for _, _, _, u in self.joins for n in u}
        return [self.using_column(n) for n in dict.fromkeys(x for _, _, _, u in self.joins for x in u)] + [c for s in self._scope() for c in s.columns if c.name not in merged]

    def using_column(self, name: str) -> Expr:
        """The one column that USING and NATURAL make of equal names."""
        sides = [s.c(name) for s in self._scope() if name in s.table.names]
        return replace(sides[0], column=F.coalesce(*[s.column for s in sides]).alias(name), parts=tuple(sides), source=None)

    def names(self) -> list[str]:
        return [e.name or f"column{i + 1}" for i, e in enumerate(self._selected())]

    def types(self) -> list[str]:
        return [e.type for e in self._selected()]

    def nullables(self) -> list[bool]:
        """Whether each column may be null, with what outer joins add."""
        optional: set[str] = set()
        seen = {self.source.label} if self.source else set()
        for how, t, _, _ in self.joins:
            optional |= ({t.label} if how in ("left", "full") else set()) | (seen if how in ("right", "full") else set())
            seen.add(t.label)
        return [e.nullable or bool(sources_of(e) & optional) and e.kind != "aggregate" for e in self._selected()]

    def into_cte(self, name: str) -> Source:
        df = self.df()
        table = replace(table_of(name, df, dialect=self.dialect), columns=tuple(replace(c, type=t) if t != "any" else c for c, t in zip(table_of(name, df).columns, self.types())))
        return Source(table, df, name)

    def scalar(self) -> Expr:
        if len(self.types()) != 1:
            raise TypeError("a scalar subquery has one column")
        return Expr(self.df().scalar(), self.types()[0], True, "constant", None, self.dialect)

    # -- the plan -------------------------------------------------------------------

    def df(self) -> DataFrame:
        if self.set_left:
            return self._tail(self._set_plan(), set())
        if self.source is None:
            raise SyntaxError("a query needs FROM")
        base = self._joined()
        for c in self.condition:
            base = self._filtered(base, c)
        return self._projected(base)

    def _limits_source(self) -> bool:
        """Whether each row of the source becomes one group of its own, in its key's order:
        then LIMIT takes rows of the source before anything is joined."""
        key = {(self.source.label, k) for k in self.source.table.primary_key}
        return (
            self.count is not None and bool(key) and {k.source for k in self.keys} == key
            and bool(self.orders) and {o.value.source for o in self.orders if isinstance(o, Order)} == key and all(isinstance(o, Order) for o in self.orders)
            and all(how == "left" for how, _, _, _ in self.joins) and not (self.condition or self.distinct_rows or self.distinct_on) and self.group_condition is None
        )

    def _joined(self) -> DataFrame:
        base, seen = self.source.aliased(), [self.source]
        if self._limits_source():
            base = base.orderBy(*[o.column for o in self.orders]).limit((self.skip or 0) + self.count).alias(self.source.label)
        for how, target, on, using in self.joins:
            right = target.aliased()
            if using:
                pairs = [F.coalesce(*[s.c(n).column for s in seen if n in s.table.names]) == target.c(n).column for n in using]
                base = base.join(right, functools.reduce(lambda a, b: a & b, pairs), how)
            elif how == "cross":
                base = base.crossJoin(right) if on is None else base.join(right, expr(on).column, "inner")
            else:
                base = base.join(right, expr(on).column, how)
            seen.append(target)
        return base

    def _labels(self) -> set[str]:
        return {s.label for s in self._scope()} if self.source else set()

    def _ties(self) -> list[Expr]:
        """Conditions of this subquery that refer to the query around it."""
        own = self._labels()
        return [c for c in self.condition if sources_of(c) - own]

    def _plain(self) -> bool:
        """Rows of FROM and WHERE alone decide whether there is a row."""
        return not (self.keys or self.set_left or self.distinct_on or self.skip) and self.count != 0 and not any(e.kind in ("aggregate", "mixed") for e in self._selected())

    def _filtered(self, base: DataFrame, c: Expr) -> DataFrame:
        """Alone in a conjunction a subquery becomes a semi or anti join, or is met
        once for all rows; anywhere else it is an expression."""
        if not isinstance(c, Subquery):
            return base.where(c.column)
        q, ties = c.query, c.query._ties()
        if ties:
            simple = q._plain() and (q.count is None or not c.parts) and not any(_holds_subquery(t) for t in ties)
            if not simple or c.mode == "not_in":
                return base.where(c.column)
            inner = replace(q, condition=tuple(x for x in q.condition if x not in ties), items=(), orders=(), count=None)
            frame = inner._joined()
            for x in inner.condition:
                frame = inner._filtered(frame, x)
            on = _and([x.column for x in ties] + [p.column == i.column for p, i in zip(c.parts, q._selected())])
            return base.join(frame, on, "left_semi" if c.mode in ("in", "exists") else "left_anti")
        if c.mode in ("exists", "not_exists"):
            found = q.df().limit(1).agg((F.count(F.lit(1)) > 0).alias("__found"))
            return base.crossJoin(F.broadcast(found)).where(F.col("__found") if c.mode == "exists" else ~F.col("__found")).drop("__found")
        if c.mode == "not_in" and len(c.parts) > 1:
            return base.where(c.column)
        frame = q.df().toDF(*[f"__s{i}" for i in range(len(c.parts))])
        equal = [p.column == F.col(f"__s{i}") for i, p in enumerate(c.parts)]
        if c.mode == "in":
            return base.join(frame, _and(equal), "left_semi")
        facts = frame.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__s0").isNull()).alias("__nulls"))
        sure = (F.col("__n") == 0) | ((F.col("__nulls") == 0) & c.parts[0].column.isNotNull())
        return base.crossJoin(F.broadcast(facts)).where(sure).drop("__n", "__nulls").join(frame, equal[0], "left_anti")

    # -- subqueries as expressions -----------------------------------------------------

    def condition_column(self, mode: str, parts: list[Expr]) -> Column:
        """EXISTS or IN with SQL's three values, for any place a condition may stand in.
        Catalyst plans each as an existence join on the equalities it holds."""
        if self.count == 0:
            found = F.lit(False)
        elif mode in ("exists", "not_exists"):
            always = not self.keys and not self.set_left and not self.skip and any(e.kind in ("aggregate", "mixed") for e in self._selected())
            found = F.lit(True) if always else replace(self, count=None, orders=())._found()
        else:
            found = self._contains(parts)
        return ~found if mode.startswith("not_") else found

    def _found(self, extra: Column | None = None) -> Column:
        """Whether there is a row; extra: a condition on columns __s0, .. and the query around."""
        frame, tied = self._rows_and_ties()
        on = tied + ([extra] if extra is not None else [])
        return frame.where(_and(on).outer()).exists() if on else frame.exists()

    def _rows_and_ties(self) -> tuple[DataFrame, list[Column]]:
        """The rows with columns __s0, .., and the conditions that tie them to the query around."""
        names, ties = [f"__s{i}" for i in range(len(self._selected()))], self._ties()
        if not ties:
            return self.df().toDF(*names).alias("__sub"), []  # an alias hides the names below it
        rest = tuple(c for c in self.condition if c not in ties)
        if self._plain() and self.count is None:
            inner = replace(self, condition=rest)
            frame = inner._joined()
            for c in rest:
                frame = inner._filtered(frame, c)
            return frame.select("*", *[e.column.alias(n) for e, n in zip(self._selected(), names)]), [t.column for t in ties]
        if self.skip or self.distinct_on or not self.keys:
            raise TypeError("a correlated subquery with LIMIT, OFFSET, DISTINCT ON or an aggregate of all rows can't be planned as a join")
        # Groups within each tie: what the query around compares becomes a key.
        own = self._labels()
        pairs = []
        for t in ties:
            sides = sorted(t.parts, key=lambda e: bool(sources_of(e) - own)) if isinstance(t, Equal) else []
            if not sides or sources_of(sides[0]) - own or sources_of(sides[1]) & own:
                raise TypeError("a grouped subquery is tied to the query around by equalities")
            pairs.append(sides)
        keys = [replace(inner, name=f"__t{i}") for i, (inner, _) in enumerate(pairs)]
        grouped = replace(self, condition=rest, keys=(*self.keys, *keys), items=(*self._selected(), *keys), orders=(), count=None)
        frame = grouped.df().toDF(*names, *[k.name for k in keys])
        return frame.alias("__sub"), [F.col(k.name) == outer.column for k, (_, outer) in zip(keys, pairs)]

    def _contains(self, parts: list[Expr]) -> Column:
        """IN: true if a row equals, null if one might, else false. A row might equal where
        parts that aren't null on either side agree; only parts that may be null matter."""
        if self._ties() and self.count is not None:
            raise TypeError("IN over a correlated subquery with LIMIT can't be planned as a join")
        columns = [F.col(f"__s{i}") for i in range(len(parts))]
        equal = [p.column == c for p, c in zip(parts, columns)]
        hit = self._found(_and(equal))
        maybe = [i for i, (p, n) in enumerate(zip(parts, self.nullables())) if p.nullable or n]
        wild = [set(some) for n in range(1, len(maybe) + 1) for some in itertools.combinations(maybe, n)]
        unknown = [self._found(_and([parts[i].column.isNull() | columns[i].isNull() if i in some else equal[i] for i in range(len(parts))])) for some in wild if len(some) < len(parts) or self._ties()]
        if len(maybe) == len(parts) and not self._ties():
            # No part is left to compare: counts of the rows whose parts are null say it.
            frame, _ = self._rows_and_ties()
            every = range(len(parts))
            for n in range(len(parts) + 1):
                for null in itertools.combinations(every, n):
                    rows = frame.agg(F.count_if(_and([columns[i].isNull() for i in null]) if null else F.lit(True))).scalar()
                    unknown.append(_and([rows > 0, *[parts[i].column.isNull() for i in every if i not in null]]))
        out = F.when(hit, F.lit(True))
        return (out.when(_or(unknown), F.lit(None)) if unknown else out).otherwise(F.lit(False))

    def _having(self, e: Expr, columns: list[Column]) -> Column:
        """HAVING over the aggregated rows: its parts become columns of the aggregation."""
        if isinstance(e, Subquery):
            operands = []
            for p in e.parts:
                columns.append(p.column)
                operands.append(replace(p, column=F.col(f"__h{len(columns) - 1}"), source=None, parts=()))
            return e.query.condition_column(e.mode, operands)
        if isinstance(e, (All, Either, Not)) and _holds_subquery(e):
            own = [self._having(p, columns) for p in e.parts]
            return ~own[0] if isinstance(e, Not) else _and(own) if isinstance(e, All) else _or(own)
        if _holds_subquery(e):
            raise TypeError("in HAVING a subquery stands alone or under AND, OR, NOT")
        columns.append(e.column)
        return F.col(f"__h{len(columns) - 1}")

    def _grouped(self, items: list[Expr]) -> tuple[list[Expr], set[str]]:
        """Checks the select list against the keys; the aliases whose whole primary key is grouped."""
        by_key = {k.source for k in self.keys if k.source}
        whole = set()
        for s in self._scope():
            if len(s.table.primary_key) == 1 and (s.label, s.table.primary_key[0]) in by_key:
                whole.add(s.label)
        for e in items:
            if e.kind == "scalar" and e.source not in by_key and not any(e is k for k in self.keys):
                leaves = _leaves(e)
                if not all(x.source in by_key or x.source and x.source[0] in whole for x in leaves):
                    raise TypeError(f"column {e.name or e.source} must be grouped or aggregated")
            if e.kind == "mixed":
                if not all(x.source in by_key or x.source and x.source[0] in whole for x in _leaves(e, False)):
                    raise TypeError("an expression mixes aggregates with columns that aren't grouped")
        return items, whole

    def _projected(self, base: DataFrame) -> DataFrame:
        items = self._selected()
        named = [(e, n) for e, n in zip(items, self.names())]
        order_columns: list[Column] = []
        extra: list[tuple[Expr, str]] = []
        for i, o in enumerate(self.orders):
            if isinstance(o, str):
                order_columns.append(Order(replace(items[self.names().index(o)], column=F.col(f"`{o}`"))).column)
                continue
            name = next((n for e, n in named if e is o.value or e.source and e.source == o.value.source), None)
            if name is None:
                name = f"__o{i}"
                extra.append((o.value, name))
            order_columns.append(Order(replace(o.value, column=F.col(f"`{name}`")), o.descending).column)
        aggregated = any(e.kind in ("aggregate", "mixed") for e, _ in [*named, *extra])
        if self.keys:
            self._grouped([e for e, _ in [*named, *extra] if e.kind != "window"])
            keys = {k.source or id(k): k for k in self.keys}
            columns = [e.column.alias(n) for e, n in [*named, *extra]]
            # Columns that depend on a grouped primary key are keys as well: they change no
            # group, and the aggregation stays one by hashes.
            dependent = {x.source: x.column for e, _ in [*named, *extra] if e.kind in ("scalar", "mixed") and not (e.source in keys or id(e) in keys) for x in _leaves(e, False) if x.source and x.source not in keys}
            met: list[Column] = []
            condition = self._having(self.group_condition, met) if self.group_condition is not None else None
            having = [c.alias(f"__h{i}") for i, c in enumerate(met)]
            out = base.groupBy(*[k.column for k in self.keys], *dependent.values()).agg(*columns, *having)
            grouped = [f"__k{i}" for i in range(len(self.keys) + len(dependent))]
            out = out.toDF(*grouped, *out.columns[len(grouped) :]).drop(*grouped)
            out = out.where(condition).drop(*[f"__h{i}" for i in range(len(met))]) if condition is not None else out
        elif aggregated:
            out = base.agg(*[(F.any_value(e.column) if e.kind == "scalar" else e.column).alias(n) for e, n in [*named, *extra]])
        else:
            columns = [e.column.alias(n) for e, n in [*named, *extra]]
            if self.distinct_on:
                first = Window.partitionBy(*[expr(k).column for k in self.distinct_on]).orderBy(*[o.column for o in self.orders] or [F.lit(0)])
                out = base.select(*columns, F.row_number().over(first).alias("__first")).where("__first = 1").drop("__first")
            else:
                out = base.select(*columns)
        if self.distinct_rows:
            if extra:
                raise TypeError("with DISTINCT, sort keys have to be selected")
            out = out.distinct()
        out = out.orderBy(*order_columns) if order_columns else out
        return self._cut(out).drop(*[n for _, n in extra])

    def _cut(self, out: DataFrame) -> DataFrame:
        out = out.offset(self.skip) if self.skip else out
        return out.limit(self.count) if self.count is not None else out

    def _set_plan(self) -> DataFrame:
        how, a, b = self.set_left
        x, y = a.df(), b.df()
        y = y.toDF(*x.columns)
        return {"union": lambda: x.union(y).distinct(), "union_all": lambda: x.union(y), "intersect": lambda: x.intersect(y), "intersect_all": lambda: x.intersectAll(y), "except": lambda: x.subtract(y), "except_all": lambda: x.exceptAll(y)}[how]()

    def _tail(self, out: DataFrame, _: set) -> DataFrame:
        columns = []
        for o in self.orders:
            e = o if isinstance(o, Order) else Order(replace(self._selected()[self.names().index(o)], column=F.col(f"`{o}`")))
            columns.append(Order(replace(e.value, column=F.col(f"`{e.value.name}`")) if e.value.name else e.value, e.descending).column)
        return self._cut(out.orderBy(*columns) if columns else out)

    # -- actions ----------------------------------------------------------------------

    def _ready(self) -> DataFrame:
        df = self.df()
        if self.notes:
            df.sparkSession.sparkContext.setJobDescription(" ".join(self.notes))
        return df

    def all(self) -> list[Row]:
        return self._ready().collect()

    def rows(self) -> Iterator[Row]:
        return self._ready().toLocalIterator()

    def get(self) -> Row:
        got = self._ready().limit(1).collect()
        if not got:
            raise NotFound("the query returned no row")
        return got[0]


def _leaves(e: Expr, within_aggregates: bool = True) -> list[Expr]:
    if e.source:
        return [e]
    if e.kind == "aggregate" and not within_aggregates:
        return []
    return [x for p in e.parts for x in _leaves(p, within_aggregates)]


def _natural(n: int, what: str) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise ValueError(f"{what} takes a natural number, not {n!r}")
    return n
