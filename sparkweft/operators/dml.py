"""INSERT, UPDATE, DELETE and upserts as transforms of DataFrames.

A statement gives the table's new rows (`result`) and the rows it wrote, changed
or removed (`returning`). Nothing is overwritten in place: `execute` publishes the
result through a writer and counts the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.core import Expr, SchemaError, TransactionError, comparable, expr
from sparkweft.plans.schema import spark_type

from .select import Select, Source


@dataclass(frozen=True)
class Written:
    result: DataFrame
    returning: DataFrame


def _true(e: Expr | None) -> Column:
    """Rows whose condition is true; null is not."""
    return F.lit(True) if e is None else F.coalesce(e.column, F.lit(False))


def excluded(target: Source, column: str) -> Expr:
    """The proposed row's column in DO UPDATE."""
    d = target.table.column(column)
    return Expr(F.col(f"`excluded`.`{column}`"), d.type, d.nullable, "scalar", column, target.table.dialect, ("excluded", column))


@dataclass(frozen=True, eq=False)
class Insert:
    target: Source
    new: DataFrame | None = None
    conflict: tuple | None = None
    action: str = "error"
    assignments: tuple = ()
    update_where: Expr | None = None
    target_where: Expr | None = None

    def value(self, row: dict[str, Any]) -> Insert:
        return self.values([row])

    def values(self, rows: Iterable[dict[str, Any]]) -> Insert:
        """Rows that all set the same columns; others get their defaults."""
        rows, t = list(rows), self.target.table
        if not rows:
            raise ValueError("no rows to insert")
        names = list(rows[0])
        if any(list(r) != names for r in rows):
            raise ValueError("all rows must set the same columns")
        for n in names:
            t.column(n)
        missing = [c.name for c in t.columns if c.name not in names and not c.nullable and c.default is None]
        if missing:
            raise ValueError(f"no value for {', '.join(missing)}")
        given = self.target.frame.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` {spark_type(t.column(n).type)}" for n in names))
        return self._rows(given)

    def select(self, query: Select, columns: Iterable[str] | None = None) -> Insert:
        names = list(columns or self.target.table.names)
        kinds = query.types()
        if len(kinds) != len(names):
            raise TypeError(f"{len(kinds)} columns for {len(names)}")
        for n, k in zip(names, kinds):
            if not comparable(self.target.table.column(n).type, k, self.target.table.dialect):
                raise TypeError(f"{n}: no {k} can be assigned")
        return self._rows(query.df().toDF(*names))

    def _rows(self, given: DataFrame) -> Insert:
        t = self.target.table
        full = given.select(*[(F.col(f"`{c.name}`") if c.name in given.columns else F.lit(c.default)).cast(spark_type(c.type)).alias(c.name) for c in t.columns])
        return replace(self, new=full)

    def on_conflict(self, *columns: str, where: Expr | None = None) -> Conflict:
        """columns: a declared unique set. where: only rows in the partial index conflict."""
        t = self.target.table
        if set(columns) not in [set(u) for u in (t.primary_key, *t.unique) if u]:
            raise SchemaError(f"({', '.join(columns)}) is no unique set of {t.name}")
        return Conflict(self, columns, where)

    def on_conflict_on_constraint(self, name: str) -> Conflict:
        t = self.target.table
        found = {f"{t.name}_pkey": t.primary_key, **{f"{t.name}_{'_'.join(u)}_key": u for u in t.unique}}
        if name not in found:
            raise SchemaError(f"{t.name} has no constraint {name}")
        return Conflict(self, tuple(found[name]))

    def on_conflict_do_nothing(self) -> Insert:
        """Ignores rows that conflict with any unique set."""
        return replace(self, conflict=(), action="nothing")

    def where(self, condition: Any) -> Insert:
        """After DO UPDATE: only matching rows are updated."""
        if self.action != "update":
            raise SyntaxError("WHERE follows DO UPDATE")
        return replace(self, update_where=expr(condition))

    def write(self) -> Written:
        t, old = self.target.table, self.target.frame
        if self.new is None:
            raise SyntaxError("nothing to insert")
        if self.action == "error":
            new = self._unique(self.new, old)
            return Written(old.unionByName(new), new)
        sets = [self.conflict] if self.conflict else [u for u in (t.primary_key, *t.unique) if u]
        new, theirs = self.new.withColumn("__at", F.monotonically_increasing_id()), old
        if self.target_where is not None:
            theirs = old.alias(self.target.label).where(_true(self.target_where))
        for key in sets:
            # Of rows of one statement the first stays; an update by several of them is an
            # error, but in SQLite the last one's.
            last = self.action == "update" and t.dialect == "sqlite"
            n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("__at") if last else F.asc("__at")))
            once = F.col("__n") == 1
            if self.action == "update" and not last:
                once = F.when(once, True).otherwise(F.raise_error(F.lit(f"{t.name}: DO UPDATE would change a row of ({', '.join(key)}) twice")).cast("boolean"))
            new = new.withColumn("__n", n).where(F.when(_unknown(key), True).otherwise(once)).drop("__n")
            if self.action == "nothing":
                new = new.join(theirs.select(*key).dropna(), list(key), "left_anti")
        if self.action == "nothing":
            new = new.select(*t.names)
            return Written(old.unionByName(new), new)
        key, new = self.conflict, new.drop("__at")
        both = old.alias(self.target.label).join(new.withColumn("__new", F.lit(True)).alias("excluded"), _same(self.target.label, "excluded", key), "left")
        hit = F.coalesce(F.col("excluded.__new"), F.lit(False)) & _true(self.target_where) & _true(self.update_where)
        changes = dict(self.assignments)
        updated = both.select(*[(F.when(hit, changes[n].column.cast(spark_type(t.column(n).type))).otherwise(self.target.c(n).column) if n in changes else self.target.c(n).column).alias(n) for n in t.names], hit.alias("__hit"))
        fresh = new.join(theirs.select(*key).dropna(), list(key), "left_anti").select(*t.names)
        return Written(updated.drop("__hit").unionByName(fresh), updated.where("__hit").drop("__hit").unionByName(fresh))

    def _unique(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """The rows to insert; reading them fails where a key stands twice. A key that holds
        a null equals none."""
        t = self.target.table
        for key in [u for u in (t.primary_key, *t.unique) if u]:
            known = old.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).dropna().withColumn("__old", F.lit(True))
            same = _all([F.col(k) == F.col(f"__k{i}") for i, k in enumerate(key)])
            counted = new.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))).join(known, same, "left")
            twice = ~_unknown(key) & (F.col("__old").isNotNull() | (F.col("__n") > 1))
            message = F.concat(F.lit(f"{t.name}: duplicate key ({', '.join(key)}) = ("), F.concat_ws(", ", *[F.col(k).cast("string") for k in key]), F.lit(")"))
            new = counted.where(F.when(twice, F.raise_error(message).cast("boolean")).otherwise(True)).select(*t.names)
        return new

    def returning(self, *columns: str) -> DataFrame:
        return self.write().returning.select(*columns or self.target.table.names)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _unknown(key: Iterable[str]) -> Column:
    """Whether a part of the key is null."""
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])


def _same(a: str, b: str, key: Iterable[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & (F.col(f"`{a}`.`{k}`") == F.col(f"`{b}`.`{k}`"))
    return out


@dataclass(frozen=True, eq=False)
class Conflict:
    insert: Insert
    columns: tuple
    condition: Expr | None = None

    def where(self, condition: Any) -> Conflict:
        return replace(self, condition=expr(condition))

    def do_nothing(self) -> Insert:
        return replace(self.insert, conflict=tuple(self.columns), action="nothing", target_where=self.condition)

    def do_update(self, changes: dict[str, Any]) -> Insert:
        if not changes:
            raise ValueError("DO UPDATE sets at least one column")
        return replace(self.insert, conflict=tuple(self.columns), action="update", assignments=_assigned(self.insert.target, changes), target_where=self.condition)


def _assigned(target: Source, changes: dict[str, Any]) -> tuple:
    out = []
    for name, value in changes.items():
        e, c = expr(value), target.table.column(name)
        if not comparable(c.type, e.type, target.table.dialect):
            raise TypeError(f"{name}: {e.type} can't be assigned to {c.type}")
        out.append((name, e))
    return tuple(out)


@dataclass(frozen=True, eq=False)
class Update:
    target: Source
    changes: tuple = ()
    condition: Expr | None = None
    other: Source | None = None

    def set(self, changes: dict[str, Any]) -> Update:
        if not changes:
            raise ValueError("SET needs at least one column")
        return replace(self, changes=_assigned(self.target, changes))

    def from_(self, other: Source) -> Update:
        """UPDATE .. FROM: the condition joins the tables; of several matches the
        smallest row of the other table is taken."""
        return replace(self, other=other)

    def where(self, condition: Any) -> Update:
        return replace(self, condition=expr(condition))

    def write(self) -> Written:
        if not self.changes:
            raise SyntaxError("UPDATE needs SET")
        t, base = self.target.table, self.target.frame
        if self.other is not None:
            base = base.withColumn("__row", F.monotonically_increasing_id()) if not t.primary_key else base
            left = base.alias(self.target.label)
            hit_on = self.condition.column if self.condition is not None else F.lit(True)
            both = left.join(self.other.frame.withColumn("__other", F.lit(True)).alias(self.other.label), hit_on, "left")
            hit = F.coalesce(F.col(f"{self.other.label}.__other"), F.lit(False))
            ident = [f"{self.target.label}.{k}" for k in (t.primary_key or ("__row",))]
            others = [F.col(f"`{self.other.label}`.`{c}`") for c in self.other.table.names]
            n = F.row_number().over(Window.partitionBy(*ident).orderBy(*others))
            both = both.withColumn("__n", n).where("__n = 1")
        else:
            both, hit = base.alias(self.target.label), _true(self.condition)
        new = dict(self.changes)
        out = both.select(*[(F.when(hit, new[c].column.cast(spark_type(t.column(c).type))).otherwise(self.target.c(c).column) if c in new else self.target.c(c).column).alias(c) for c in t.names], hit.alias("__hit"))
        return Written(out.drop("__hit"), out.where("__hit").drop("__hit"))

    def returning(self, *columns: str) -> DataFrame:
        return self.write().returning.select(*columns or self.target.table.names)


@dataclass(frozen=True, eq=False)
class Delete:
    target: Source
    condition: Expr | None = None

    def where(self, condition: Any) -> Delete:
        return replace(self, condition=expr(condition))

    def write(self) -> Written:
        base, hit = self.target.aliased(), _true(self.condition)
        return Written(base.where(~hit), base.where(hit))

    def returning(self, *columns: str) -> DataFrame:
        return self.write().returning.select(*columns or self.target.table.names)


def insert(target: Source) -> Insert:
    return Insert(target)


def update(target: Source) -> Update:
    return Update(target)


def delete(target: Source) -> Delete:
    return Delete(target)


def execute(statement: Insert | Update | Delete, publish: Callable[[DataFrame], None]) -> int:
    """Publishes the new table and returns how many rows were written, changed or removed."""
    written = statement.write()
    n = written.returning.count()
    publish(written.result)
    return n


class Transaction:
    """Staged tables that are published together at the end, or not at all.

    with Transaction(db) as tx: tx.run(insert(tx.table("t")).value(..))
    """

    def __init__(self, database: Any, publish: Callable[[str, DataFrame], None] | None = None):
        self.database, self.publish = database, publish or (lambda name, df: database.register(name, df, database.table(name).table))
        self.staged: dict[str, DataFrame] = {}
        self.open = True

    def table(self, name: str) -> Source:
        base = self.database.table(name)
        return replace(base, frame=self.staged[name]) if name in self.staged else base

    def run(self, statement: Insert | Update | Delete) -> DataFrame:
        if not self.open:
            raise TransactionError("the transaction has ended")
        written = statement.write()
        self.staged[statement.target.table.name] = written.result
        return written.returning

    def savepoint(self, body: Callable[[Transaction], Any]) -> Any:
        """What body staged is dropped if it raises."""
        before = dict(self.staged)
        try:
            return body(self)
        except BaseException:
            self.staged = before
            raise

    def commit(self) -> None:
        if not self.open:
            raise TransactionError("the transaction has ended")
        self.open = False
        for name, df in self.staged.items():
            self.publish(name, df)

    def rollback(self) -> None:
        self.open, self.staged = False, {}

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_: Any) -> None:
        if self.open:
            self.rollback() if kind else self.commit()
