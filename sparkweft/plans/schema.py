"""Declared tables: columns, keys, relations, snapshots and their differences."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweft.functions.core import SPARK, SchemaError


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "text"
    nullable: bool = True
    default: object = None
    values: tuple = ()  # of an enum, in declared order


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple
    table: str
    targets: tuple


@dataclass(frozen=True)
class Table:
    """primary_key and foreign_keys are advisory: check() tests them with a query."""

    name: str
    columns: tuple
    primary_key: tuple = ()
    foreign_keys: tuple = ()
    unique: tuple = ()
    dialect: str = "pg"

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"{self.name} has no column {name}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self, model: str = "select") -> T.StructType:
        """The row types: select; insert (defaults are optional); update and partial (all optional)."""
        optional = {"select": lambda c: c.nullable, "insert": lambda c: c.nullable or c.default is not None, "update": lambda c: True, "partial": lambda c: True}[model]
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(spark_type(c.type)), optional(c)) for c in self.columns])

    def ddl(self) -> str:
        columns = ", ".join(f"`{c.name}` {spark_type(c.type).upper()}{'' if c.nullable else ' NOT NULL'}" for c in self.columns)
        return f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet"


def spark_type(kind: str) -> str:
    return f"array<{spark_type(kind[:-2])}>" if kind.endswith("[]") else SPARK[kind]


def sql_type(kind: T.DataType) -> str:
    """The SQL type of a Spark type."""
    if isinstance(kind, T.ArrayType):
        return f"{sql_type(kind.elementType)}[]"
    if isinstance(kind, T.DecimalType):
        return "numeric"
    names = {"smallint": "int2", "int": "int4", "bigint": "int8", "float": "float4", "double": "float8", "string": "text", "boolean": "bool", "binary": "blob", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz"}
    return names.get(kind.simpleString(), "any")


def table_of(name: str, df: DataFrame, primary_key: Iterable[str] = (), foreign_keys: Iterable[ForeignKey] = (), dialect: str = "pg") -> Table:
    columns = tuple(Column(f.name, sql_type(f.dataType), f.nullable and f.name not in set(primary_key)) for f in df.schema.fields)
    return Table(name, columns, tuple(primary_key), tuple(foreign_keys), (), dialect)


def topological_order(tables: Iterable[Table]) -> list[Table]:
    """Referenced tables before those that refer to them; names break ties.
    A table may refer to itself; a longer cycle is an error."""
    by_name = {t.name: t for t in tables}
    needs = {n: {k.table for k in t.foreign_keys if k.table in by_name and k.table != n} for n, t in by_name.items()}
    order: list[Table] = []
    while needs:
        ready = sorted(n for n, own in needs.items() if not own)
        if not ready:
            raise SchemaError(f"foreign keys form a cycle among {', '.join(sorted(needs))}")
        order += [by_name[n] for n in ready]
        needs = {n: own - set(ready) for n, own in needs.items() if n not in ready}
    return order


seeding_order = topological_order


@dataclass(frozen=True)
class Violation:
    table: str
    rule: str
    rows: int


def check(table: Table, df: DataFrame, parents: dict[str, DataFrame] | None = None) -> list[Violation]:
    """Rows that break a primary key, a NOT NULL, an enum or a foreign key."""
    found = []
    for c in table.columns:
        if not c.nullable and (n := df.where(F.col(c.name).isNull()).count()):
            found.append(Violation(table.name, f"{c.name} is null", n))
        if c.values and (n := df.where(~F.col(c.name).isin(list(c.values))).count()):
            found.append(Violation(table.name, f"{c.name} is no value of its enum", n))
    for key in filter(None, [table.primary_key, *table.unique]):
        if n := df.groupBy(*key).count().where("count > 1").count():
            found.append(Violation(table.name, f"({', '.join(key)}) is not unique", n))
    for fk in table.foreign_keys:
        if parents and fk.table in parents:
            own = [F.col(c).alias(f"k{i}") for i, c in enumerate(fk.columns)]
            theirs = [F.col(c).alias(f"k{i}") for i, c in enumerate(fk.targets)]
            if n := df.select(*own).dropna().join(parents[fk.table].select(*theirs), [f"k{i}" for i in range(len(own))], "left_anti").count():
                found.append(Violation(table.name, f"({', '.join(fk.columns)}) refers to no row of {fk.table}", n))
    return found


# -- snapshots and differences -----------------------------------------------------------


@dataclass(frozen=True)
class Change:
    """add_table, drop_table, rename_table, add_column, drop_column, rename_column, alter_column or rebuild."""

    kind: str
    table: str
    column: str | None = None
    detail: str = ""


@dataclass(frozen=True)
class Plan:
    changes: tuple
    statements: tuple


@dataclass(frozen=True)
class Snapshot:
    tables: dict = field(default_factory=dict)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps({n: asdict(t) for n, t in sorted(self.tables.items())}, sort_keys=True, default=str).encode()).hexdigest()


def snapshot(tables: Iterable[Table]) -> Snapshot:
    return Snapshot({t.name: t for t in tables})


def introspect(spark: SparkSession, names: Iterable[str] | None = None) -> Snapshot:
    """The session's catalog as a snapshot."""
    found = names if names is not None else [t.name for t in spark.catalog.listTables()]
    return Snapshot({n: table_of(n, spark.table(n)) for n in found})


def diff(before: Snapshot, after: Snapshot) -> Plan:
    return diff_with(before, after)


def diff_schemas(before: Iterable[Table], after: Iterable[Table]) -> Plan:
    return diff(snapshot(before), snapshot(after))


#: Changes of type that keep every value.
WIDER = {("int2", "int4"), ("int2", "int8"), ("int4", "int8"), ("float4", "float8"), ("varchar", "text"), ("char", "text")}


def diff_with(before: Snapshot, after: Snapshot, renames: dict[str, str] | None = None, strict: bool = False) -> Plan:
    """renames: 'old' -> 'new' of tables, 'table.old' -> 'new' of columns. With
    strict, what would lose data is an error."""
    renames = renames or {}
    changes: list[Change] = []
    old = dict(before.tables)
    for a, b in renames.items():
        if "." not in a and a in old and b in after.tables:
            old[b] = old.pop(a)
            changes.append(Change("rename_table", a, detail=b))
    for t in topological_order(t for n, t in after.tables.items() if n not in old):
        changes.append(Change("add_table", t.name))
    for name, t in sorted(after.tables.items()):
        if name not in old:
            continue
        was, now = {c.name: c for c in old[name].columns}, {c.name: c for c in t.columns}
        for a, b in renames.items():
            if a.startswith(f"{name}.") and (c := a.split(".", 1)[1]) in was and b in now:
                was[b] = was.pop(c)
                changes.append(Change("rename_column", name, c, b))
        rebuilt = False
        for c in now.values():
            if c.name not in was:
                changes.append(Change("add_column", name, c.name, spark_type(c.type)))
            elif was[c.name].type != c.type:
                if (was[c.name].type, c.type) not in WIDER and strict:
                    raise SchemaError(f"{name}.{c.name}: {was[c.name].type} to {c.type} may lose values")
                changes.append(Change("alter_column", name, c.name, spark_type(c.type)))
                rebuilt = True
        for c in was:
            if c not in now:
                if strict:
                    raise SchemaError(f"{name}.{c} would be dropped")
                changes.append(Change("drop_column", name, c))
                rebuilt = True
        if rebuilt:
            changes.append(Change("rebuild", name))
    for t in reversed(topological_order(t for n, t in old.items() if n not in after.tables)):
        if strict:
            raise SchemaError(f"table {t.name} would be dropped")
        changes.append(Change("drop_table", t.name))
    return Plan(tuple(changes), tuple(s for c in changes for s in _statements(c, after)))


def _statements(c: Change, after: Snapshot) -> list[str]:
    """Spark tables of plain files can add columns; other changes rewrite the table."""
    return {
        "add_table": lambda: [after.tables[c.table].ddl()],
        "drop_table": lambda: [f"DROP TABLE IF EXISTS {c.table}"],
        "rename_table": lambda: [f"ALTER TABLE {c.table} RENAME TO {c.detail}"],
        "add_column": lambda: [f"ALTER TABLE {c.table} ADD COLUMNS (`{c.column}` {c.detail.upper()})"],
        "rebuild": lambda: [f"-- rewrite {c.table}: {', '.join(after.tables[c.table].names)}"],
    }.get(c.kind, list)()


def conform(df: DataFrame, table: Table, renames: dict[str, str] | None = None) -> DataFrame:
    """df in the form of table: columns renamed, cast, added with their defaults, dropped."""
    back = {new: old for old, new in (renames or {}).items()}
    out = []
    for c in table.columns:
        have = back.get(c.name, c.name)
        value = F.col(have).cast(spark_type(c.type)) if have in df.columns else F.lit(c.default).cast(spark_type(c.type))
        out.append(value.alias(c.name))
    return df.select(*out)
