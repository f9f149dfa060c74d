"""Migrations: files that are applied once, in order, and recorded with a hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from sparkweft.functions.core import SchemaError

from .schema import Plan, Snapshot, diff, introspect


@dataclass(frozen=True)
class Migration:
    name: str
    statements: tuple

    @property
    def hash(self) -> str:
        return hashlib.sha256(";\n".join(self.statements).encode()).hexdigest()


def include_migrations(folder: str | Path) -> list[Migration]:
    """A folder of NAME.sql or NAME/migration.sql files, by name."""
    found = []
    for p in sorted(Path(folder).iterdir()):
        file = p / "migration.sql" if p.is_dir() else p
        if file.suffix == ".sql" and file.exists():
            parts = [s.strip() for s in file.read_text().split(";")]
            found.append(Migration(p.stem, tuple(s for s in parts if s)))
    return found


def pending(migrations: Iterable[Migration], applied: dict[str, str]) -> list[Migration]:
    """Those not yet applied; one that changed after it was applied is an error."""
    out = []
    for m in migrations:
        if m.name not in applied:
            out.append(m)
        elif applied[m.name] != m.hash:
            raise SchemaError(f"migration {m.name} has changed since it was applied")
    return out


class Tracking:
    """The table of applied migrations."""

    def __init__(self, spark: SparkSession, table: str = "applied_migrations"):
        self.spark, self.table = spark, table

    def applied(self) -> dict[str, str]:
        if not self.spark.catalog.tableExists(self.table):
            return {}
        return {r.name: r.hash for r in self.spark.table(self.table).collect()}

    def record(self, m: Migration) -> None:
        self.spark.createDataFrame([(m.name, m.hash)], "name string, hash string").write.mode("append").saveAsTable(self.table)


def migrate(spark: SparkSession, migrations: Iterable[Migration], tracking: Tracking | None = None, run: Callable[[str], object] | None = None) -> list[str]:
    """Applies what is pending; a failure leaves the earlier ones recorded."""
    tracking, run, done = tracking or Tracking(spark), run or spark.sql, []
    for m in pending(migrations, tracking.applied()):
        for statement in m.statements:
            run(statement)
        tracking.record(m)
        done.append(m.name)
    return done


def push(spark: SparkSession, wanted: Snapshot) -> Plan:
    """Applies the difference between the live catalog and a schema, without files."""
    names = {t.name for t in spark.catalog.listTables() if not t.isTemporary}
    plan = diff(introspect(spark, sorted(names & set(wanted.tables))), wanted)
    for statement in plan.statements:
        if not statement.startswith("--"):
            spark.sql(statement)
    return plan
