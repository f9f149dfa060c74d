"""A database: declared tables over parquet folders, tables or DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkweft.functions.core import SchemaError, expr
from sparkweft.operators.select import Select, Source
from sparkweft.plans.schema import ForeignKey, Snapshot, Table, introspect, table_of, topological_order

#: Keys of the tables that the test data has.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",)}
FOREIGN = {
    "nation": [ForeignKey(("n_regionkey",), "region", ("r_regionkey",))], "customer": [ForeignKey(("c_nationkey",), "nation", ("n_nationkey",))], "supplier": [ForeignKey(("s_nationkey",), "nation", ("n_nationkey",))],
    "orders": [ForeignKey(("o_custkey",), "customer", ("c_custkey",))],
    "lineitem": [ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey(("l_partkey",), "part", ("p_partkey",)), ForeignKey(("l_suppkey",), "supplier", ("s_suppkey",))],
}


class Database:
    """Its queries are plans; nothing runs before an action."""

    def __init__(self, spark: SparkSession, dialect: str = "pg", folder: str | None = None):
        self.spark, self.dialect, self.folder = spark, dialect, folder
        self._tables: dict[str, Source] = {}
        self._stored: dict[str, Select] = {}

    def register(self, name: str, df: DataFrame, table: Table | None = None) -> Source:
        table = table or table_of(name, df, KEYS.get(name, ()), FOREIGN.get(name, ()), self.dialect)
        self._tables[name] = Source(replace(table, dialect=self.dialect), df, name)
        return self._tables[name]

    def table(self, name: str) -> Source:
        if name not in self._tables:
            if self.folder is None:
                raise SchemaError(f"no table {name}")
            self.register(name, self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        return self._tables[name]

    def __getattr__(self, name: str) -> Source:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    # -- queries -------------------------------------------------------------------

    def select(self, *items: Any) -> Select:
        return Select(self.dialect, tuple(expr(i) for i in items))

    def select_distinct(self, *items: Any) -> Select:
        return Select(self.dialect, tuple(expr(i) for i in items), True)

    def select_distinct_on(self, on: Any, *items: Any) -> Select:
        """The first row of each key, by ORDER BY (pg)."""
        if self.dialect != "pg":
            raise SyntaxError("DISTINCT ON needs the pg dialect")
        return Select(self.dialect, tuple(expr(i) for i in items), False, tuple(on) if isinstance(on, (tuple, list)) else (on,))

    def with_(self, *ctes: Source) -> Database:
        """CTEs are named plans: they can be used as sources, also before DML."""
        other = Database(self.spark, self.dialect, self.folder)
        other._tables = {**self._tables, **{c.label: c for c in ctes}}
        return other

    # -- views, tables, catalog -------------------------------------------------------

    def create_view(self, name: str, query: Select) -> Source:
        query.df().createOrReplaceTempView(name)
        return self.register(name, self.spark.table(name))

    def create_materialized_view(self, name: str, query: Select) -> Source:
        query.df().write.mode("overwrite").saveAsTable(name)
        self._stored[name] = query
        return self.register(name, self.spark.table(name))

    def refresh_materialized_view(self, name: str, with_data: bool = True) -> Source:
        """Runs the stored query again; without data the table becomes empty."""
        df = self._stored[name].df()
        (df if with_data else df.limit(0)).write.mode("overwrite").saveAsTable(name)
        self.spark.catalog.refreshTable(name)
        return self.register(name, self.spark.table(name))

    def create(self, tables: Iterable[Table]) -> list[str]:
        """Creates every table, referenced ones first; returns the statements."""
        statements = [t.ddl() for t in topological_order(tables)]
        for s in statements:
            self.spark.sql(s)
        return statements

    def introspect(self) -> Snapshot:
        return introspect(self.spark)


def read_parquet(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Needs the driver's jar on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()
