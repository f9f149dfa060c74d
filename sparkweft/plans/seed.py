"""Deterministic rows for declared tables, generated by expressions on executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import Column, Table, spark_type, topological_order

Generator = Callable[[SparkColumn, int], SparkColumn]
#: Words of generated text.
WORDS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "harbor", "inlet", "juniper")


def _hash(row: SparkColumn, seed: int, salt: str) -> SparkColumn:
    return F.xxhash64(row, F.lit(seed), F.lit(salt))


def infer_generator(column: Column) -> Generator:
    """By name first (id, email, name, .._at), then by type."""
    name, salt = column.name.lower(), column.name
    number = lambda row, seed, n: F.pmod(_hash(row, seed, salt), F.lit(n))
    word = lambda row, seed: F.element_at(F.array(*[F.lit(w) for w in WORDS]), (number(row, seed, len(WORDS)) + 1).cast("int"))
    if column.values:
        return lambda row, seed: F.element_at(F.array(*[F.lit(v) for v in column.values]), (number(row, seed, len(column.values)) + 1).cast("int"))
    if name == "id":
        return lambda row, seed: row + 1
    if "email" in name:
        return lambda row, seed: F.concat(word(row, seed), F.lit("."), row.cast("string"), F.lit("@example.com"))
    if name.endswith("_at") or column.type in ("timestamp", "timestamptz", "date"):
        return lambda row, seed: F.timestamp_seconds(F.lit(1_600_000_000) + number(row, seed, 100_000_000))
    by_type = {
        "bool": lambda row, seed: number(row, seed, 2) == 0,
        "float4": lambda row, seed: number(row, seed, 1_000_000) / 100.0,
        "float8": lambda row, seed: number(row, seed, 1_000_000) / 100.0,
        "numeric": lambda row, seed: number(row, seed, 1_000_000) / 100.0,
        "uuid": lambda row, seed: F.regexp_replace(F.md5(_hash(row, seed, salt).cast("string")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"),
        "blob": lambda row, seed: F.unhex(F.md5(_hash(row, seed, salt).cast("string"))),
        "json": lambda row, seed: F.to_json(F.struct(number(row, seed, 100).alias("k"))),
    }
    if column.type in ("int2", "int4", "int8"):
        return lambda row, seed: number(row, seed, 1000)
    return by_type.get(column.type, lambda row, seed: F.concat_ws(" ", word(row, seed), row.cast("string")))


@dataclass(frozen=True)
class SeedConfig:
    """SeedConfig(tables).seed(42).count("users", 100).relation("users", "posts", 3).generate(spark)"""

    tables: tuple
    number: int = 0
    counts: dict = field(default_factory=dict)
    per_parent: dict = field(default_factory=dict)
    generators: dict = field(default_factory=dict)

    def seed(self, number: int) -> SeedConfig:
        return replace(self, number=number)

    def count(self, table: str, n: int) -> SeedConfig:
        return replace(self, counts={**self.counts, table: n})

    def relation(self, parent: str, child: str, n: int) -> SeedConfig:
        return replace(self, per_parent={**self.per_parent, child: (parent, n)})

    def generator(self, table: str, column: str, make: Generator) -> SeedConfig:
        return replace(self, generators={**self.generators, (table, column): make})

    def generate(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Tables by name, parents first; a foreign key holds keys of its parent."""
        made: dict[str, DataFrame] = {}
        sizes: dict[str, int] = {}
        for t in topological_order(self.tables):
            parent = self.per_parent.get(t.name)
            sizes[t.name] = self.counts.get(t.name, sizes[parent[0]] * parent[1] if parent else 10)
            made[t.name] = self._table(spark, t, sizes)
        return made

    def _table(self, spark: SparkSession, t: Table, sizes: dict[str, int]) -> DataFrame:
        row = F.col("id")
        keys = {c: k for k in t.foreign_keys if len(k.columns) == 1 for c in k.columns}
        out = []
        for c in t.columns:
            make = self.generators.get((t.name, c.name)) or infer_generator(c)
            value = make(row, self.number)
            if c.name in keys and keys[c.name].table in sizes:
                parents, target = sizes[keys[c.name].table], next(x for x in self.tables if x.name == keys[c.name].table)
                spread = self.per_parent.get(t.name)
                number = F.floor(row / spread[1]) if spread and spread[0] == target.name else F.pmod(_hash(row, self.number, c.name), F.lit(max(1, parents)))
                theirs = target.column(keys[c.name].targets[0])
                value = infer_generator(theirs)(number, self.number)
            out.append(value.cast(spark_type(c.type)).alias(c.name))
        return spark.range(sizes[t.name]).select(*out)
