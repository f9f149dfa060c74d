"""Prepared statements: SQL text with named, typed parameters, bound on each run."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sparkweft.functions.core import Expr, ParameterError, comparable, literal


@dataclass(frozen=True)
class Placeholder:
    name: str
    type: str = "any"
    nullable: bool = False

    @classmethod
    def named(cls, name: str) -> Placeholder:
        return cls(name, "any", True)

    @classmethod
    def typed(cls, name: str, column: Expr) -> Placeholder:
        """Takes values that compare with the column."""
        return cls(name, column.type, column.nullable)

    def bind(self, value: Any) -> Bound:
        if value is None:
            raise ParameterError(f"{self.name} takes no null; use bind_opt")
        return self.bind_opt(value)

    def bind_opt(self, value: Any) -> Bound:
        if value is not None and not comparable(self.type, literal(value).type):
            raise TypeError(f"{self.name} takes {self.type}, not {literal(value).type}")
        return Bound(self.name, value)


@dataclass(frozen=True)
class Bound:
    name: str
    value: Any


def _checked(names: set[str], bound: tuple[Bound, ...]) -> dict[str, Any]:
    given = [b.name for b in bound]
    for what, wrong in (("twice", {n for n in given if given.count(n) > 1}), ("missing", names - set(given)), ("unknown", set(given) - names)):
        if wrong:
            raise ParameterError(f"{what}: {', '.join(sorted(wrong))}")
    return {b.name: b.value for b in bound}


@dataclass(frozen=True)
class Statement:
    """SQL text with :name parameters; views of the session are its tables."""

    spark: SparkSession
    text: str

    @property
    def names(self) -> set[str]:
        bare = re.sub(r"'(?:[^']|'')*'", "", self.text)
        return set(re.findall(r"(?<![:\w]):(\w+)", bare))

    def run(self, *bound: Bound) -> DataFrame:
        return self.spark.sql(self.text, args=_checked(self.names, bound))


@dataclass(frozen=True)
class Plan:
    """A builder whose values are placeholders: build(values) -> query."""

    placeholders: tuple
    build: Callable[[dict[str, Any]], Any]

    def run(self, *bound: Bound) -> DataFrame:
        return self.build(_checked({p.name for p in self.placeholders}, bound)).df()


def prepare(spark: SparkSession, text: str) -> Statement:
    return Statement(spark, text)
