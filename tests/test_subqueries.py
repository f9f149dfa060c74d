"""Subqueries as conditions anywhere, and the checks of keys in writes."""

from __future__ import annotations

import itertools

import pytest

from sparkweft.functions import aggregates as agg
from sparkweft.functions import compare as cmp
from sparkweft.operators import dml
from sparkweft.operators.select import Source
from sparkweft.plans.schema import Column, Table


def source(spark, name, rows, names="a b", dialect="pg", key=(), unique=()):
    columns = tuple(Column(n, "int8") for n in names.split())
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names.split()))
    return Source(Table(name, columns, primary_key=key, unique=unique, dialect=dialect), df, name)


def three(value, rows):
    """IN over tuples, with SQL's three values."""
    out = False
    for row in rows:
        equal = [None if x is None or y is None else x == y for x, y in zip(value, row)]
        if all(e is True for e in equal):
            return True
        if False not in equal:
            out = None
    return out


@pytest.mark.parametrize("inner", [[], [(1, 1)], [(1, None)], [(None, 2), (3, 3)], [(None, None)]])
def test_tuple_in_has_three_values(spark, inner):
    from sparkweft.operators.select import Select

    rows = list(itertools.product([1, 2, 3, None], [1, 2, 3, None]))
    x, y = source(spark, "x", rows), source(spark, "y", inner, "c d")
    q = Select("pg", (y.c("c"), y.c("d"))).from_(y)
    found = Select("pg", (x.a, x.b, cmp.in_subquery((x.a, x.b), q).alias("v"))).from_(x).df()
    assert {(r.a, r.b): r.v for r in found.collect()} == {v: three(v, inner) for v in rows}
    left = Select("pg", (x.a, x.b)).from_(x).where(cmp.not_in_subquery((x.a, x.b), q)).df()
    assert "NestedLoop" not in left._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in left.collect()} == {v for v in rows if three(v, inner) is False}
    single = Select("pg", (y.c("c"),)).from_(y)
    either = Select("pg", (x.a, x.b)).from_(x).where(cmp.or_(cmp.not_in_subquery(x.a, single), cmp.eq(x.b, 1))).df()
    assert {tuple(r) for r in either.collect()} == {v for v in rows if three(v[:1], [i[:1] for i in inner]) is False or v[1] == 1}


def test_correlated_subqueries_keep_their_clauses(spark):
    from sparkweft.operators.select import Select

    x, y = source(spark, "x", [(1, 0), (2, 0), (3, 0)]), source(spark, "y", [(1, 5), (1, 6), (2, 7)], "c d")
    tied = Select("pg", (y.c("c"),)).from_(y).where(cmp.eq(y.c("c"), x.a))
    got = lambda condition: sorted(r.a for r in Select("pg", (x.a,)).from_(x).where(condition).df().collect())
    assert got(cmp.exists(tied)) == [1, 2] and got(cmp.exists(tied.limit(0))) == [] and got(cmp.not_exists(tied.limit(0))) == [1, 2, 3]
    assert got(cmp.exists(tied.group_by(y.c("c")).having(cmp.gt(agg.count(y.d), 1)))) == [1]
    assert got(cmp.or_(cmp.exists(tied.group_by(y.c("c")).having(cmp.gt(agg.count(y.d), 1))), cmp.eq(x.a, 3))) == [1, 3]
    with pytest.raises(TypeError):
        cmp.exists(tied.offset(1))


def test_delete_and_update_by_subquery(spark):
    from sparkweft.operators.select import Select

    x, y = source(spark, "x", [(1, 0), (2, 0), (3, 0)]), source(spark, "y", [(1, 5)], "c d")
    q = Select("pg", (y.c("c"),)).from_(y)
    written = dml.delete(x).where(cmp.in_subquery(x.a, q)).write()
    assert sorted(r.a for r in written.result.collect()) == [2, 3] and [r.a for r in written.returning.collect()] == [1]
    changed = dml.update(x).set({"b": 9}).where(cmp.not_in_subquery(x.a, q)).write()
    assert sorted(map(tuple, changed.result.collect())) == [(1, 0), (2, 9), (3, 9)] and changed.returning.count() == 2


def test_duplicate_keys_are_errors(spark):
    t = source(spark, "t", [(1, 10), (2, 20)], key=("a",), unique=(("b",),))
    assert dml.insert(t).values([{"a": 3, "b": 30}, {"a": 4, "b": None}, {"a": 5, "b": None}]).write().result.count() == 5
    for rows in ([{"a": 1, "b": 30}], [{"a": 3, "b": 30}, {"a": 3, "b": 31}], [{"a": 3, "b": 20}]):
        with pytest.raises(Exception, match="duplicate key"):
            dml.insert(t).values(rows).write().result.collect()


def test_upserts_of_one_row_twice(spark):
    twice = [{"a": 1, "b": 7}, {"a": 1, "b": 8}]
    pg, lite = source(spark, "t", [(1, 10)], key=("a",)), source(spark, "t", [(1, 10)], dialect="sqlite", key=("a",))
    up = lambda t: dml.insert(t).values(twice).on_conflict("a").do_update({"b": dml.excluded(t, "b")}).write().result
    with pytest.raises(Exception, match="twice"):
        up(pg).collect()
    assert [tuple(r) for r in up(lite).collect()] == [(1, 8)]
    empty = source(spark, "t", [], key=("a",))
    assert [tuple(r) for r in dml.insert(empty).values(twice).on_conflict("a").do_nothing().write().result.collect()] == [(1, 7)]


def test_update_from_takes_the_smallest_match(spark):
    t, y = source(spark, "t", [(1, 0)], key=("a",)), source(spark, "y", [(1, 9), (1, 4), (1, 6)], "c d")
    written = dml.update(t).set({"b": y.d}).from_(y).where(cmp.eq(t.a, y.c("c"))).write()
    assert [tuple(r) for r in written.result.collect()] == [(1, 4)] == [tuple(r) for r in written.returning.collect()]
