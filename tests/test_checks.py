"""What is rejected before Spark runs anything."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from sparkweft.functions import aggregates as agg
from sparkweft.functions import compare as cmp
from sparkweft.functions import scalars as fn
from sparkweft.functions.core import NotFound, ParameterError, SchemaError, TransactionError, arithmetic_type, comparable
from sparkweft.operators import dml
from sparkweft.operators.prepared import Placeholder, Plan, prepare
from sparkweft.operators.relations import Query, many, one
from sparkweft.plans.migrations import Migration, Tracking, include_migrations, migrate, pending
from sparkweft.plans.schema import Column, ForeignKey, Table, check, diff_schemas, diff_with, snapshot, topological_order
from sparkweft.plans.seed import SeedConfig
from sparkweft.sources.database import Database


@pytest.fixture
def db(spark):
    d = Database(spark)
    users = spark.createDataFrame([(1, "ann", 30, None), (2, "bob", None, 1), (3, "cy", 20, 1)], "id int, name string, age int, invited_by int")
    posts = spark.createDataFrame([(10, 1, "a"), (11, 1, None), (12, 3, "c")], "id int, author_id int, title string")
    d.register("users", users, Table("users", (Column("id", "int4", False), Column("name"), Column("age", "int4"), Column("invited_by", "int4")), ("id",), (ForeignKey(("invited_by",), "users", ("id",)),), (("name",),)))
    d.register("posts", posts, Table("posts", (Column("id", "int4", False), Column("author_id", "int4"), Column("title")), ("id",), (ForeignKey(("author_id",), "users", ("id",)),)))
    return d


def test_comparison_and_arithmetic_types(db):
    u = db.users
    with pytest.raises(TypeError):
        cmp.eq(u.name, 3)
    with pytest.raises(TypeError):
        u.name + 1
    with pytest.raises(TypeError):
        cmp.like(u.age, "x")
    assert arithmetic_type("int4", "float4") == "float8" and arithmetic_type("int2", "float4") == "float4" and arithmetic_type("numeric", "float4") == "float8" and arithmetic_type("int2", "int8") == "int8"
    assert comparable("text", "blob", "sqlite") and not comparable("text", "blob", "pg")


def test_clause_order(db):
    q = db.select(db.users.id)
    with pytest.raises(SyntaxError):
        q.where(cmp.eq(db.users.id, 1))
    with pytest.raises(SyntaxError):
        q.from_(db.users).having(cmp.gt(agg.count(), 1))
    with pytest.raises(SyntaxError):
        q.from_(db.users).limit(1).where(cmp.eq(db.users.id, 1))
    with pytest.raises(ValueError):
        q.from_(db.users).limit(-1)


def test_grouping_rules(db):
    u, p = db.users, db.posts
    with pytest.raises(TypeError):
        db.select(u.name, agg.count().alias("n")).from_(u).group_by(u.age).df()
    got = db.select(u.id, u.name, agg.count(p.id).alias("n")).from_(u).left_join(p, cmp.eq(p.author_id, u.id)).group_by(u.id).df().collect()
    assert sorted((r.id, r.name, r.n) for r in got) == [(1, "ann", 2), (2, "bob", 0), (3, "cy", 1)]
    with pytest.raises(TypeError):
        agg.sum_(agg.count())
    with pytest.raises(TypeError):
        db.select(u.id).from_(u).where(cmp.gt(agg.count(), 1))


def test_set_operations_need_equal_rows(db):
    u, p = db.users, db.posts
    with pytest.raises(TypeError):
        db.select(u.id).from_(u).union(db.select(u.id, u.name).from_(u))
    with pytest.raises(TypeError):
        db.select(u.id).from_(u).union(db.select(p.title).from_(p))


def test_nullability_of_outer_joins(db):
    u, p = db.users, db.posts
    on = cmp.eq(p.author_id, u.id)
    assert db.select(u.id, p.id.alias("p")).from_(u).left_join(p, on).nullables() == [False, True]
    assert db.select(u.id, p.id.alias("p")).from_(u).right_join(p, on).nullables() == [True, False]
    assert db.select(u.id, p.id.alias("p")).from_(u).full_join(p, on).nullables() == [True, True]


def test_get_all_rows(db):
    u = db.users
    with pytest.raises(NotFound):
        db.select(u.id).from_(u).where(cmp.eq(u.id, 99)).get()
    assert db.select(u.id).from_(u).where(cmp.eq(u.id, 2)).get().id == 2
    assert sorted(r.id for r in db.select(u.id).from_(u).rows()) == [1, 2, 3]


def test_locks_are_recorded_only(db):
    u = db.users
    q = db.select(u.id).from_(u).for_update().nowait()
    assert q.locks == ("for update", "nowait") and len(q.all()) == 3
    lite = Database(db.spark, "sqlite")
    v = lite.register("users", u.frame)
    with pytest.raises(SyntaxError):
        lite.select(v.id).from_(v).for_share()


def test_prepared_statements(db):
    db.users.frame.createOrReplaceTempView("people")
    s = prepare(db.spark, "SELECT id FROM people WHERE name = :name AND name <> ':other'")
    assert s.names == {"name"}
    name = Placeholder.typed("name", db.users.name)
    assert [r.id for r in s.run(name.bind("bob")).collect()] == [2]
    for bad in ([], [name.bind("a"), name.bind("b")], [name.bind("a"), Placeholder.named("x").bind(1)]):
        with pytest.raises(ParameterError):
            s.run(*bad)
    with pytest.raises(TypeError):
        name.bind(3)
    with pytest.raises(ParameterError):
        name.bind(None)
    plan = Plan((Placeholder.typed("id", db.users.id),), lambda v: db.select(db.users.name).from_(db.users).where(cmp.eq(db.users.id, v["id"])))
    assert plan.run(Placeholder.typed("id", db.users.id).bind(3)).first().name == "cy"


def test_writes_are_checked(db):
    u = db.users
    with pytest.raises(ValueError):
        dml.insert(u).values([{"id": 4, "name": "d"}, {"id": 5}])
    with pytest.raises(ValueError):
        dml.insert(u).value({"name": "d"})
    with pytest.raises(SchemaError):
        dml.insert(u).value({"id": 1}).on_conflict("age")
    with pytest.raises(ValueError):
        dml.update(u).set({})
    with pytest.raises(TypeError):
        dml.update(u).set({"age": "x"})
    got = dml.insert(u).values([{"id": 4, "name": "ann"}, {"id": 5, "name": "eve"}, {"id": 5, "name": "fay"}]).on_conflict_do_nothing().write()
    assert got.returning.count() == 1 and got.result.count() == 4


def test_transaction_and_savepoint(db):
    with dml.Transaction(db) as tx:
        tx.run(dml.delete(tx.table("users")).where(cmp.eq(tx.table("users").id, 1)))

        def fails(t):
            t.run(dml.delete(t.table("users")))
            raise RuntimeError

        with pytest.raises(RuntimeError):
            tx.savepoint(fails)
    assert db.table("users").frame.count() == 2
    with pytest.raises(TransactionError):
        tx.commit()
    with pytest.raises(RuntimeError), dml.Transaction(db) as tx:
        tx.run(dml.delete(tx.table("users")))
        raise RuntimeError
    assert db.table("users").frame.count() == 2
    seen = []
    assert dml.execute(dml.update(db.posts).set({"title": "z"}).where(cmp.is_null(db.posts.title)), seen.append) == 1
    assert seen[0].where("title = 'z'").count() == 1


def test_relations(db):
    u, p = db.users, db.posts
    q = Query(u).with_(many("posts", u, p))
    got = {r.id: [x.id for x in r.posts] for r in q.find_many()}
    assert {k: sorted(v) for k, v in got.items()} == {1: [10, 11], 2: [], 3: [12]}
    assert Query(u).where(cmp.eq(u.id, 99)).find_first() is None
    assert Query(p).with_(one("author", p, u)).where(cmp.eq(p.id, 12)).find_first().author.name == "cy"
    with pytest.raises(SchemaError):
        q.with_(many("posts", u, p))
    with pytest.raises(SyntaxError):
        Query(u).offset(3)
    with pytest.raises(SchemaError):
        Query(u).columns("nope")


def test_keys_are_checked_by_queries(db):
    u = db.users
    bad = db.spark.createDataFrame([(1, None, None, 7), (1, "x", None, None)], u.frame.schema)
    rules = {v.rule for v in check(u.table, bad, {"users": bad})}
    assert rules == {"(id) is not unique", "(invited_by) refers to no row of users"}
    assert check(u.table, u.frame, {"users": u.frame}) == []
    assert u.table.struct("update").fields[0].nullable and not u.table.struct().fields[0].nullable
    assert u.table.struct()["age"].dataType == T.IntegerType()


def test_topology_and_diff():
    a = Table("a", (Column("id", "int4", False),), ("id",))
    b = Table("b", (Column("id", "int4", False), Column("a", "int4")), ("id",), (ForeignKey(("a",), "a", ("id",)),))
    assert [t.name for t in topological_order([b, a])] == ["a", "b"]
    loop = Table("a", a.columns, ("id",), (ForeignKey(("id",), "b", ("id",)),))
    with pytest.raises(SchemaError):
        topological_order([loop, b])
    assert [c.kind for c in diff_schemas([a, b], [a]).changes] == ["drop_table"]
    renamed = Table("b", (Column("id", "int4", False), Column("other", "int4")), ("id",))
    assert [c.kind for c in diff_with(snapshot([b]), snapshot([renamed]), {"b.a": "other"}).changes] == ["rename_column"]
    with pytest.raises(SchemaError):
        diff_with(snapshot([a, b]), snapshot([a]), strict=True)


def test_migrations(spark, tmp_path):
    (tmp_path / "0001.sql").write_text("SELECT 1; SELECT 2;")
    (tmp_path / "0002").mkdir()
    (tmp_path / "0002" / "migration.sql").write_text("SELECT 3")
    found = include_migrations(tmp_path)
    assert [(m.name, len(m.statements)) for m in found] == [("0001", 2), ("0002", 1)]
    ran = []
    tracking = Tracking(spark, "tracked_migrations")
    assert migrate(spark, found, tracking, ran.append) == ["0001", "0002"] and len(ran) == 3
    assert pending(found, tracking.applied()) == []
    with pytest.raises(SchemaError):
        pending([Migration("0001", ("SELECT 9",))], tracking.applied())


def test_seeds_repeat(spark):
    t = Table("t", (Column("id", "int8", False), Column("email"), Column("ok", "bool"), Column("score", "float8"), Column("kind", "enum", True, None, ("x", "y"))), ("id",))
    make = lambda n: sorted(map(tuple, SeedConfig((t,)).seed(n).count("t", 20).generate(spark)["t"].collect()))
    assert make(1) == make(1) and make(1) != make(2) and len({r[0] for r in make(1)}) == 20


def test_sequences():
    s = fn.Sequence("s")
    with pytest.raises(SchemaError):
        fn.currval(s)
    assert [fn.nextval(s), fn.nextval(s), fn.currval(s), fn.setval(s, 9), fn.nextval(s)] == [1, 2, 2, 9, 10]


def test_domain_errors(spark):
    from sparkweft.functions.core import Expr
    from pyspark.sql import functions as F

    for dialect, fails in (("sqlite", False), ("pg", True)):
        e = Expr(F.lit(-1.0), "float8", False, "scalar", None, dialect)
        df = spark.range(1).select(fn.sqrt(e).column.alias("v"))
        if fails:
            with pytest.raises(Exception, match="out of range"):
                df.collect()
        else:
            assert df.first().v is None
