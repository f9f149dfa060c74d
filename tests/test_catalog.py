"""Views, created tables, live schemas, helpers and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkweft.functions import aggregates as agg
from sparkweft.functions import compare as cmp
from sparkweft.operators import helpers as h
from sparkweft.operators.relations import hex_blobs
from sparkweft.plans.migrations import push
from sparkweft.plans.schema import Column, ForeignKey, Table, introspect, snapshot
from sparkweft.sources.database import Database
from sparkweft.streaming import events as streams


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.register("t", spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, name string"))
    return d


def test_materialized_view(db):
    t = db.t
    v = db.create_materialized_view("counted_names", db.select(t.name.alias("name"), agg.count().alias("n")).from_(t).group_by(t.name))
    assert sorted(map(tuple, db.select().from_(v).all())) == [("a", 1), ("b", 2)]
    assert db.refresh_materialized_view("counted_names", with_data=False).frame.count() == 0
    assert db.refresh_materialized_view("counted_names").frame.count() == 2


def test_create_introspect_push(spark, db):
    parent = Table("made_parent", (Column("id", "int4", False), Column("note")), ("id",))
    child = Table("made_child", (Column("id", "int8"), Column("parent", "int4")), (), (ForeignKey(("parent",), "made_parent", ("id",)),))
    made = db.create([child, parent])
    assert [s.split()[5] for s in made] == ["made_parent", "made_child"]
    assert [c.type for c in introspect(spark, ["made_child"]).tables["made_child"].columns] == ["int8", "int4"]
    wider = Table("made_parent", (*parent.columns, Column("extra", "float8")), ("id",))
    plan = push(spark, snapshot([wider, child]))
    assert [c.kind for c in plan.changes] == ["add_column"] and "extra" in spark.table("made_parent").columns
    assert push(spark, snapshot([wider, child])).changes == ()


def test_helpers(db):
    t = db.t
    q = h.chain(h.select(t.name, agg.count().alias("n")), h.from_(t), h.where(cmp.gt(t.id, 0)), h.group_by(t.name), h.having(cmp.gt(agg.count(), 1)), h.order_by(agg.asc(t.name)), h.limit(5))
    assert [tuple(r) for r in q.all()] == [("b", 2)]
    one = h.chain(h.select_distinct(t.id), h.from_(t))
    assert h.union(one, one).df().count() == 2 and h.union_all(one, one).df().count() == 4 and h.except_(one, one).df().count() == 0
    assert h.intersect_all(one, one).df().count() == 2 and h.except_all(one, one).df().count() == 0 and h.intersect(one, one).df().count() == 2
    assert h.set_(h.update(t), {"name": "z"}).returning("name").distinct().count() == 1
    assert h.delete(t).write().result.count() == 0


def test_hex(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x01\xff")), (2, None)], "id int, blob binary")
    assert [r.blob for r in hex_blobs(df).orderBy("id").collect()] == ["01FF", None]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i * 1800, i % 3, "click" if i % 2 else "view", float(i)) for i in range(200)] + [(5, 9000, 2, "click", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds(1_700_000_000 + F.col("s")).alias("ts"), "user_id", "event_type", "value")
    path = f"{tmp_path}/events"
    df.write.parquet(path)
    batch = spark.read.parquet(path)
    for name, make in (("tumbled", streams.tumbling), ("slid", streams.sliding)):
        streams.run(make(streams.read_events(spark, path)), name)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(batch).collect()))
    streams.run(streams.deduplicated(streams.read_events(spark, path)), "once", "append")
    assert spark.table("once").count() == streams.deduplicated(batch).count() == 200
    closed = streams.sessions(batch, "10 minutes")
    streams.run(streams.sessions(streams.read_events(spark, path), "10 minutes"), "sessions", "append")
    got = {tuple(r) for r in spark.table("sessions").collect()}
    assert got <= {tuple(r) for r in closed.collect()} and len(got) > 150
