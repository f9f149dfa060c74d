"""Queries that run over whole tables: no ids, rows or limits are cut away."""

from __future__ import annotations

import pytest

from sparkweft.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sizes(spark):
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    return {t: spark.read.parquet(f"{DATA}/{t}.parquet").select(k).count() for t, k in keys.items()}


def test_relations_and_self_join(spark, sizes):
    assert QUERIES["rel_many_to_many_whole"](spark, DATA).count() == sizes["orders"]
    customers = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey").distinct().count()
    assert QUERIES["sop_self_join_next"](spark, DATA).count() == sizes["orders"] - customers


@pytest.mark.parametrize("how", ["join", "inner_join", "left_join", "left_outer_join", "right_join", "right_outer_join", "full_join", "full_outer_join"])
def test_joins_meet_every_row(spark, sizes, how):
    rows = QUERIES[f"joi_{how}_whole"](spark, DATA).collect()
    items = sum(r.l_orderkey is not None for r in rows)
    orders = len({r.o_orderkey for r in rows if r.o_orderkey is not None})
    if how in ("join", "inner_join") or how.startswith(("right", "full")):
        assert items == sizes["lineitem"]
    if how.startswith(("left", "full")):
        assert orders == sizes["orders"] and any(r.l_orderkey is None for r in rows)
    if how.startswith(("right", "full")):
        assert any(r.o_orderkey is None for r in rows)


@pytest.mark.parametrize("name", ["srt_asc_pg", "srt_desc_pg", "srt_asc_sqlite", "srt_desc_sqlite"])
def test_order_places_every_null(spark, sizes, name):
    rows = QUERIES[f"{name}_whole"](spark, DATA).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, sizes["orders"] + 1))
    first = name in ("srt_desc_pg", "srt_asc_sqlite")
    nulls = sum(r.s is None for r in rows)
    assert 0 < nulls < len(rows) and all(r.s is None for r in (rows[:nulls] if first else rows[-nulls:]))


def test_flagship_report_covers_all_orders(spark, sizes):
    assert QUERIES["flagship_order_report_whole"](spark, DATA).count() == sizes["orders"]
    assert "LIMIT" not in ORACLES["flagship_order_report_whole"]
