"""All registered queries of the engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.functions import aggregates as agg
from sparkweft.functions import compare as cmp
from sparkweft.functions import datetimes as dt
from sparkweft.functions import jsons as js
from sparkweft.functions import scalars as fn
from sparkweft.functions.aggregates import asc, desc, window
from sparkweft.functions.core import Expr
from sparkweft.operators import dml
from sparkweft.operators.relations import Query, many, many_to_many, one
from sparkweft.sources.database import Database
from sparkweft.streaming import events as streams

from .schema import Column, ForeignKey, Table, conform, diff_schemas, table_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None, dialect: str = "pg"):
    """Registers f(db) -> Select or DataFrame under a name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Database(spark, dialect, sf_dir))
            return out if isinstance(out, DataFrame) else out.df()

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def scalar(name: str, table: str, keys: str, make: Callable, sql: str | None, dialect: str = "pg") -> None:
    """One expression over all rows of a table: keys, v."""
    names = keys.split()

    def f(db: Database):
        t = db.table(table)
        return db.select(*[t.c(k) for k in names], make(t).alias("v")).from_(t)

    query(name, None if sql is None else f"SELECT {', '.join(names)}, {sql} AS v FROM {table}", dialect)(f)


def aggregate(name: str, make: Callable, sql: str | None, table: str = "orders", key: str = "o_orderpriority", dialect: str = "pg") -> None:
    """One aggregate per group: key, v."""

    def f(db: Database):
        t = db.table(table)
        return db.select(t.c(key), make(t).alias("v")).from_(t).group_by(t.c(key))

    query(name, None if sql is None else f"SELECT {key}, {sql} AS v FROM {table} GROUP BY {key}", dialect)(f)


def condition(name: str, make: Callable, sql: str, table: str = "orders", key: str = "o_orderkey", dialect: str = "pg") -> None:
    """The keys of the rows that a WHERE leaves."""

    def f(db: Database):
        t = db.table(table)
        return db.select(t.c(key)).from_(t).where(make(t))

    query(name, f"SELECT {key} FROM {table} WHERE {sql}", dialect)(f)


# Values with nulls, as the tables have none.
def status(t) -> Expr:
    return fn.nullif(t.o_orderstatus, "F")


STATUS = "nullif(o_orderstatus, 'F')"


def cents(e: Expr) -> Expr:
    """Money as whole cents: sums don't depend on the order of rows."""
    return Expr(F.round(e.column * 100).cast("bigint"), "int8", e.nullable, e.kind, None, e.dialect, e.source, e.parts)


def CENTS(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


# -- flagship ---------------------------------------------------------------------------


@query("flagship_order_report", """
SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_orderdate) AS o_orderdate, count(l_orderkey) AS n_items,
       CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS quantity, CAST(coalesce(sum(CAST(round(l_extendedprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey ORDER BY o_orderkey LIMIT 50""")  # fmt: skip
def flagship(db):
    """Orders with counts and sums of their items; the primary key groups all of orders."""
    o, l = db.orders, db.lineitem  # noqa: E741
    return (
        db.select(o.o_orderkey, o.o_orderstatus, o.o_orderdate, agg.count(l.l_orderkey).alias("n_items"), fn.coalesce(agg.sum_(fn.cast(l.l_quantity, "int8")), 0).alias("quantity"), fn.coalesce(agg.sum_(cents(l.l_extendedprice)), 0).alias("cents"))
        .from_(o).left_join(l).group_by(o.o_orderkey).order_by(asc(o.o_orderkey)).limit(50)
    )


@query("flagship_order_report_whole", ORACLES["flagship_order_report"].removesuffix(" ORDER BY o_orderkey LIMIT 50"))
def flagship_whole(db):
    """The flagship report over all orders."""
    o, l = db.orders, db.lineitem  # noqa: E741
    return (
        db.select(o.o_orderkey, o.o_orderstatus, o.o_orderdate, agg.count(l.l_orderkey).alias("n_items"), fn.coalesce(agg.sum_(fn.cast(l.l_quantity, "int8")), 0).alias("quantity"), fn.coalesce(agg.sum_(cents(l.l_extendedprice)), 0).alias("cents"))
        .from_(o).left_join(l).group_by(o.o_orderkey)
    )


# -- scans, projections --------------------------------------------------------------------


@query("scn_from_all", "SELECT * FROM nation")
def _(db):
    return db.select().from_(db.nation)


@query("scn_from_view", "SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey > 1")
def _(db):
    v = db.create_view("far_nations", db.select(db.nation.n_name.alias("name"), db.nation.n_regionkey.alias("region")).from_(db.nation).where(cmp.gt(db.nation.n_regionkey, 1)))
    return db.select().from_(v)


@query("scn_from_subquery", "SELECT name FROM (SELECT n_name AS name FROM nation WHERE n_nationkey < 10)")
def _(db):
    inner = db.select(db.nation.n_name.alias("name")).from_(db.nation).where(cmp.lt(db.nation.n_nationkey, 10))
    return db.select().from_(inner)


@query("scn_introspect", """SELECT * FROM (VALUES ('n_name', 'text'), ('n_nationkey', 'int4'), ('n_regionkey', 'int4')) t(column_name, type_name)""")
def _(db):
    db.spark.read.parquet(f"{db.folder}/nation.parquet").createOrReplaceTempView("live_nation")
    from .schema import introspect

    found = introspect(db.spark, ["live_nation"]).tables["live_nation"]
    return db.spark.createDataFrame([(c.name, c.type) for c in found.columns], "column_name string, type_name string")


@query("prj_select", "SELECT p_partkey, p_name, p_size FROM part")
def _(db):
    return db.select(db.part.p_partkey, db.part.p_name, db.part.p_size).from_(db.part)


@query("prj_select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(db):
    return db.select_distinct(db.orders.o_orderstatus, db.orders.o_orderpriority).from_(db.orders)


@query("prj_select_distinct_on", """
SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def _(db):
    o = db.orders
    return db.select_distinct_on(o.o_custkey, o.o_custkey, o.o_orderkey).from_(o).order_by(desc(o.o_orderdate), asc(o.o_orderkey))


condition("prj_where", lambda t: cmp.gt(t.o_totalprice, 100000.0), "o_totalprice > 100000")
scalar("prj_alias", "region", "r_regionkey", lambda t: fn.alias(t.r_name, "v"), "r_name")
scalar("prj_raw", "part", "p_partkey", lambda t: fn.raw("p_size * 2 + 1", "int4"), "p_size * 2 + 1")
scalar("prj_raw_non_null", "part", "p_partkey", lambda t: fn.raw_non_null("p_size - 1", "int4"), "p_size - 1")
scalar("prj_sql_template", "part", "p_partkey", lambda t: fn.sql("({} + 1) * {}", t.p_size, t.p_size, kind="int4"), "(p_size + 1) * p_size")
scalar("prj_typeof", "part", "p_partkey", lambda t: fn.typeof_(fn.nullif(t.p_size, 7)), "CASE WHEN p_size = 7 THEN 'null' ELSE 'integer' END")
scalar("prj_typeof_real", "part", "p_partkey", lambda t: fn.typeof(t.p_retailprice), "'real'")
scalar("prj_cast_text", "part", "p_partkey", lambda t: fn.cast(t.p_size, "text"), "CAST(p_size AS VARCHAR)")
scalar("prj_cast_int8", "part", "p_partkey", lambda t: fn.cast(t.p_size, "int8"), "CAST(p_size AS BIGINT)")
scalar("prj_cast_date", "orders", "o_orderkey", lambda t: fn.cast(t.o_orderdate, "date"), "CAST(o_orderdate AS DATE)")
aggregate("prj_distinct", lambda t: agg.count_distinct(agg.distinct(t.o_custkey)), "count(DISTINCT o_custkey)")


@query("prj_comment", "SELECT count(*) AS n FROM region")
def _(db):
    return db.select(agg.count().alias("n")).from_(db.region).comment("a report */").comment_tags({"team": "a b", "app": "x"})


# -- predicates ------------------------------------------------------------------------------

condition("cmp_eq", lambda t: cmp.eq(t.o_orderstatus, "F"), "o_orderstatus = 'F'")
condition("cmp_ne", lambda t: cmp.ne(t.o_orderstatus, "F"), "o_orderstatus <> 'F'")
condition("cmp_neq", lambda t: cmp.neq(status(t), "O"), f"{STATUS} <> 'O'")
condition("cmp_gt", lambda t: cmp.gt(t.o_custkey, 700), "o_custkey > 700")
condition("cmp_gte", lambda t: cmp.gte(t.o_custkey, 700), "o_custkey >= 700")
condition("cmp_lt", lambda t: cmp.lt(t.o_custkey, 700), "o_custkey < 700")
condition("cmp_lte", lambda t: cmp.lte(t.o_custkey, 700), "o_custkey <= 700")
condition("cmp_like", lambda t: cmp.like(t.o_orderpriority, "%-H%"), "o_orderpriority LIKE '%-H%'")
condition("cmp_like_sqlite", lambda t: cmp.like(t.o_orderpriority, "%-h%"), "o_orderpriority ILIKE '%-h%'", dialect="sqlite")
condition("cmp_not_like", lambda t: cmp.not_like(t.o_orderpriority, "1%"), "o_orderpriority NOT LIKE '1%'")
condition("cmp_between", lambda t: cmp.between(t.o_custkey, 100, 200), "o_custkey BETWEEN 100 AND 200")
condition("cmp_not_between", lambda t: cmp.not_between(t.o_custkey, 100, 200), "o_custkey NOT BETWEEN 100 AND 200")
condition("cmp_is_null", lambda t: cmp.is_null(status(t)), f"{STATUS} IS NULL")
condition("cmp_is_not_null", lambda t: cmp.is_not_null(status(t)), f"{STATUS} IS NOT NULL")
condition("cmp_is_distinct_from", lambda t: cmp.is_distinct_from(status(t), "O"), f"{STATUS} IS DISTINCT FROM 'O'")
condition("cmp_is_not_distinct_from", lambda t: cmp.is_not_distinct_from(status(t), fn.nullif(t.o_orderstatus, "O")), f"{STATUS} IS NOT DISTINCT FROM nullif(o_orderstatus, 'O')")
condition("cmp_is_true", lambda t: cmp.is_true(cmp.eq(status(t), "O")), f"({STATUS} = 'O') IS TRUE")
condition("cmp_is_false", lambda t: cmp.is_false(cmp.eq(status(t), "O")), f"({STATUS} = 'O') IS FALSE")
condition("cmp_not", lambda t: ~cmp.eq(status(t), "O"), f"NOT ({STATUS} = 'O')")
condition("cmp_and", lambda t: cmp.eq(t.o_orderstatus, "O") & cmp.lt(t.o_custkey, 300), "o_orderstatus = 'O' AND o_custkey < 300")
condition("cmp_or", lambda t: cmp.eq(status(t), "O") | cmp.lt(t.o_custkey, 300), f"{STATUS} = 'O' OR o_custkey < 300")
condition("cmp_all", lambda t: cmp.all_(cmp.eq(t.o_orderstatus, "O"), None, cmp.lt(t.o_custkey, 300)), "o_orderstatus = 'O' AND o_custkey < 300")
condition("cmp_all_empty", lambda t: cmp.all_(None), "true")
condition("cmp_any", lambda t: cmp.any_(cmp.eq(t.o_custkey, 5), None, cmp.eq(t.o_custkey, 6)), "o_custkey = 5 OR o_custkey = 6")
condition("cmp_any_empty", lambda t: cmp.any_(), "false")
condition("cmp_in_array", lambda t: cmp.in_array(t.o_custkey, [1, 2, 3]), "o_custkey IN (1, 2, 3)")
condition("cmp_in_array_empty", lambda t: cmp.in_array(status(t), []), "false")
condition("cmp_not_in_array", lambda t: cmp.not_in_array(status(t), ["O"]), f"{STATUS} NOT IN ('O')")
condition("cmp_not_in_array_empty", lambda t: cmp.not_in_array(status(t), []), "true")
condition("cmp_ilike", lambda t: cmp.ilike(t.o_orderpriority, "%urg%"), "o_orderpriority ILIKE '%urg%'")
condition("cmp_not_ilike", lambda t: cmp.not_ilike(t.o_orderpriority, "%urg%"), "o_orderpriority NOT ILIKE '%urg%'")
condition("cmp_regex_match", lambda t: cmp.regex_match(t.o_orderpriority, "^[12]-"), "regexp_matches(o_orderpriority, '^[12]-')")
condition("cmp_regex_match_ci", lambda t: cmp.regex_match_ci(t.o_orderpriority, "urgent"), "regexp_matches(o_orderpriority, 'urgent', 'i')")
condition("cmp_regex_not_match", lambda t: cmp.regex_not_match(t.o_orderpriority, "^[12]-"), "NOT regexp_matches(o_orderpriority, '^[12]-')")
condition("cmp_regex_not_match_ci", lambda t: cmp.regex_not_match_ci(t.o_orderpriority, "urgent"), "NOT regexp_matches(o_orderpriority, 'urgent', 'i')")


def _rich(db):
    c = db.customer
    return db.select(c.c_custkey).from_(c).where(cmp.gt(c.c_acctbal, 9000.0))


@query("cmp_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def _(db):
    return db.select(db.orders.o_orderkey).from_(db.orders).where(cmp.in_subquery(db.orders.o_custkey, _rich(db)))


@query("cmp_in_subquery_tuple", "SELECT s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey) IN (SELECT l_suppkey % 25, l_suppkey FROM lineitem WHERE l_quantity > 40)")
def _(db):
    l, s = db.lineitem, db.supplier  # noqa: E741
    inner = db.select(fn.cast(l.l_suppkey % 25, "int4").alias("a"), l.l_suppkey).from_(l).where(cmp.gt(l.l_quantity, 40.0))
    return db.select(s.s_suppkey).from_(s).where(cmp.in_subquery((s.s_nationkey, s.s_suppkey), inner))


@query("cmp_not_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(db):
    c = db.customer
    inner = db.select(c.c_custkey).from_(c).where(cmp.gt(c.c_acctbal, 0.0))
    return db.select(db.orders.o_orderkey).from_(db.orders).where(cmp.not_in_subquery(db.orders.o_custkey, inner))


@query("cmp_not_in_subquery_with_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)")
def _(db):
    """A null in the subquery: no row is left."""
    inner = db.select(fn.nullif(db.region.r_regionkey, 3).alias("k")).from_(db.region)
    return db.select(db.nation.n_nationkey).from_(db.nation).where(cmp.not_in_subquery(db.nation.n_regionkey, inner))


@query("cmp_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def _(db):
    o, l = db.orders, db.lineitem  # noqa: E741
    return db.select(o.o_orderkey).from_(o).where(cmp.exists(db.select(l.l_orderkey).from_(l).where(cmp.eq(l.l_orderkey, o.o_orderkey), cmp.gt(l.l_quantity, 49.0))))


@query("cmp_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(db):
    o, l = db.orders, db.lineitem  # noqa: E741
    return db.select(o.o_orderkey).from_(o).where(cmp.not_exists(db.select(l.l_orderkey).from_(l).where(cmp.eq(l.l_orderkey, o.o_orderkey))))


@query("cmp_exists_uncorrelated", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM part WHERE p_size > 49)")
def _(db):
    return db.select(db.region.r_regionkey).from_(db.region).where(cmp.exists(db.select(db.part.p_partkey).from_(db.part).where(cmp.gt(db.part.p_size, 49))))


# -- joins ------------------------------------------------------------------------------------


def _joined(how: str, kind: str) -> None:
    @query(f"joi_{how}", f"SELECT o_orderkey, o_custkey, l_linenumber, l_partkey FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) o {kind} JOIN (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0) l ON l_orderkey = o_orderkey")
    def f(db):
        o = db.register("orders", db.orders.frame.where("o_orderkey % 3 <> 0"))
        l = db.register("lineitem", db.lineitem.frame.where("l_orderkey % 2 = 0"))  # noqa: E741
        return getattr(db.select(o.o_orderkey, o.o_custkey, l.l_linenumber, l.l_partkey).from_(o), how)((l, cmp.eq(l.l_orderkey, o.o_orderkey)))


for _how, _kind in {"join": "INNER", "inner_join": "INNER", "left_join": "LEFT", "left_outer_join": "LEFT", "right_join": "RIGHT", "right_outer_join": "RIGHT", "full_join": "FULL", "full_outer_join": "FULL"}.items():
    _joined(_how, _kind)


def _joined_whole(how: str, kind: str) -> None:
    """Whole tables; in outer joins a condition in ON leaves rows of both sides without a match."""
    more = "" if kind == "INNER" else " AND o_orderstatus = 'O' AND l_linenumber > 1"

    @query(f"joi_{how}_whole", f"SELECT o_orderkey, o_custkey, l_orderkey, l_linenumber, l_partkey FROM orders {kind} JOIN lineitem ON l_orderkey = o_orderkey{more}")
    def f(db):
        o, l = db.orders, db.lineitem  # noqa: E741
        on = cmp.eq(l.l_orderkey, o.o_orderkey)
        if more:
            on = on & cmp.eq(o.o_orderstatus, "O") & cmp.gt(l.l_linenumber, 1)
        return getattr(db.select(o.o_orderkey, o.o_custkey, l.l_orderkey, l.l_linenumber, l.l_partkey).from_(o), how)((l, on))


for _how, _kind in {"join": "INNER", "inner_join": "INNER", "left_join": "LEFT", "left_outer_join": "LEFT", "right_join": "RIGHT", "right_outer_join": "RIGHT", "full_join": "FULL", "full_outer_join": "FULL"}.items():
    _joined_whole(_how, _kind)


@query("joi_cross_join", "SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def _(db):
    """The one product of the language, of two tables of fixed size."""
    return db.select(db.region.r_regionkey, db.nation.n_nationkey).from_(db.region).cross_join(db.nation)


@query("joi_by_foreign_key", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(db):
    return db.select(db.customer.c_custkey, db.nation.n_name, db.region.r_name).from_(db.customer).join(db.nation).join(db.region)


@query("joi_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(db):
    a, b = db.nation.alias("a"), db.nation.alias("b")
    return db.select(a.n_nationkey.alias("a"), b.n_nationkey.alias("b")).from_(a).join(b, cmp.eq(a.n_regionkey, b.n_regionkey) & cmp.lt(a.n_nationkey, b.n_nationkey))


def _renamed(db):
    n = db.register("n", db.nation.frame.selectExpr("n_nationkey AS k", "n_name"))
    s = db.register("s", db.supplier.frame.where("s_nationkey > 4").selectExpr("s_nationkey + 3 AS k", "s_suppkey"))
    return n, s


_N, _S = "(SELECT n_nationkey AS k, n_name FROM nation) n", "(SELECT s_nationkey + 3 AS k, s_suppkey FROM supplier WHERE s_nationkey > 4) s"


def _merged(how: str, kind: str, using: bool) -> None:
    text = f"SELECT k, n_name, s_suppkey FROM {_N} {kind} JOIN {_S} USING (k)" if using else f"SELECT k, n_name, s_suppkey FROM {_N} NATURAL {kind} JOIN {_S}"

    @query(f"joi_{how}", text)
    def f(db):
        n, s = _renamed(db)
        return getattr(db.select().from_(n), how)(s, *(["k"] if using else []))


for _side, _kind in {"": "INNER", "inner_": "INNER", "left_": "LEFT", "left_outer_": "LEFT", "right_": "RIGHT", "right_outer_": "RIGHT", "full_": "FULL", "full_outer_": "FULL"}.items():
    _merged(f"natural_{_side}join", _kind, False)
    _merged(f"{_side}join_using", _kind, True)


# -- aggregates -------------------------------------------------------------------------------

aggregate("agg_count_star", lambda t: agg.count(), "count(*)")
aggregate("agg_count", lambda t: agg.count(status(t)), f"count({STATUS})")
aggregate("agg_count_distinct", lambda t: agg.count_distinct(t.o_custkey), "count(DISTINCT o_custkey)")
aggregate("agg_sum", lambda t: agg.sum_(t.o_custkey), "CAST(sum(o_custkey) AS BIGINT)")
aggregate("agg_sum_money", lambda t: agg.sum_(cents(t.o_totalprice)), f"CAST(sum({CENTS('o_totalprice')}) AS BIGINT)")
aggregate("agg_sum_distinct", lambda t: agg.sum_distinct(t.o_custkey), "CAST(sum(DISTINCT o_custkey) AS BIGINT)")
aggregate("agg_avg", lambda t: fn.round_to(agg.avg(t.o_custkey), 6), "round(avg(o_custkey), 6)")
aggregate("agg_avg_distinct", lambda t: fn.round_to(agg.avg_distinct(t.o_custkey), 6), "round(avg(DISTINCT o_custkey), 6)")
aggregate("agg_min", lambda t: agg.min_(t.o_totalprice), "min(o_totalprice)")
aggregate("agg_max", lambda t: agg.max_(t.o_orderdate), "max(o_orderdate)")
for _f in ("stddev_pop", "stddev_samp", "var_pop", "var_samp", "variance"):
    aggregate(f"agg_{_f}", lambda t, f=_f: fn.round_to(getattr(agg, f)(t.o_custkey), 3), f"round({_f}(o_custkey), 3)")
aggregate("agg_bool_and", lambda t: agg.bool_and(cmp.gt(t.o_custkey, 1)), "bool_and(o_custkey > 1)")
aggregate("agg_bool_or", lambda t: agg.bool_or(cmp.gt(t.o_custkey, 1499)), "bool_or(o_custkey > 1499)")
aggregate("agg_every", lambda t: agg.every(cmp.gt(t.o_custkey, 0)), "bool_and(o_custkey > 0)")
aggregate("agg_total", lambda t: agg.total(t.o_custkey), "coalesce(CAST(sum(o_custkey) AS DOUBLE), 0.0)", dialect="sqlite")
aggregate("agg_group_concat", lambda t: agg.group_concat(t.n_name), "string_agg(n_name, ',' ORDER BY n_name)", "nation", "n_regionkey", "sqlite")
aggregate("agg_string_agg", lambda t: agg.string_agg(t.n_name, "; "), "string_agg(n_name, '; ' ORDER BY n_name)", "nation", "n_regionkey")
aggregate("agg_array_agg", lambda t: Expr(F.array_join(agg.array_agg(fn.nullif(t.n_nationkey, 7)).column, "|", "-"), "text", True, "aggregate", parts=(t.n_nationkey,)), "array_to_string(list_transform(list(nullif(n_nationkey, 7) ORDER BY n_nationkey = 7 DESC, n_nationkey), lambda x: coalesce(CAST(x AS VARCHAR), '-')), '|')", "nation", "n_regionkey")
aggregate("agg_json_agg", lambda t: agg.json_agg(t.n_name), "CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR)", "nation", "n_regionkey")
aggregate("agg_jsonb_agg", lambda t: agg.jsonb_agg(t.n_nationkey), "CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR)", "nation", "n_regionkey")
aggregate("agg_json_object_agg", lambda t: agg.json_object_agg(t.n_name, t.n_nationkey), "'{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}'", "nation", "n_regionkey")
aggregate("agg_jsonb_object_agg", lambda t: agg.jsonb_object_agg(t.n_name, t.n_regionkey), "'{' || string_agg('\"' || n_name || '\":' || n_regionkey, ',' ORDER BY n_name) || '}'", "nation", "n_regionkey")
aggregate("agg_filter", lambda t: agg.filter(agg.count(), cmp.eq(t.o_orderstatus, "O")), "count(*) FILTER (o_orderstatus = 'O')")
aggregate("agg_filter_sum", lambda t: agg.filter(agg.sum_(t.o_custkey), cmp.lt(t.o_custkey, 5)), "CAST(sum(o_custkey) FILTER (o_custkey < 5) AS BIGINT)")


@query("agg_group_by", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def _(db):
    o = db.orders
    return db.select(o.o_orderstatus, o.o_orderpriority, agg.count().alias("n")).from_(o).group_by(o.o_orderstatus, o.o_orderpriority)


@query("agg_group_by_primary_key", "SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_mktsegment) AS c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(db):
    c, o = db.customer, db.orders
    return db.select(c.c_custkey, c.c_name, c.c_mktsegment, agg.count(o.o_orderkey).alias("n")).from_(c).left_join(o).group_by(c.c_custkey)


@query("agg_group_by_expression", "SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")
def _(db):
    k = (db.orders.o_custkey % 7).alias("k")
    return db.select(k, agg.count().alias("n")).from_(db.orders).group_by(k)


@query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(db):
    o = db.orders
    return db.select(o.o_custkey, agg.count().alias("n")).from_(o).group_by(o.o_custkey).having(cmp.gt(agg.count(), 15))


@query("agg_without_group", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, min(o_orderkey) AS low FROM orders")
def _(db):
    o = db.orders
    return db.select(agg.count().alias("n"), agg.sum_(o.o_custkey).alias("total"), agg.min_(o.o_orderkey).alias("low")).from_(o)


@query("agg_empty_input", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey < 0")
def _(db):
    o = db.orders
    return db.select(agg.count().alias("n"), agg.sum_(o.o_custkey).alias("total")).from_(o).where(cmp.lt(o.o_orderkey, 0))


# -- windows ------------------------------------------------------------------------------------


def windowed(name: str, make: Callable, sql: str, dialect: str = "pg") -> None:
    """A window over the orders of a customer, in the order of their keys."""

    def f(db):
        o = db.orders
        return db.select(o.o_orderkey, make(o, window().partition_by(o.o_custkey).order_by(asc(o.o_orderkey))).alias("v")).from_(o)

    query(name, f"SELECT o_orderkey, {sql} AS v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", dialect)(f)


windowed("win_row_number", lambda o, w: agg.row_number().over(w), "row_number() OVER w")
windowed("win_rank", lambda o, w: agg.rank().over(window().partition_by(o.o_custkey).order_by(asc(o.o_orderstatus))), "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus)")
windowed("win_dense_rank", lambda o, w: agg.dense_rank().over(window().partition_by(o.o_custkey).order_by(desc(o.o_orderstatus))), "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC)")
windowed("win_ntile", lambda o, w: agg.ntile(3).over(w), "ntile(3) OVER w")
windowed("win_percent_rank", lambda o, w: fn.round_to(agg.percent_rank().over(w), 9), "round(percent_rank() OVER w, 9)")
windowed("win_cume_dist", lambda o, w: fn.round_to(agg.cume_dist().over(w), 9), "round(cume_dist() OVER w, 9)")
windowed("win_lag", lambda o, w: agg.lag(o.o_orderdate).over(w), "lag(o_orderdate) OVER w")
windowed("win_lag_with_default", lambda o, w: agg.lag_with_default(o.o_custkey, 2, o.o_orderkey).over(w), "lag(o_custkey, 2, o_orderkey) OVER w")
windowed("win_lead", lambda o, w: agg.lead(o.o_totalprice).over(w), "lead(o_totalprice) OVER w")
windowed("win_lead_with_default", lambda o, w: agg.lead_with_default(o.o_orderkey, 1, -1).over(w), "lead(o_orderkey, 1, -1) OVER w")
windowed("win_first_value", lambda o, w: agg.first_value(o.o_orderkey).over(w), "first_value(o_orderkey) OVER w")
windowed("win_last_value", lambda o, w: agg.last_value(o.o_orderkey).over(w), "last_value(o_orderkey) OVER w")
windowed("win_nth_value", lambda o, w: agg.nth_value(o.o_orderkey, 2).over(w), "nth_value(o_orderkey, 2) OVER w")
windowed("win_over_partition", lambda o, w: agg.over(agg.count(), window().partition_by(o.o_orderpriority)), "count(*) OVER (PARTITION BY o_orderpriority)")
windowed("win_over_running_sum", lambda o, w: agg.over(agg.sum_(o.o_orderkey), w), "CAST(sum(o_orderkey) OVER w AS BIGINT)")
windowed("win_rows_between", lambda o, w: agg.over(agg.sum_(o.o_orderkey), w.rows_between(agg.preceding(2), agg.following(1))), "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT)")
windowed("win_range_between", lambda o, w: agg.over(agg.count(), w.range_between(agg.preceding(1000), agg.CURRENT_ROW)), "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)")
windowed("win_filter", lambda o, w: agg.over(agg.filter(agg.count(), cmp.eq(o.o_orderstatus, "O")), w), "count(*) FILTER (o_orderstatus = 'O') OVER w")
windowed("win_whole_frame", lambda o, w: agg.over(agg.max_(o.o_orderkey), w.rows_between(agg.UNBOUNDED_PRECEDING, agg.UNBOUNDED_FOLLOWING)), "max(o_orderkey) OVER (PARTITION BY o_custkey)")


# -- order, limit ----------------------------------------------------------------------------


@query("srt_order_by_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(db):
    o = db.orders
    return db.select(o.o_orderkey, o.o_totalprice).from_(o).order_by(desc(o.o_totalprice), asc(o.o_orderkey)).limit(25)


@query("srt_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100")
def _(db):
    o = db.orders
    return db.select(o.o_orderkey).from_(o).order_by(asc(o.o_orderkey)).limit(10).offset(100)


for _d, _asc, _desc in (("pg", "NULLS LAST", "NULLS FIRST"), ("sqlite", "NULLS FIRST", "NULLS LAST")):

    @query(f"srt_asc_{_d}", f"SELECT o_orderkey, {STATUS} AS s FROM orders ORDER BY s ASC {_asc}, o_orderkey LIMIT 40", _d)
    def _(db):
        s = status(db.orders).alias("s")
        return db.select(db.orders.o_orderkey, s).from_(db.orders).order_by(asc(s), asc(db.orders.o_orderkey)).limit(40)

    @query(f"srt_desc_{_d}", f"SELECT o_orderkey, {STATUS} AS s FROM orders ORDER BY s DESC {_desc}, o_orderkey LIMIT 40", _d)
    def _(db):
        s = status(db.orders).alias("s")
        return db.select(db.orders.o_orderkey, s).from_(db.orders).order_by(desc(s), asc(db.orders.o_orderkey)).limit(40)


for _d, _asc, _desc in (("pg", "NULLS LAST", "NULLS FIRST"), ("sqlite", "NULLS FIRST", "NULLS LAST")):
    for _way, _by, _nulls in (("asc", asc, _asc), ("desc", desc, _desc)):

        @query(f"srt_{_way}_{_d}_whole", f"SELECT o_orderkey, {STATUS} AS s, row_number() OVER (ORDER BY {STATUS} {_way} {_nulls}, o_orderkey) AS place FROM orders", _d)
        def _(db, by=_by):
            """Every row with its place in the order, nulls included."""
            o = db.orders
            return db.select(o.o_orderkey, status(o).alias("s"), agg.row_number().over(window().order_by(by(status(o)), asc(o.o_orderkey))).alias("place")).from_(o)


@query("srt_for_update", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def _(db):
    return db.select(db.orders.o_orderkey).from_(db.orders).where(cmp.eq(db.orders.o_custkey, 7)).for_update_of(db.orders).skip_locked()


# -- set operations, CTEs, subqueries ------------------------------------------------------------


def _sides(db):
    o = db.orders
    low = db.select(o.o_custkey.alias("k")).from_(o).where(cmp.lt(o.o_custkey, 300))
    high = db.select(o.o_custkey.alias("k")).from_(o).where(cmp.gt(o.o_custkey, 250), cmp.eq(o.o_orderstatus, "O"))
    return low, high


for _op, _text in {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}.items():

    @query(f"sop_{_op}", f"SELECT o_custkey AS k FROM orders WHERE o_custkey < 300 {_text} SELECT o_custkey FROM orders WHERE o_custkey > 250 AND o_orderstatus = 'O'")
    def _(db, op=_op):
        low, high = _sides(db)
        return getattr(low, "except_" if op == "except" else op)(high)


@query("sop_union_order_limit", "SELECT o_custkey AS k FROM orders WHERE o_custkey < 300 UNION SELECT o_custkey FROM orders WHERE o_custkey > 250 AND o_orderstatus = 'O' ORDER BY k DESC LIMIT 5")
def _(db):
    low, high = _sides(db)
    return low.union(high).order_by(desc(low.items[0])).limit(5)


@query("sop_cte", "WITH big AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), named AS (SELECT c_custkey, c_name FROM customer) SELECT c_name, n FROM big JOIN named ON k = c_custkey WHERE n > 12")
def _(db):
    o, c = db.orders, db.customer
    big = db.select(o.o_custkey.alias("k"), agg.count().alias("n")).from_(o).group_by(o.o_custkey).into_cte("big")
    named = db.select(c.c_custkey, c.c_name).from_(c).into_cte("named")
    return db.with_(big).with_(named).select(named.c_name, big.n).from_(big).join(named, cmp.eq(big.k, named.c_custkey)).where(cmp.gt(big.n, 12))


@query("sop_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def _(db):
    o = db.orders
    mean = db.select((agg.avg(o.o_totalprice) * 1.9).alias("m")).from_(o)
    return db.select(o.o_orderkey).from_(o).where(cmp.gt(o.o_totalprice, mean))


@query("sop_self_join_alias", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey WHERE a.o_custkey < 20")
def _(db):
    a, b = db.orders.alias("a"), db.orders.alias("b")
    return db.select(a.o_orderkey.alias("a"), b.o_orderkey.alias("b")).from_(a).join(b, cmp.eq(a.o_custkey, b.o_custkey) & cmp.lt(a.o_orderkey, b.o_orderkey)).where(cmp.lt(a.o_custkey, 20))


@query("sop_self_join_next", """
WITH placed AS (SELECT o_custkey AS owner, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT a.k AS a, b.k AS b FROM placed a JOIN placed b ON a.owner = b.owner AND b.n = a.n + 1""")  # fmt: skip
def _(db):
    """Each order with the next order of its customer."""
    o = db.orders
    place = agg.row_number().over(window().partition_by(o.o_custkey).order_by(asc(o.o_orderkey)))
    placed = db.select(o.o_custkey.alias("owner"), o.o_orderkey.alias("k"), place.alias("n")).from_(o).into_cte("placed")
    a, b = placed.alias("a"), placed.alias("b")
    return db.with_(placed).select(a.k.alias("a"), b.k.alias("b")).from_(a).join(b, cmp.eq(a.owner, b.owner) & cmp.eq(b.n, a.n + 1))


# -- nulls and conditions ------------------------------------------------------------------------

ORDERS = ("orders", "o_orderkey")
scalar("nul_coalesce", *ORDERS, lambda t: fn.coalesce(status(t), "none"), f"coalesce({STATUS}, 'none')")
scalar("nul_coalesce_many", *ORDERS, lambda t: fn.coalesce_many(status(t), [fn.nullif(t.o_orderpriority, "5-LOW"), "z"]), f"coalesce({STATUS}, nullif(o_orderpriority, '5-LOW'), 'z')")
scalar("nul_nullif", *ORDERS, status, STATUS)
scalar("nul_ifnull", *ORDERS, lambda t: fn.ifnull(status(t), "x"), f"ifnull({STATUS}, 'x')", "sqlite")
scalar("nul_greatest", *ORDERS, lambda t: fn.greatest(fn.nullif(t.o_custkey, 7), t.o_orderkey), "greatest(nullif(o_custkey, 7), o_orderkey)")
scalar("nul_least", *ORDERS, lambda t: fn.least(fn.nullif(t.o_custkey, 7), t.o_orderkey), "least(nullif(o_custkey, 7), o_orderkey)")
scalar("nul_case", *ORDERS, lambda t: fn.case().when(cmp.lt(t.o_custkey, 100), "low").when(cmp.lt(t.o_custkey, 500), "mid").end(), "CASE WHEN o_custkey < 100 THEN 'low' WHEN o_custkey < 500 THEN 'mid' END")
scalar("nul_case_else", *ORDERS, lambda t: fn.case().when(cmp.eq(status(t), "O"), 1).else_(0), f"CASE WHEN {STATUS} = 'O' THEN 1 ELSE 0 END")

# -- strings ----------------------------------------------------------------------------------------

PART = ("part", "p_partkey")
scalar("str_upper", *PART, lambda t: fn.upper(t.p_name), "upper(p_name)")
scalar("str_lower", *PART, lambda t: fn.lower(t.p_type), "lower(p_type)")
scalar("str_trim", *PART, lambda t: fn.trim(fn.concat(fn.concat("  ", t.p_name), "  ")), "trim('  ' || p_name || '  ')")
scalar("str_ltrim", *PART, lambda t: fn.ltrim(fn.concat(fn.concat("  ", t.p_name), " ")), "ltrim('  ' || p_name || ' ')")
scalar("str_rtrim", *PART, lambda t: fn.rtrim(fn.concat(fn.concat(" ", t.p_name), "  ")), "rtrim(' ' || p_name || '  ')")
condition("str_collate", lambda t: cmp.eq(fn.collate(t.o_orderpriority, "NOCASE"), "1-urgent"), "lower(o_orderpriority) = '1-urgent'", dialect="sqlite")
scalar("str_length", *PART, lambda t: fn.length(t.p_name), "length(p_name)")
scalar("str_char_length", *PART, lambda t: fn.char_length(t.p_type), "length(p_type)")
scalar("str_octet_length", "documents", "doc_id", lambda t: fn.octet_length(t.text), "CAST(strlen(text) AS BIGINT)")
scalar("str_substr", *PART, lambda t: fn.substr(t.p_name, 2, 3), "substr(p_name, 2, 3)")
scalar("str_substr_zero", *PART, lambda t: fn.substr(t.p_name, 0, 3), "substr(p_name, 1, 2)")
scalar("str_replace", *PART, lambda t: fn.replace_(t.p_type, "E", "_"), "replace(p_type, 'E', '_')")
scalar("str_instr", *PART, lambda t: fn.instr(t.p_type, "A"), "CAST(instr(p_type, 'A') AS BIGINT)", "sqlite")
scalar("str_strpos", *PART, lambda t: fn.strpos(t.p_type, "ST"), "CAST(strpos(p_type, 'ST') AS BIGINT)")
scalar("str_concat", *ORDERS, lambda t: fn.concat(status(t), "!"), f"{STATUS} || '!'")
scalar("str_string_concat", *ORDERS, lambda t: fn.string_concat(t.o_orderpriority, t.o_orderstatus), "o_orderpriority || o_orderstatus")
scalar("str_concat_ws", *ORDERS, lambda t: fn.concat_ws("-", [status(t), t.o_orderpriority]), f"concat_ws('-', {STATUS}, o_orderpriority)")
scalar("str_left", *PART, lambda t: fn.left(t.p_type, 4), "left(p_type, 4)")
scalar("str_left_negative", *PART, lambda t: fn.left(t.p_type, -2), "left(p_type, -2)")
scalar("str_right", *PART, lambda t: fn.right(t.p_type, 4), "right(p_type, 4)")
scalar("str_right_negative", *PART, lambda t: fn.right(t.p_type, -2), "right(p_type, -2)")
scalar("str_split_part", *PART, lambda t: fn.split_part(t.p_brand, "#", 2), "split_part(p_brand, '#', 2)")
scalar("str_split_part_past_end", *PART, lambda t: fn.split_part(t.p_brand, "#", 9), "split_part(p_brand, '#', 9)")
scalar("str_lpad", *PART, lambda t: fn.lpad(t.p_brand, 12, "*"), "lpad(p_brand, 12, '*')")
scalar("str_rpad", *PART, lambda t: fn.rpad(t.p_brand, 5, "*"), "rpad(p_brand, 5, '*')")
scalar("str_initcap", *PART, lambda t: fn.initcap(fn.concat(fn.lower(t.p_type), "-x y")), "array_to_string(list_transform(regexp_extract_all(lower(p_type) || '-x y', '[a-z0-9]+|[^a-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '')")
scalar("str_reverse", *PART, lambda t: fn.reverse(t.p_name), "reverse(p_name)")
scalar("str_repeat", *PART, lambda t: fn.repeat(t.p_brand, 2), "repeat(p_brand, 2)")
scalar("str_starts_with", *PART, lambda t: fn.starts_with(t.p_brand, "Brand#1"), "starts_with(p_brand, 'Brand#1')")
scalar("str_translate", *PART, lambda t: fn.translate(t.p_type, "AEI", "12"), "translate(p_type, 'AEI', '12')")
scalar("str_regexp_replace", *PART, lambda t: fn.regexp_replace(t.p_type, "[AE]", "_"), "regexp_replace(p_type, '[AE]', '_')")
scalar("str_regexp_replace_group", *PART, lambda t: fn.regexp_replace(t.p_type, "([AE])(.)", "\\2\\1"), "regexp_replace(p_type, '([AE])(.)', '\\2\\1')")
scalar("str_regexp_replace_flags", *PART, lambda t: fn.regexp_replace_flags(t.p_type, "[ae]", "_", "gi"), "regexp_replace(p_type, '[ae]', '_', 'gi')")
scalar("str_regexp_match", *PART, lambda t: Expr(F.array_join(fn.regexp_match(t.p_brand, "(B)rand#(\\d)").column, "|"), "text"), "CASE WHEN regexp_matches(p_brand, '(B)rand#(\\d)') THEN regexp_extract(p_brand, '(B)rand#(\\d)', 1) || '|' || regexp_extract(p_brand, '(B)rand#(\\d)', 2) END")
scalar("str_regexp_match_flags", *PART, lambda t: Expr(F.array_join(fn.regexp_match_flags(t.p_brand, "brand#4", "i").column, "|"), "text"), "CASE WHEN regexp_matches(p_brand, 'brand#4', 'i') THEN regexp_extract(p_brand, 'brand#4', 0, 'i') END")

# -- numbers ---------------------------------------------------------------------------------------------

CUST = ("customer", "c_custkey")
scalar("mth_abs", *CUST, lambda t: fn.abs_(t.c_acctbal), "abs(c_acctbal)")
scalar("mth_round", *CUST, lambda t: fn.round_(t.c_acctbal), "round(c_acctbal)")
scalar("mth_round_to", *CUST, lambda t: fn.round_to(t.c_acctbal / 7.0, 3), "round(c_acctbal / 7.0, 3)")
scalar("mth_ceil", *CUST, lambda t: fn.ceil(t.c_acctbal), "ceil(c_acctbal)")
scalar("mth_floor", *CUST, lambda t: fn.floor(t.c_acctbal), "floor(c_acctbal)")
scalar("mth_trunc", *CUST, lambda t: fn.trunc(t.c_acctbal), "trunc(c_acctbal)")
scalar("mth_sqrt", *CUST, lambda t: fn.round_to(fn.sqrt(fn.abs_(t.c_acctbal)), 6), "round(sqrt(abs(c_acctbal)), 6)")
scalar("mth_sqrt_sqlite", *CUST, lambda t: fn.round_to(fn.sqrt(t.c_acctbal), 6), "CASE WHEN c_acctbal >= 0 THEN round(sqrt(greatest(c_acctbal, 0)), 6) END", "sqlite")
scalar("mth_power", *PART, lambda t: fn.power(t.p_size, 2), "power(p_size, 2)")
scalar("mth_exp", *PART, lambda t: fn.round_to(fn.exp(t.p_size / 10.0), 6), "round(exp(p_size / 10.0), 6)")
scalar("mth_ln", *PART, lambda t: fn.round_to(fn.ln(t.p_size), 9), "round(ln(p_size), 9)")
scalar("mth_log10", *PART, lambda t: fn.round_to(fn.log10(t.p_size), 9), "round(log10(p_size), 9)")
scalar("mth_log", *PART, lambda t: fn.round_to(fn.log(3, t.p_size), 9), "round(ln(p_size) / ln(3), 9)")
scalar("mth_log2", *PART, lambda t: fn.round_to(fn.log2(t.p_size), 9), "round(log2(p_size), 9)", "sqlite")
scalar("mth_sign", *CUST, lambda t: fn.sign(t.c_acctbal), "CAST(sign(c_acctbal) AS INTEGER)")
scalar("mth_mod", *CUST, lambda t: fn.mod_(-t.c_custkey, 7), "-c_custkey % 7")
scalar("mth_pi", *PART, lambda t: fn.round_to(fn.pi() * t.p_size, 9), "round(pi() * p_size, 9)")
scalar("mth_random", *PART, lambda t: cmp.between(fn.random(), 0.0, 1.0), "random() BETWEEN 0 AND 1")
scalar("mth_add", *PART, lambda t: t.p_size + 1, "p_size + 1")
scalar("mth_sub", *PART, lambda t: t.p_size - 100, "p_size - 100")
scalar("mth_mul", *PART, lambda t: (t.p_size + 1) * 3, "(p_size + 1) * 3")
scalar("mth_div_whole", *CUST, lambda t: (-t.c_custkey) / 2, "-c_custkey // 2 + CASE WHEN c_custkey % 2 = 1 AND -c_custkey // 2 * 2 <> -c_custkey AND -c_custkey // 2 * 2 < -c_custkey THEN 1 ELSE 0 END")
scalar("mth_div", *CUST, lambda t: fn.round_to(t.c_acctbal / 4, 6), "round(c_acctbal / 4, 6)")
scalar("mth_div_zero_sqlite", *PART, lambda t: t.p_size / (t.p_size % 2), "CASE WHEN p_size % 2 <> 0 THEN p_size // (p_size % 2) END", "sqlite")
scalar("mth_rem", *PART, lambda t: t.p_size % 7, "p_size % 7")
scalar("mth_neg", *PART, lambda t: -t.p_size, "-p_size")

# -- dates and times ------------------------------------------------------------------------------------

scalar("dtm_current_date", "region", "r_regionkey", lambda t: cmp.eq(fn.cast(dt.current_timestamp(), "date"), dt.current_date()), "true")
scalar("dtm_current_time", "region", "r_regionkey", lambda t: cmp.eq(fn.length(fn.cast(dt.current_time(), "text")), 8), "true")
scalar("dtm_now", "region", "r_regionkey", lambda t: cmp.eq(dt.now(), dt.current_timestamp()), "true")
scalar("dtm_localtimestamp", "region", "r_regionkey", lambda t: cmp.gt(dt.localtimestamp(), dt.moment("2024-01-01")), "true")
scalar("dtm_localtime", "region", "r_regionkey", lambda t: cmp.is_not_null(dt.localtime()), "true")
scalar("dtm_clock_timestamp", "region", "r_regionkey", lambda t: cmp.is_not_null(dt.clock_timestamp()), "true")
EVENTS = ("events", "event_id")
scalar("dtm_date", *EVENTS, lambda t: dt.date(t.ts), "strftime(ts, '%Y-%m-%d')", "sqlite")
scalar("dtm_time", *EVENTS, lambda t: dt.time(t.ts), "strftime(ts, '%H:%M:%S')", "sqlite")
scalar("dtm_datetime", *EVENTS, lambda t: dt.datetime_(t.ts), "strftime(ts, '%Y-%m-%d %H:%M:%S')", "sqlite")
scalar("dtm_strftime", *EVENTS, lambda t: dt.strftime("%d/%m/%Y at %H:%M", t.ts), "strftime(ts, '%d/%m/%Y at %H:%M')", "sqlite")
scalar("dtm_julianday", *EVENTS, lambda t: fn.round_to(dt.julianday(t.ts), 4), "round(epoch_us(ts) / 86400000000.0 + 2440587.5, 4)", "sqlite")
scalar("dtm_unixepoch", *EVENTS, lambda t: dt.unixepoch(t.ts), "CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT)", "sqlite")
for _unit in ("hour", "day", "month"):
    scalar(f"dtm_date_trunc_{_unit}", *EVENTS, lambda t, u=_unit: dt.date_trunc(u, t.ts), f"CAST(date_trunc('{_unit}', ts) AS TIMESTAMP)")
for _field, _sql in {"year": "extract(year FROM ts)", "month": "extract(month FROM ts)", "dow": "dayofweek(ts)", "isodow": "isodow(ts)", "doy": "dayofyear(ts)", "hour": "hour(ts)", "epoch": "epoch_us(ts) / 1000000.0", "quarter": "quarter(ts)"}.items():
    scalar(f"dtm_extract_{_field}", *EVENTS, lambda t, f=_field: dt.extract(f, t.ts), f"CAST({_sql} AS DOUBLE)")
scalar("dtm_age", *EVENTS, lambda t: Expr(dt.age(t.ts, dt.moment("2023-11-15 12:30:00")).column["months"], "int4"), "CAST(datesub('month', TIMESTAMP '2023-11-15 12:30:00', ts) AS INTEGER)")
scalar("dtm_to_char", *EVENTS, lambda t: dt.to_char(t.ts, "YYYY-MM-DD HH24:MI"), "strftime(ts, '%Y-%m-%d %H:%M')")
scalar("dtm_to_timestamp", *EVENTS, lambda t: fn.cast(dt.to_timestamp(t.event_id), "timestamp"), "make_timestamp(event_id * 1000000)")
scalar("dtm_to_date", *EVENTS, lambda t: dt.to_date(dt.to_char(t.ts, "DD.MM.YYYY"), "DD.MM.YYYY"), "CAST(ts AS DATE)")
scalar("dtm_to_number", *PART, lambda t: fn.cast(dt.to_number(fn.cast(t.p_size, "text"), "99999"), "float8"), "CAST(p_size AS DOUBLE)")
scalar("dtm_date_bin", *EVENTS, lambda t: dt.date_bin("15 minutes", t.ts, dt.moment("2024-01-01 00:05:00")), "time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01 00:05:00')")
scalar("dtm_make_date", *PART, lambda t: dt.make_date(2000 + t.p_size, 2, 28), "make_date(2000 + p_size, 2, 28)")
scalar("dtm_make_timestamp", *PART, lambda t: dt.make_timestamp(2000 + t.p_size, 3, 4, 5, 6, 7.5), "make_timestamp(2000 + p_size, 3, 4, 5, 6, 7.5)")
scalar("dtm_timediff", *EVENTS, lambda t: dt.timediff(dt.moment("2024-03-01 00:00:00"), t.ts), None, "sqlite")

# -- JSON ------------------------------------------------------------------------------------------------

scalar("jsn_json", *EVENTS, lambda t: js.json(t.props), "replace(props, ' ', '')", "sqlite")
scalar("jsn_jsonb", *EVENTS, lambda t: js.jsonb(t.props), "replace(props, ' ', '')", "sqlite")
condition("jsn_json_eq", lambda t: js.json_eq(t.props, "k", 7), "props->>'$.k' = '7'", "events", "event_id", "sqlite")
condition("jsn_json_ne", lambda t: js.json_ne(t.props, "k", 7), "props->>'$.k' <> '7'", "events", "event_id", "sqlite")
condition("jsn_json_contains", lambda t: js.json_contains(t.props, "$.k", 9), "props->>'$.k' = '9'", "events", "event_id", "sqlite")
condition("jsn_json_exists", lambda t: js.json_exists(t.props, "$.k"), "json_type(props, '$.k') IS NOT NULL", "events", "event_id", "sqlite")
condition("jsn_json_not_exists", lambda t: js.json_not_exists(t.props, "$.q"), "json_type(props, '$.q') IS NULL", "events", "event_id", "sqlite")
_LIST = "'{\"a\": [' || event_id % 5 || ', 9], \"s\": \"Text ' || event_id || '\"}'"


def _listed(t) -> Expr:
    """A JSON document with an array and a text."""
    n = fn.cast(t.event_id % 5, "text")
    made = fn.concat(fn.concat(fn.concat('{"a": [', n), ', 9], "s": "Text '), fn.concat(fn.cast(t.event_id, "text"), '"}'))
    return Expr(made.column, "jsonb", made.nullable, made.kind, None, made.dialect, None, made.parts)


condition("jsn_json_array_contains", lambda t: js.json_array_contains(_listed(t), "$.a", 3), "event_id % 5 = 3", "events", "event_id", "sqlite")
condition("jsn_json_object_contains_key", lambda t: js.json_object_contains_key(t.props, "$", "k"), "list_contains(json_keys(props), 'k')", "events", "event_id", "sqlite")
condition("jsn_json_text_contains", lambda t: js.json_text_contains(_listed(t), "$.s", "TEXT 77"), "contains('text ' || event_id, 'text 77')", "events", "event_id", "sqlite")
condition("jsn_json_gt", lambda t: js.json_gt(t.props, "$.k", 50.0), "TRY_CAST(props->>'$.k' AS DOUBLE) > 50", "events", "event_id", "sqlite")
scalar("jsn_json_extract", *EVENTS, lambda t: js.json_extract(t.props, "$.k"), "props->>'$.k'", "sqlite")
scalar("jsn_json_extract_text", *EVENTS, lambda t: js.json_extract_text(_listed(t), "$.s"), "'\"Text ' || event_id || '\"'", "sqlite")
scalar("jsn_json_get", *EVENTS, lambda t: js.json_get(_listed(t), "a"), "'[' || event_id % 5 || ',9]'")
scalar("jsn_json_get_idx", *EVENTS, lambda t: js.json_get_idx(js.json_get(_listed(t), "a"), -2), "CAST(event_id % 5 AS VARCHAR)")
scalar("jsn_json_get_text", *EVENTS, lambda t: js.json_get_text(_listed(t), "s"), "'Text ' || event_id")
scalar("jsn_json_get_text_idx", *EVENTS, lambda t: js.json_get_text_idx(js.json_get(_listed(t), "a"), 1), "'9'")
scalar("jsn_json_get_path", *EVENTS, lambda t: js.json_get_path(_listed(t), "{a,0}"), "CAST(event_id % 5 AS VARCHAR)")
scalar("jsn_json_get_path_text", *EVENTS, lambda t: js.json_get_path_text(_listed(t), "{s}"), "'Text ' || event_id")
condition("jsn_jsonb_contains", lambda t: js.jsonb_contains(_listed(t), '{"a": [3]}'), "event_id % 5 = 3", "events", "event_id")
condition("jsn_jsonb_contained", lambda t: js.jsonb_contained(js.json_get(_listed(t), "a"), "[9, 2, 1]"), "event_id % 5 IN (1, 2)", "events", "event_id")
condition("jsn_jsonb_exists_key", lambda t: js.jsonb_exists_key(t.props, "k"), "list_contains(json_keys(props), 'k')", "events", "event_id")
condition("jsn_jsonb_exists_any", lambda t: js.jsonb_exists_any(t.props, ["zz", "k"]), "list_contains(json_keys(props), 'k')", "events", "event_id")
condition("jsn_jsonb_exists_all", lambda t: js.jsonb_exists_all(_listed(t), ["a", "s"]), "true", "events", "event_id")


# -- arrays -------------------------------------------------------------------------------------------------


def _array(t) -> Expr:
    return Expr(F.array(t.p_size.column, (t.p_size.column % 5).cast("int")), "int4[]", False, "scalar", None, "pg", None, (t.p_size,))


condition("arr_array_contains", lambda t: fn.array_contains(_array(t), [3]), "list_has_all([p_size, p_size % 5], [3])", "part", "p_partkey")
condition("arr_array_contained", lambda t: fn.array_contained(_array(t), [1, 2, 3, 6, 7]), "list_has_all([1, 2, 3, 6, 7], [p_size, p_size % 5])", "part", "p_partkey")
condition("arr_array_overlaps", lambda t: fn.array_overlaps(_array(t), [4, 40]), "list_has_any([p_size, p_size % 5], [4, 40])", "part", "p_partkey")


# -- relations ----------------------------------------------------------------------------------------------


def _flat(df: DataFrame, relation: str, *columns: str) -> DataFrame:
    """Nested rows as flat ones, with their place in the list."""
    return df.select(*columns, F.posexplode_outer(relation).alias("pos", "child"))


@query("rel_many", "SELECT o_orderkey, count(l_orderkey) AS n, CAST(coalesce(sum(l_partkey), 0) AS BIGINT) AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(db):
    found = Query(db.orders).with_(many("items", db.orders, db.lineitem)).df()
    return found.select("o_orderkey", F.size("items").cast("bigint").alias("n"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["l_partkey"]).alias("parts"))


@query("rel_one", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(db):
    return Query(db.nation).with_(one("region", db.nation, db.region)).df().select("n_nationkey", "n_name", F.col("region.r_name").alias("r_name"))


@query("rel_optional_one", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 2")
def _(db):
    r = Query.of(one("nation", db.supplier, db.nation)).where(cmp.lt(db.nation.n_regionkey, 2))
    return Query(db.supplier).with_(r).df().select("s_suppkey", F.col("nation.n_name").alias("n_name"))


@query("rel_many_to_many", "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS sizes FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderkey < 2000 GROUP BY o_orderkey")
def _(db):
    q = Query(db.orders).where(cmp.lt(db.orders.o_orderkey, 2000)).with_(many_to_many("parts", db.orders, db.lineitem, db.part)).df()
    return q.where(F.size("parts") > 0).select("o_orderkey", F.size("parts").cast("bigint").alias("n"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["p_size"]).alias("sizes"))


@query("rel_many_to_many_whole", "SELECT o_orderkey, CAST(count(p_partkey) AS BIGINT) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS sizes FROM orders LEFT JOIN (lineitem JOIN part ON p_partkey = l_partkey) ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(db):
    q = Query(db.orders).with_(many_to_many("parts", db.orders, db.lineitem, db.part)).df()
    return q.select("o_orderkey", F.size("parts").cast("bigint").alias("n"), F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x["p_size"]).alias("sizes"))


@query("rel_children_order_limit", """
SELECT c_custkey, CAST(n - 1 AS INTEGER) AS pos, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n <= 3""")
def _(db):
    """The three largest orders of each customer."""
    q = Query.of(many("orders", db.customer, db.orders)).order_by(desc(db.orders.o_totalprice)).limit(3)
    return _flat(Query(db.customer).with_(q).df(), "orders", "c_custkey").select("c_custkey", "pos", F.col("child.o_orderkey").alias("o_orderkey"))


@query("rel_children_offset", """
SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) ON o_custkey = c_custkey AND n > 2 AND n <= 4""")
def _(db):
    q = Query.of(many("orders", db.customer, db.orders)).limit(2).offset(2)
    return Query(db.customer).with_(q).df().select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")


@query("rel_children_where_first", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def _(db):
    q = Query.of(many("orders", db.customer, db.orders)).where(cmp.eq(db.orders.o_orderstatus, "O")).first()
    return Query(db.customer).with_(q).df().select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")


@query("rel_nested", "SELECT r_regionkey, n_nationkey, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def _(db):
    q = Query(db.region).with_(Query.of(many("nations", db.region, db.nation)).with_(many("suppliers", db.nation, db.supplier)))
    n = q.df().select("r_regionkey", F.explode("nations").alias("n"))
    return n.select("r_regionkey", "n.n_nationkey", F.explode("n.suppliers").alias("s")).select("r_regionkey", "n_nationkey", "s.s_suppkey")


@query("rel_parents_page", "SELECT o_orderkey, n FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5)")
def _(db):
    q = Query(db.orders).order_by(asc(db.orders.o_orderkey)).limit(10).offset(5).with_(many("items", db.orders, db.lineitem))
    return q.df().select("o_orderkey", F.size("items").cast("bigint").alias("n"))


@query("rel_columns_omit", "SELECT n_nationkey, n_name FROM nation")
def _(db):
    return Query(db.nation).omit("n_regionkey").df()


# -- writes --------------------------------------------------------------------------------------------------


def _small(db) -> object:
    """The regions with a unique name."""
    t = db.region
    return db.register("region", t.frame, Table("region", t.table.columns, ("r_regionkey",), (), (("r_name",),)))


@query("dml_insert_values", "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (10, 'ATLANTIS'), (11, NULL))")
def _(db):
    return dml.insert(_small(db)).values([{"r_regionkey": 10, "r_name": "ATLANTIS"}, {"r_regionkey": 11, "r_name": None}]).write().result


@query("dml_insert_select", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey < 3")
def _(db):
    n = db.nation
    return dml.insert(_small(db)).select(db.select(n.n_nationkey + 100, n.n_name).from_(n).where(cmp.lt(n.n_nationkey, 3))).write().result


@query("dml_insert_returning", "SELECT 12 AS r_regionkey, 'X' AS r_name")
def _(db):
    return dml.insert(_small(db)).value({"r_regionkey": 12, "r_name": "X"}).returning()


def _offered(db):
    n = db.nation
    return dml.insert(_small(db)).select(db.select(n.n_nationkey, n.n_name).from_(n).where(cmp.lt(n.n_nationkey, 8)))


@query("dml_on_conflict_do_nothing", "SELECT * FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 8 AND n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def _(db):
    return _offered(db).on_conflict("r_regionkey").do_nothing().write().result


@query("dml_on_any_conflict_do_nothing", "SELECT * FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 8 AND n_nationkey NOT IN (SELECT r_regionkey FROM region) AND n_name NOT IN (SELECT r_name FROM region)")
def _(db):
    return _offered(db).on_conflict_do_nothing().write().result


@query("dml_on_conflict_do_update", "SELECT r_regionkey, coalesce('new ' || n_name, r_name) AS r_name FROM region LEFT JOIN nation ON n_nationkey = r_regionkey UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 8 AND n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def _(db):
    s = _offered(db)
    return s.on_conflict("r_regionkey").do_update({"r_name": fn.concat("new ", dml.excluded(s.target, "r_name"))}).write().result


@query("dml_on_constraint_do_update_where", "SELECT r_regionkey, CASE WHEN r_regionkey > 2 THEN n_name ELSE r_name END AS r_name FROM region LEFT JOIN nation ON n_nationkey = r_regionkey UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 8 AND n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def _(db):
    s = _offered(db)
    return s.on_conflict_on_constraint("region_pkey").do_update({"r_name": dml.excluded(s.target, "r_name")}).where(cmp.gt(s.target.r_regionkey, 2)).write().result


@query("dml_update", "SELECT o_orderkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(db):
    o = db.orders
    return dml.update(o).set({"o_orderstatus": "X"}).where(cmp.lt(o.o_custkey, 100)).write().result.select("o_orderkey", "o_orderstatus")


@query("dml_update_returning", "SELECT c_custkey, round(c_acctbal * 2, 2) AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(db):
    c = db.customer
    return dml.update(c).set({"c_acctbal": fn.round_to(c.c_acctbal * 2, 2)}).where(cmp.eq(c.c_mktsegment, "BUILDING")).returning("c_custkey", "c_acctbal")


@query("dml_update_from", "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(db):
    s, n = db.supplier, db.nation
    return dml.update(s).set({"s_name": n.n_name}).from_(n).where(cmp.eq(s.s_nationkey, n.n_nationkey) & cmp.eq(n.n_regionkey, 1)).write().result.select("s_suppkey", "s_name")


@query("dml_delete", f"SELECT o_orderkey FROM orders WHERE NOT coalesce({STATUS} = 'O', false)")
def _(db):
    """Rows whose condition is null stay."""
    return dml.delete(db.orders).where(cmp.eq(status(db.orders), "O")).write().result.select("o_orderkey")


@query("dml_delete_returning", "SELECT * FROM nation WHERE n_regionkey = 2")
def _(db):
    return dml.delete(db.nation).where(cmp.eq(db.nation.n_regionkey, 2)).returning()


# -- prepared statements, transactions, schemas, seeds ----------------------------------------------------


@query("pre_named_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'")
def _(db):
    from sparkweft.operators.prepared import Placeholder, prepare

    db.orders.frame.createOrReplaceTempView("prepared_orders")
    s = prepare(db.spark, "SELECT o_orderkey FROM prepared_orders WHERE o_custkey = :customer AND o_orderstatus <> :status")
    return s.run(Placeholder.typed("customer", db.orders.o_custkey).bind(7), Placeholder.typed("status", db.orders.o_orderstatus).bind("F"))


@query("pre_transaction", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 20, 'NEW'")
def _(db):
    _small(db)
    with dml.Transaction(db) as tx:
        tx.run(dml.insert(tx.table("region")).value({"r_regionkey": 20, "r_name": "NEW"}))
        tx.run(dml.delete(tx.table("region")).where(cmp.eq(tx.table("region").r_regionkey, 2)))
    return db.table("region").frame


@query("sch_conform", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'none' AS note FROM nation")
def _(db):
    new = Table("nation", (Column("id", "int8"), Column("name"), Column("note", "text", True, "none")))
    return conform(db.nation.frame, new, {"n_nationkey": "id", "n_name": "name"})


@query("sch_diff", "SELECT * FROM (VALUES (0, 'add_table', 'extra', NULL), (1, 'alter_column', 'nation', 'n_nationkey'), (2, 'add_column', 'nation', 'note'), (3, 'rebuild', 'nation', NULL)) t(step, kind, table_name, column_name)")
def _(db):
    before = [table_of("nation", db.nation.frame)]
    after = [Table("nation", tuple(Column(c.name, "int8" if c.name == "n_nationkey" else c.type) for c in before[0].columns) + (Column("note"),)), Table("extra", (Column("id", "int4", False), Column("nation", "int4")), ("id",), (ForeignKey(("nation",), "nation", ("n_nationkey",)),))]
    plan = diff_schemas(before, after)
    return db.spark.createDataFrame([(i, c.kind, c.table, c.column) for i, c in enumerate(plan.changes)], "step int, kind string, table_name string, column_name string")


@query("sch_seed", "SELECT 100 AS parents, 300 AS children, 300 AS linked")
def _(db):
    from .seed import SeedConfig

    users = Table("users", (Column("id", "int8", False), Column("name"), Column("email")), ("id",))
    posts = Table("posts", (Column("id", "int8", False), Column("author_id", "int8"), Column("title")), ("id",), (ForeignKey(("author_id",), "users", ("id",)),))
    made = SeedConfig((posts, users)).seed(42).count("users", 100).relation("users", "posts", 3).generate(db.spark)
    linked = made["posts"].join(made["users"].select(F.col("id").alias("author_id")), "author_id").agg(F.count(F.lit(1)).cast("int").alias("linked"))
    sizes = made["users"].agg(F.count(F.lit(1)).cast("int").alias("parents")).crossJoin(made["posts"].agg(F.count(F.lit(1)).cast("int").alias("children")))
    return sizes.crossJoin(linked)


# -- Spark's own: rollup, cube, grouping sets, sketches, streams ----------------------------------------------


@query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(db):
    return db.orders.frame.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(db):
    return db.orders.frame.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("ext_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
def _(db):
    return db.spark.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")


_TUMBLING = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS stop, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2, 3"


@query("str_tumbling_batch", _TUMBLING)
def _(db):
    return streams.tumbling(db.events.frame)


@query("str_tumbling_stream", _TUMBLING)
def _(db):
    """The stream over the same files, in complete mode."""
    source = db.spark.readStream.schema(db.events.frame.schema).option("pathGlobFilter", "*.parquet").parquet(f"{db.folder}/events.parquet*")
    streams.run(streams.tumbling(source.withColumn("ts", F.col("ts").cast("timestamp"))), "tumbling_events")
    return db.spark.table("tumbling_events")


@query("str_sessions_batch", """
WITH marked AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM numbered GROUP BY user_id, s""")
def _(db):
    return streams.sessions(db.events.frame)


# -- subqueries wherever a condition may stand -----------------------------------------------


def _few(db: Database):
    c = db.customer
    return db.select(c.c_custkey).from_(c).where(cmp.gt(c.c_acctbal, 5000.0))


def _maybe_null(db: Database):
    c = db.customer
    return db.select(fn.nullif(c.c_custkey, 7).alias("k"), fn.nullif(c.c_nationkey, 3).alias("n")).from_(c).where(cmp.gt(c.c_acctbal, 5000.0))


FEW = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"


@query("cmp_or_subquery", f"SELECT o_orderkey FROM orders WHERE o_custkey IN ({FEW}) OR o_orderstatus = 'O'")
def _(db):
    o = db.orders
    return db.select(o.o_orderkey).from_(o).where(cmp.or_(cmp.in_subquery(o.o_custkey, _few(db)), cmp.eq(o.o_orderstatus, "O")))


@query("cmp_any_subquery", f"SELECT o_orderkey FROM orders WHERE o_custkey NOT IN ({FEW}) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def _(db):
    o, l = db.orders, db.lineitem
    large = db.select(l.l_orderkey).from_(l).where(cmp.eq(l.l_orderkey, o.o_orderkey), cmp.gt(l.l_quantity, 49.0))
    return db.select(o.o_orderkey).from_(o).where(cmp.any_(cmp.not_in_subquery(o.o_custkey, _few(db)), cmp.exists(large)))


@query("cmp_not_subquery", f"SELECT o_orderkey FROM orders WHERE NOT (o_custkey IN ({FEW}) AND o_totalprice > 100000)")
def _(db):
    o = db.orders
    return db.select(o.o_orderkey).from_(o).where(cmp.not_(cmp.and_(cmp.in_subquery(o.o_custkey, _few(db)), cmp.gt(o.o_totalprice, 100000.0))))


@query("cmp_in_subquery_three_values", f"SELECT s_suppkey, s_suppkey IN (SELECT nullif(c_custkey, 7) FROM customer WHERE c_acctbal > 5000) AS found FROM supplier")
def _(db):
    """Null where no row equals and one is null."""
    s, c = db.supplier, db.customer
    inner = db.select(fn.nullif(c.c_custkey, 7).alias("k")).from_(c).where(cmp.gt(c.c_acctbal, 5000.0))
    return db.select(s.s_suppkey, cmp.in_subquery(s.s_suppkey, inner).alias("found")).from_(s)


@query("cmp_not_in_subquery_tuple", "SELECT s_suppkey FROM supplier WHERE (s_suppkey, s_nationkey) NOT IN (SELECT nullif(c_custkey, 7), nullif(c_nationkey, 3) FROM customer WHERE c_acctbal > 5000)")
def _(db):
    s = db.supplier
    return db.select(s.s_suppkey).from_(s).where(cmp.not_in_subquery((s.s_suppkey, s.s_nationkey), _maybe_null(db)))


@query("cmp_case_subquery", f"SELECT o_orderkey, CASE WHEN o_custkey IN ({FEW}) THEN 'rich' ELSE 'other' END AS v FROM orders")
def _(db):
    o = db.orders
    return db.select(o.o_orderkey, fn.case().when(cmp.in_subquery(o.o_custkey, _few(db)), "rich").else_("other").alias("v")).from_(o)


def _busy(db: Database, least: int):
    o, c = db.orders, db.customer
    return db.select(o.o_custkey).from_(o).where(cmp.eq(o.o_custkey, c.c_custkey)).group_by(o.o_custkey).having(cmp.gt(agg.count(o.o_orderkey), least))


@query("cmp_exists_having", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey GROUP BY o_custkey HAVING count(o_orderkey) > 10)")
def _(db):
    return db.select(db.customer.c_custkey).from_(db.customer).where(cmp.exists(_busy(db, 10)))


@query("cmp_not_exists_having", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey GROUP BY o_custkey HAVING count(o_orderkey) > 10)")
def _(db):
    return db.select(db.customer.c_custkey).from_(db.customer).where(cmp.not_exists(_busy(db, 10)))


@query("cmp_exists_correlated_limit", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000 LIMIT 1)")
def _(db):
    o, c = db.orders, db.customer
    return db.select(c.c_custkey).from_(c).where(cmp.exists(db.select(o.o_orderkey).from_(o).where(cmp.eq(o.o_custkey, c.c_custkey), cmp.gt(o.o_totalprice, 200000.0)).limit(1)))


@query("agg_having_subquery", f"SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING o_custkey IN ({FEW}) OR count(o_orderkey) > 15")
def _(db):
    o = db.orders
    return db.select(o.o_custkey, agg.count(o.o_orderkey).alias("n")).from_(o).group_by(o.o_custkey).having(cmp.or_(cmp.in_subquery(o.o_custkey, _few(db)), cmp.gt(agg.count(o.o_orderkey), 15)))


@query("agg_having_exists_empty", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING EXISTS (SELECT 1 FROM customer WHERE c_custkey < 0)")
def _(db):
    o, c = db.orders, db.customer
    return db.select(o.o_custkey, agg.count(o.o_orderkey).alias("n")).from_(o).group_by(o.o_custkey).having(cmp.exists(db.select(c.c_custkey).from_(c).where(cmp.lt(c.c_custkey, 0))))


@query("joi_on_subquery", f"SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_custkey IN ({FEW})")
def _(db):
    o, c = db.orders, db.customer
    return db.select(o.o_orderkey, c.c_custkey).from_(o).join(c, cmp.and_(cmp.eq(o.o_custkey, c.c_custkey), cmp.in_subquery(o.o_custkey, _few(db))))


@query("dml_delete_in_subquery", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN ({FEW})")
def _(db):
    return dml.delete(db.orders).where(cmp.in_subquery(db.orders.o_custkey, _few(db))).write().result.select("o_orderkey", "o_custkey")


@query("dml_update_not_in_subquery", f"SELECT o_orderkey, CASE WHEN o_custkey NOT IN ({FEW}) THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(db):
    return dml.update(db.orders).set({"o_orderstatus": "X"}).where(cmp.not_in_subquery(db.orders.o_custkey, _few(db))).write().result.select("o_orderkey", "o_orderstatus")


@query("rel_where_subquery", f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN ({FEW}) GROUP BY c_custkey")
def _(db):
    c = db.customer
    found = Query(c).where(cmp.in_subquery(c.c_custkey, _few(db))).with_(many("orders", c, db.orders)).df()
    return found.select("c_custkey", F.size("orders").cast("long").alias("n"))
