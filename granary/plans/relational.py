"""Registered queries over the relational tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import scalars, types
from granary.operators import constraints, dml, joins, statistics
from granary.plans import builder
from granary.plans.builder import QueryOptions, order_of
from granary.plans.predicates import And, Compare, Not, Or, column_of
from granary.plans.registry import register, table


class Tables:
    """Tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self._folder, name)

    def sql(self, text: str, *args, **views: DataFrame) -> DataFrame:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=list(args)) if args else self.spark.sql(text)


def q(name: str, sql: str, make: Callable[[Tables], DataFrame]) -> None:
    register(name, sql)(lambda spark, folder: make(Tables(spark, folder)))


#: Amounts as decimals, so that sums don't depend on the order of rows.
_M = "CAST(round({0}, 4) AS DECIMAL(18, 4))".format

# Scans.

q("scan_full", "SELECT * FROM customer", lambda t: t.customer)
q("scan_reverse", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC", lambda t: t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_orderkey")))
q("scan_key_range", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 500", lambda t: t.orders.where(F.col("o_orderkey").between(100, 500)).select("o_orderkey", "o_orderstatus"))
q("index_scan_eq", "SELECT * FROM orders WHERE o_custkey = 42", lambda t: t.orders.where("o_custkey = 42"))
q("index_scan_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 1000 AND l_orderkey < 2000", lambda t: t.lineitem.where("l_orderkey >= 1000 and l_orderkey < 2000").select("l_orderkey", "l_linenumber", "l_quantity"))
q("covering_projection", "SELECT p_brand, p_retailprice, p_name FROM part WHERE p_brand = 'Brand#11' ORDER BY p_brand, p_retailprice, p_name", lambda t: t.part.where("p_brand = 'Brand#11'").select("p_brand", "p_retailprice", "p_name").orderBy("p_brand", "p_retailprice", "p_name"))
q("index_lookup", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", lambda t: t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
q("point_get", "SELECT * FROM customer WHERE c_custkey = 7", lambda t: t.customer.where("c_custkey = 7"))
q("batch_get", "SELECT * FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21)", lambda t: t.customer.where(F.col("c_custkey").isin(3, 5, 8, 13, 21)))
q("select_const", "SELECT 1 AS one, 'x' AS letter", lambda t: t.sql("SELECT 1 AS one, 'x' AS letter"))

# Projections.

q("project_columns", "SELECT c_name, c_acctbal FROM customer", lambda t: t.customer.select("c_name", "c_acctbal"))
q("project_star", "SELECT * FROM supplier", lambda t: t.supplier.select("*"))
q("project_alias", "SELECT c_custkey AS id, c_name AS label FROM customer", lambda t: t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")))
q("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, upper(l_returnflag) || '-' || l_linestatus AS code FROM lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.concat(F.upper("l_returnflag"), F.lit("-"), F.col("l_linestatus")).alias("code")))

# Filters.

for _name, _op, _value in (("eq", "=", 5), ("ne", "!=", 5), ("gt", ">", 40), ("ge", ">=", 40), ("lt", "<", 10), ("le", "<=", 10)):
    q(f"filter_{_name}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} {_value}", lambda t, op=_op, v=_value: t.part.where(column_of(Compare("p_size", op, v))).select("p_partkey", "p_size"))
q("filter_in", "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", lambda t: t.customer.where(column_of(Compare("c_mktsegment", "in", ["BUILDING", "MACHINERY"]))))
q("filter_between", "SELECT * FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000", lambda t: t.customer.where(column_of(Compare("c_acctbal", "between", (1000, 2000)))))
q("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%'", lambda t: t.part.where(column_of(Compare("p_type", "like", "%A%"))).select("p_partkey", "p_type"))
q("filter_and", "SELECT * FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", lambda t: t.customer.where(column_of(And([Compare("c_acctbal", ">", 5000), Compare("c_mktsegment", "=", "BUILDING")]))))
q("filter_or", "SELECT * FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000", lambda t: t.customer.where(column_of(Or([Compare("c_acctbal", "<", 0), Compare("c_acctbal", ">", 9000)]))))
q("filter_not", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer WHERE NOT (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY')", lambda t: t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")).where(column_of(Not(Compare("segment", "=", "MACHINERY")))))
q(
    "filter_nested",
    "SELECT * FROM customer WHERE (c_acctbal > 8000 OR c_mktsegment = 'BUILDING') AND NOT (c_nationkey IN (1, 2, 3) OR c_acctbal < 0)",
    lambda t: t.customer.where(column_of(And([Or([Compare("c_acctbal", ">", 8000), Compare("c_mktsegment", "=", "BUILDING")]), Not(Or([Compare("c_nationkey", "in", [1, 2, 3]), Compare("c_acctbal", "<", 0)]))]))),
)
_SEGMENT = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer"


def _segments(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))


q("filter_is_null", f"SELECT * FROM ({_SEGMENT}) WHERE segment IS NULL", lambda t: _segments(t).where(column_of(Compare("segment", "is null"))))
q("filter_is_not_null", f"SELECT * FROM ({_SEGMENT}) WHERE segment IS NOT NULL", lambda t: _segments(t).where(column_of(Compare("segment", "is not null"))))
q("filter_eq_null", f"SELECT * FROM ({_SEGMENT}) WHERE segment = NULL", lambda t: _segments(t).where(column_of(Compare("segment", "=", None))))
q("filter_map", "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'", lambda t: t.orders.where(column_of({"o_orderstatus": "O", "o_orderpriority": "1-URGENT"})))
q("filter_ops_map", "SELECT * FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 900.5", lambda t: t.part.where(column_of({"p_size": {"$gte": 10, "$lt": 20}, "p_retailprice": {"$gt": 900.5}})))
q("param_positional", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 99.99", lambda t: t.sql("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", 3, 99.99, customer=t.customer))
q("filter_bool", "SELECT c_custkey, c_acctbal > 0 AS active FROM customer WHERE c_acctbal > 0", lambda t: t.customer.select("c_custkey", (F.col("c_acctbal") > 0).alias("active")).where(F.col("active")))
q("filter_scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(CAST(p_retailprice AS DECIMAL(18, 4))) FROM part)", lambda t: t.sql("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(CAST(p_retailprice AS DECIMAL(18, 4))) FROM part)", part=t.part))
q("filter_float_literal", "SELECT p_partkey, p_size FROM part WHERE p_size > 30.5", lambda t: t.part.where(column_of(Compare("p_size", ">", 30.5))).select("p_partkey", "p_size"))

# Joins.

q("join_inner", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey", lambda t: joins.equi(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_name", "o_orderkey"))
_RICH = "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000"
q("join_left", f"SELECT n_name, s_suppkey FROM nation LEFT JOIN ({_RICH}) ON n_nationkey = s_nationkey", lambda t: joins.equi(t.nation, t.supplier.where("s_acctbal > 5000"), [("n_nationkey", "s_nationkey")], "left").select("n_name", "s_suppkey"))
q("join_right", f"SELECT n_name, s_suppkey FROM ({_RICH}) RIGHT JOIN nation ON n_nationkey = s_nationkey", lambda t: joins.equi(t.supplier.where("s_acctbal > 5000"), t.nation, [("s_nationkey", "n_nationkey")], "right").select("n_name", "s_suppkey"))
q("join_full", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey", lambda t: joins.equi(t.customer.where("c_acctbal > 0"), t.orders.where("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")], "full").select("c_custkey", "o_orderkey"))
q("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", lambda t: joins.equi(t.customer, t.orders.where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "left_semi").select("c_custkey"))
q("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", lambda t: joins.equi(t.customer, t.orders.where("o_totalprice > 200000"), [("c_custkey", "o_custkey")], "left_anti").select("c_custkey"))
q(
    "join_null_keys_whole",
    "SELECT o_orderkey, c_custkey FROM (SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders) JOIN (SELECT c_custkey, nullif(c_custkey, 7) AS k2 FROM customer) ON k = k2",
    lambda t: t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("k")).join(t.customer.select("c_custkey", F.nullif("c_custkey", F.lit(7)).alias("k2")), F.col("k") == F.col("k2")).select("o_orderkey", "c_custkey"),
)
q("join_broadcast", "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", lambda t: joins.equi(t.supplier, t.nation, [("s_nationkey", "n_nationkey")], strategy="broadcast").select("s_name", "n_name"))
q("join_merge", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45", lambda t: joins.equi(t.lineitem.where("l_quantity > 45"), t.orders, [("l_orderkey", "o_orderkey")], strategy="merge").select("l_orderkey", "l_linenumber", "o_orderdate"))
q("join_hash", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7", lambda t: joins.equi(t.lineitem, t.part.where("p_size = 7"), [("l_partkey", "p_partkey")], strategy="shuffle_hash").select("l_orderkey", "l_linenumber", "p_brand"))
q(
    "join_multiway",
    f"SELECT r_name, n_name, count(*) AS n_orders, sum({_M('o_totalprice')}) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name",
    lambda t: joins.chain([t.region, t.nation, t.customer, t.orders], [[("r_regionkey", "n_regionkey")], [("n_nationkey", "c_nationkey")], [("c_custkey", "o_custkey")]]).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_orders"), scalars.amount_sum(F.col("o_totalprice")).alias("total")),
)
q("join_comma", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 3000", lambda t: t.sql("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 3000", supplier=t.supplier, nation=t.nation))
q(
    "left_join_groupby",
    f"SELECT n_name, count(s_suppkey) AS n_suppliers, sum({_M('s_acctbal')}) AS balance FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey GROUP BY n_name",
    lambda t: joins.equi(t.nation, t.supplier.where("s_acctbal > 5000"), [("n_nationkey", "s_nationkey")], "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"), scalars.amount_sum(F.col("s_acctbal")).alias("balance")),
)
q(
    "join_filter_topk",
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (1, 5, 9) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    lambda t: joins.equi(t.orders, t.customer.where(F.col("c_nationkey").isin(1, 5, 9)), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20),
)
q("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey", lambda t: joins.theta(t.nation.alias("a"), t.nation.alias("b"), "a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey").select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high")))
q(
    "join_range",
    "SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_retailprice >= s_acctbal AND p_retailprice < s_acctbal + 100 GROUP BY s_suppkey",
    lambda t: joins.band(t.supplier, t.part, "s_acctbal", "p_retailprice", 100.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n")),
)

# Aggregates.

q("agg_count_star", "SELECT count(*) AS n FROM lineitem", lambda t: t.lineitem.agg(F.count(F.lit(1)).alias("n")))
q("agg_count_filter", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'", lambda t: t.lineitem.where("l_returnflag = 'R'").agg(F.count(F.lit(1)).alias("n")))
q("agg_count_col", f"SELECT count(segment) AS n, count(DISTINCT segment) AS n_distinct FROM ({_SEGMENT})", lambda t: _segments(t).agg(F.count("segment").alias("n"), F.count_distinct("segment").alias("n_distinct")))
q("agg_sum", f"SELECT sum({_M('o_totalprice')}) AS total FROM orders", lambda t: t.orders.agg(scalars.amount_sum(F.col("o_totalprice")).alias("total")))
q("agg_sum_empty", f"SELECT sum({_M('o_totalprice')}) AS total, count(*) AS n FROM orders WHERE o_orderkey < 0", lambda t: t.orders.where("o_orderkey < 0").agg(scalars.amount_sum(F.col("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n")))
q("agg_avg", "SELECT round(avg(l_quantity), 6) AS mean FROM lineitem", lambda t: t.lineitem.agg(F.round(F.avg("l_quantity"), 6).alias("mean")))
q("agg_max", "SELECT max(o_totalprice) AS high, max(o_orderpriority) AS last, max(o_orderkey) AS key FROM orders", lambda t: t.orders.agg(F.max("o_totalprice").alias("high"), F.max("o_orderpriority").alias("last"), F.max("o_orderkey").alias("key")))
q("agg_min", "SELECT min(o_totalprice) AS low, min(o_orderpriority) AS first, min(o_orderkey) AS key FROM orders", lambda t: t.orders.agg(F.min("o_totalprice").alias("low"), F.min("o_orderpriority").alias("first"), F.min("o_orderkey").alias("key")))
q("group_by_one", f"SELECT o_orderstatus, count(*) AS n, sum({_M('o_totalprice')}) AS total FROM orders GROUP BY o_orderstatus", lambda t: t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), scalars.amount_sum(F.col("o_totalprice")).alias("total")))
q(
    "group_by_multi",
    f"SELECT l_returnflag, l_linestatus, sum({_M('l_quantity')}) AS qty, sum({_M('l_extendedprice * (1 - l_discount)')}) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    lambda t: t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(scalars.amount_sum(F.col("l_quantity")).alias("qty"), scalars.amount_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")),
)
q("group_by_null", f"SELECT segment, count(*) AS n FROM ({_SEGMENT}) GROUP BY segment", lambda t: _segments(t).groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
q("group_by_date", f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum({_M('value')}) AS total FROM events GROUP BY ALL", lambda t: t.events.groupBy(scalars.date_of(F.col("ts")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), scalars.amount_sum(F.col("value")).alias("total")))
q("group_by_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", lambda t: builder.Query(t.orders).group_by("o_custkey").agg(F.count(F.lit(1)).alias("n")).having("n > 12").dataframe())
q("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", lambda t: t.customer.select("c_nationkey", "c_mktsegment").distinct())
q("grouping_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda t: t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
q("grouping_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", lambda t: t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")))
q("grouping_sets", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())", lambda t: t.sql("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())", customer=t.customer))
q("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, max(l_tax) FILTER (WHERE l_linestatus = 'O') AS tax FROM lineitem GROUP BY l_returnflag", lambda t: t.sql("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS many, max(l_tax) FILTER (WHERE l_linestatus = 'O') AS tax FROM lineitem GROUP BY l_returnflag", lineitem=t.lineitem))
q("agg_distinct_by_group", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY o_orderpriority", lambda t: t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("n")))
q("default_aggregate_name", 'SELECT count(*) AS "count(*)" FROM nation', lambda t: builder.Query(t.nation).agg(F.count(F.lit(1)).alias("count(*)")).dataframe())

# Sort, limit, sets, windows.

q("sort_asc", "SELECT c_custkey, c_name FROM customer ORDER BY c_name", lambda t: builder.run(t.customer, QueryOptions(["c_custkey", "c_name"], order=["c_name"])))
q("sort_desc_whole", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey", lambda t: builder.run(t.customer, QueryOptions(["c_custkey", "c_acctbal"], order=["c_acctbal desc", "c_custkey"])))
q("sort_multi_whole", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey", lambda t: builder.run(t.customer, QueryOptions(["c_mktsegment", "c_acctbal", "c_custkey"], order=["c_mktsegment", "c_acctbal desc", "c_custkey"])))
q("sort_nulls_whole", f"SELECT * FROM ({_SEGMENT}) ORDER BY segment DESC NULLS FIRST, c_custkey", lambda t: _segments(t).orderBy(order_of("segment desc"), order_of("c_custkey")))
q("sort_nulls_last_whole", f"SELECT * FROM ({_SEGMENT}) ORDER BY segment ASC NULLS LAST, c_custkey", lambda t: builder.run(_segments(t), QueryOptions(order=["segment", "c_custkey"])))
q("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10", lambda t: builder.run(t.orders, QueryOptions(["o_orderkey"], order=["o_orderkey"], limit=10)))
q("limit_offset", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 10 OFFSET 5", lambda t: builder.run(t.orders, QueryOptions(["o_orderkey"], "o_orderstatus = 'F'", ["o_orderkey"], 10, 5)))
q("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", lambda t: builder.run(t.orders, QueryOptions(["o_orderkey", "o_totalprice"], order=["o_totalprice desc", "o_orderkey"], limit=25)))
q("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", lambda t: t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct())
q("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", lambda t: t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(t.orders.where("o_orderstatus = 'F'").select("o_custkey")))
q("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", lambda t: t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey")))
q(
    "window_rank",
    "SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    lambda t: t.orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint")).where("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rn"),
)

q(
    "window_ranks",
    "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS place, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dense, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS quarter FROM customer",
    lambda t: t.customer.select("c_custkey", *(f.over(Window.partitionBy("c_nationkey").orderBy(o)).cast("bigint").alias(n) for f, o, n in ((F.rank(), "c_mktsegment", "place"), (F.dense_rank(), "c_mktsegment", "dense"), (F.ntile(4), "c_custkey", "quarter")))),
)


def _by_user():
    return Window.partitionBy("user_id").orderBy("event_id")


q(
    "window_lag",
    "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_id, 2, -1) OVER (PARTITION BY user_id ORDER BY event_id) AS later, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events",
    lambda t: t.events.select("event_id", F.lag("event_type").over(_by_user()).alias("before"), F.lead("event_id", 2, -1).over(_by_user()).alias("later"), F.first("event_id").over(_by_user()).alias("first")),
)
q(
    "window_frame",
    "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near, count(*) OVER (PARTITION BY user_id) AS every FROM events",
    lambda t: t.events.select("event_id", F.sum("event_id").over(_by_user().rowsBetween(-2, 0)).alias("near"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("every")),
)

# Scalars and casts.

q("fn_date", "SELECT event_id, CAST(ts AS DATE) AS day FROM events", lambda t: t.events.select("event_id", scalars.date_of(F.col("ts")).alias("day")))
q("expr_arith", "SELECT s_suppkey, round(s_acctbal * 1.1, 2) AS raised, round(s_acctbal - 100, 2) AS less FROM supplier", lambda t: t.supplier.select("s_suppkey", scalars.round_half_away(F.col("s_acctbal") * 1.1, 2).alias("raised"), scalars.round_half_away(F.col("s_acctbal") - 100, 2).alias("less")))
q("cast_num_str", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS text FROM orders", lambda t: t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("text")))
q("cast_str_num", "SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS number, TRY_CAST(p_type AS DOUBLE) AS none FROM part", lambda t: t.part.select("p_partkey", types.try_convert(F.substring("p_brand", 7, 100), "integer").alias("number"), types.try_convert(F.col("p_type"), "double").alias("none")))
q("cast_bool", "SELECT c_custkey, CAST(CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END = 'yes' AS BOOLEAN) AS active FROM customer", lambda t: t.customer.select("c_custkey", scalars.boolean_of(F.when(F.col("c_acctbal") > 0, "yes").otherwise("no")).alias("active")))
q("cast_ts", "SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS at FROM events", lambda t: t.events.select("event_id", types.convert(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "timestamp").alias("at")))
q("cast_uuid", "SELECT c_custkey, CAST(CAST(md5(c_name) AS UUID) AS VARCHAR) AS id FROM customer", lambda t: t.customer.select("c_custkey", types.convert(F.md5("c_name"), "uuid").alias("id")))
q("cast_binary", "SELECT c_custkey, hex(encode(c_name)) AS bytes, c_name AS back FROM customer", lambda t: t.customer.withColumn("b", types.convert(F.col("c_name"), "binary")).select("c_custkey", F.hex("b").alias("bytes"), types.convert(F.col("b"), "text").alias("back")))
q("cast_json", "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events", lambda t: t.events.select("event_id", types.convert(F.col("props"), "jsonb").alias("props")))
q("cast_date_str", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS back FROM orders", lambda t: t.orders.select("o_orderkey", types.convert(F.to_date("o_orderdate"), "text").alias("day"), types.convert(F.date_format("o_orderdate", "yyyy-MM-dd"), "date").alias("back")))
q("fn_now", "SELECT now() > TIMESTAMP '2020-01-01' AS later, current_date > DATE '2020-01-01' AS day_later", lambda t: t.sql("SELECT now() > timestamp '2020-01-01' AS later, current_date > date '2020-01-01' AS day_later"))
q("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", lambda t: t.events.select("event_id", scalars.json_value(F.col("props"), "$.k").cast("bigint").alias("k")))
q("json_filter", "SELECT count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50", lambda t: t.events.where(scalars.json_value(F.col("props"), "$.k").cast("bigint") > 50).agg(F.count(F.lit(1)).alias("n")))
q("type_valid", "SELECT p_partkey, TRY_CAST(p_size AS SMALLINT) IS NOT NULL AS ok, TRY_CAST(p_name AS INTEGER) IS NOT NULL AS number FROM part", lambda t: t.part.select("p_partkey", types.is_valid(F.col("p_size"), "smallint").alias("ok"), types.is_valid(F.col("p_name"), "integer").alias("number")))

# DML, as rows afterwards.

_BALANCES = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
q("insert_rows", f"{_BALANCES} UNION ALL SELECT 900001, 'New', 3, NULL UNION ALL SELECT 900002, 'Newer', NULL, 1.5", lambda t: dml.insert(t.supplier, t.spark.createDataFrame([(900001, "New", 3, None), (900002, "Newer", None, 1.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")))
q("insert_select", f"{_BALANCES} UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 9500", lambda t: dml.insert(t.supplier, t.customer.where("c_acctbal > 9500").select((F.col("c_custkey") + 1000000).alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))))
_DAY = f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum({_M('value')}) AS total FROM events WHERE {{0}} GROUP BY ALL"


def _daily(t: Tables, where: str) -> DataFrame:
    return t.events.where(where).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), scalars.amount_sum(F.col("value")).alias("total"))


q(
    "upsert",
    f"WITH old AS ({_DAY.format('ts < TIMESTAMP ' + chr(39) + '2024-01-20' + chr(39))}), new AS ({_DAY.format('ts >= TIMESTAMP ' + chr(39) + '2024-01-10' + chr(39))}) SELECT coalesce(old.day, new.day) AS day, coalesce(old.event_type, new.event_type) AS event_type, CASE WHEN old.day IS NOT NULL AND new.day IS NOT NULL THEN old.n + new.n ELSE coalesce(old.n, new.n) END AS n, coalesce(new.total, old.total) AS total FROM old FULL JOIN new ON old.day = new.day AND old.event_type = new.event_type",
    lambda t: dml.upsert(_daily(t, "ts < timestamp_ntz '2024-01-20'"), _daily(t, "ts >= timestamp_ntz '2024-01-10'"), ["day", "event_type"], {"n": F.col("old.n") + F.col("new.n"), "total": F.col("new.total")}),
)
q("update_by_id", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey = 5 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier", lambda t: dml.update(t.supplier, {"s_acctbal": 0.0}, {"s_suppkey": 5}))
q("update_where", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 1000 OR s_nationkey = 3 THEN s_acctbal * 1.5 + 10 ELSE s_acctbal END AS s_acctbal FROM supplier", lambda t: dml.update(t.supplier, {"s_acctbal": F.col("s_acctbal") * 1.5 + 10}, "s_acctbal < 1000 or s_nationkey = 3"))
q("update_null_condition", "SELECT c_custkey, CASE WHEN coalesce(segment <> 'MACHINERY', false) THEN 'OTHER' ELSE segment END AS segment FROM (" + _SEGMENT + ")", lambda t: dml.update(_segments(t), {"segment": "OTHER"}, "segment <> 'MACHINERY'"))
q("update_returning", "SELECT s_suppkey, s_acctbal - 100 AS s_acctbal FROM supplier WHERE s_acctbal > 9000", lambda t: dml.update_returning(t.supplier, {"s_acctbal": F.col("s_acctbal") - 100}, "s_acctbal > 9000", ["s_suppkey", "s_acctbal"]))
q("delete_where", f"SELECT * FROM ({_SEGMENT}) WHERE NOT coalesce(segment > 'F', false)", lambda t: dml.delete(_segments(t), "segment > 'F'"))
q("delete_returning", "SELECT p_partkey, p_name FROM part WHERE p_size > 45", lambda t: dml.delete_returning(t.part, "p_size > 45", ["p_partkey", "p_name"]))
q("alter_add_col", "SELECT *, 'none' AS note FROM nation", lambda t: t.nation.withColumn("note", F.lit("none")))
q("alter_drop_col", "SELECT n_nationkey, n_name FROM nation", lambda t: t.nation.drop("n_regionkey"))
q("alter_type", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS DECIMAL(12, 2)) AS p_retailprice FROM part", lambda t: t.part.select("p_partkey", types.convert(F.col("p_size"), "text").alias("p_size"), types.convert(F.col("p_retailprice"), "numeric(12,2)").alias("p_retailprice")))
q("view_select", "SELECT c_nationkey, count(*) AS n FROM (SELECT * FROM customer WHERE c_acctbal > 5000) GROUP BY c_nationkey", lambda t: t.sql("SELECT c_nationkey, count(*) AS n FROM rich_customers GROUP BY c_nationkey", rich_customers=t.customer.where("c_acctbal > 5000")))
q("check_unique", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1", lambda t: constraints.repeated_keys(t.customer, ["c_nationkey", "c_mktsegment"]))
q("check_fk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", lambda t: constraints.orphans(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], t.customer.where("c_acctbal > 0"), ["c_custkey"]))
q("check_not_null", f"SELECT * FROM ({_SEGMENT}) WHERE segment IS NULL", lambda t: constraints.null_rows(_segments(t), ["segment"]))
q("check_expression", f"SELECT * FROM ({_SEGMENT}) WHERE NOT coalesce(segment <> 'MACHINERY', true)", lambda t: constraints.failing_rows(_segments(t), "segment <> 'MACHINERY'"))
q(
    "builder_select",
    "SELECT c_mktsegment, count(*) AS n, max(c_acctbal) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 2) AND c_acctbal IS NOT NULL GROUP BY c_mktsegment HAVING count(*) > 1 ORDER BY n DESC, c_mktsegment LIMIT 3",
    lambda t: builder.Query(t.customer).join(t.nation, "c_nationkey = n_nationkey").where_in("n_regionkey", [0, 2]).where_not_null("c_acctbal").group_by("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("high")).having("n > 1").order_by("n desc", "c_mktsegment").limit(3).dataframe(),
)

# Statistics.

q("stats_rowcount", "SELECT count(*) AS n_live_tup FROM lineitem", lambda t: statistics.row_count(t.lineitem))
q("stats_null_frac", f"SELECT 'segment' AS attname, round(avg(CASE WHEN segment IS NULL THEN 1.0 ELSE 0.0 END), 8) AS null_frac FROM ({_SEGMENT})", lambda t: statistics.column_stats(_segments(t), ["segment"]).select("attname", F.round("null_frac", 8).alias("null_frac")))
q("stats_avg_width", "SELECT 'c_name' AS attname, round(avg(octet_length(encode(c_name))), 6) AS avg_width FROM customer", lambda t: statistics.column_stats(t.customer, ["c_name"]).select("attname", F.round("avg_width", 6).alias("avg_width")))
q("stats_ndistinct", "SELECT 'o_custkey' AS attname, count(DISTINCT o_custkey) AS n_distinct FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders", lambda t: statistics.column_stats(t.orders, ["o_custkey", "o_orderpriority"]).select("attname", "n_distinct"))
q("stats_mcv", "SELECT p_type AS value, round(count(*) / (SELECT count(*) FROM part), 8) AS freq FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 3", lambda t: statistics.most_common(t.part, "p_type").select("value", F.round("freq", 8).alias("freq")))
q(
    "stats_histogram",
    "WITH s AS (SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS i, count(*) OVER () AS n FROM customer) SELECT min(value) AS low, min(CASE WHEN i = n // 2 THEN value END) AS middle, max(value) AS high FROM s",
    lambda t: statistics.histogram(t.customer, "c_name"),
)
