"""Registered queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import amount_sum

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


@register(
    "revenue_by_nation",
    """
    SELECT n_name, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4))) AS DECIMAL(28, 4)) AS revenue, count(*) AS n_lines
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'
    GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10
    """,
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1996-01-01'")
    revenue = amount_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(revenue.alias("revenue"), F.count(F.lit(1)).alias("n_lines"))
        .orderBy(F.desc("revenue"), "n_name")
        .limit(10)
    )
