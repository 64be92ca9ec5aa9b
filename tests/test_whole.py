"""Registered queries over whole tables: the rows come in the order of their SQL, none missing."""

import os

import duckdb
import pytest

from granary.plans import registry, relational  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.mark.parametrize("name", ["sort_desc_whole", "sort_multi_whole", "sort_nulls_whole", "sort_nulls_last_whole"])
def test_sorts_give_every_row_in_order(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    got = [tuple(r) for r in registry.queries()[name](spark, SF).collect()]
    assert got == c.execute(registry.oracle_sql()[name]).fetchall()
    assert len(got) == c.execute("SELECT count(*) FROM customer").fetchone()[0]


def test_null_keys_join_all_other_orders(spark):
    c = duckdb.connect()
    want = c.execute(f"SELECT count(*) FROM '{SF}/orders.parquet' JOIN '{SF}/customer.parquet' ON o_custkey = c_custkey WHERE o_custkey <> 7").fetchone()[0]
    assert registry.queries()["join_null_keys_whole"](spark, SF).count() == want > 99
