"""Every registered query that has SQL, against DuckDB on two sizes of the tables."""

import math
import os

import duckdb
import pytest

from granary.plans import managed, registry, relational, system  # noqa: F401
from granary.streaming import rollup  # noqa: F401

SIZES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not all(map(os.path.isdir, SIZES)), reason="test tables are missing")


@pytest.fixture(scope="module", params=SIZES, ids=lambda s: s.rpartition("/")[2])
def size(request):
    return request.param


@pytest.fixture(scope="module")
def duck(size):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{size}/{t}.parquet'")
    return c


def plain(v):
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) if not isinstance(v, float) else repr(v)


def sorted_rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches(spark, duck, size, name):
    found = registry.queries()[name](spark, size)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted_rows(found.columns, [tuple(r) for r in found.collect()]) == sorted_rows(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
