"""Registered queries that go through the engine: managed tables, DDL, DML, views and transactions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from granary.catalog import ROWID
from granary.client import Engine
from granary.plans.registry import register, table
from granary.session import shared_folder


def managed(name: str, sql: str, tables: Sequence[str]) -> Callable[[Callable[[Engine], DataFrame]], None]:
    """A query over an engine of its own that holds copies of these tables."""

    def add(steps: Callable[[Engine], DataFrame]) -> None:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            engine = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex[:12]}")
            for t in tables:
                engine.insert(t, table(spark, folder, t))
            return steps(engine)

        register(name, sql)(run)

    return add


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_RAISED = "CASE WHEN s_acctbal < 1000 OR s_nationkey = 3 THEN s_acctbal * 1.5 + 10 ELSE s_acctbal END"


@managed("managed_insert", f"{_SUPPLIER} UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 9500", ("supplier", "customer"))
def _insert(engine: Engine) -> DataFrame:
    engine.query("INSERT INTO supplier SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 9500")
    return engine.query(_SUPPLIER)


@managed("managed_update", f"SELECT s_suppkey, {_RAISED} AS s_acctbal FROM supplier", ("supplier",))
def _update(engine: Engine) -> DataFrame:
    engine.query("UPDATE supplier SET s_acctbal = s_acctbal * 1.5 + 10 WHERE s_acctbal < 1000 OR s_nationkey = 3")
    return engine.query("SELECT s_suppkey, s_acctbal FROM supplier")


@managed("managed_update_returning", "SELECT s_suppkey, s_acctbal - 100 AS s_acctbal FROM supplier WHERE s_acctbal > 9000", ("supplier",))
def _returning(engine: Engine) -> DataFrame:
    return engine.query("UPDATE supplier SET s_acctbal = s_acctbal - $1 WHERE s_acctbal > $2 RETURNING s_suppkey, s_acctbal", [100, 9000])


@managed("managed_delete", f"{_SUPPLIER} WHERE NOT (s_acctbal < 0 OR s_nationkey IN (1, 2))", ("supplier",))
def _delete(engine: Engine) -> DataFrame:
    engine.query("DELETE FROM supplier WHERE s_acctbal < 0 OR s_nationkey IN (1, 2)")
    return engine.query(_SUPPLIER)


@managed(
    "managed_upsert",
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN b.n WHEN b.k IS NULL THEN a.n ELSE a.n + b.n END AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k",
    ("customer", "supplier"),
)
def _upsert(engine: Engine) -> DataFrame:
    engine.query("CREATE TABLE held (k bigint primary key, n bigint not null)")
    engine.query("INSERT INTO held SELECT c_nationkey, count(*) FROM customer WHERE c_nationkey < 15 GROUP BY c_nationkey")
    engine.query("INSERT INTO held (k, n) SELECT s_nationkey, count(*) FROM supplier GROUP BY s_nationkey ON CONFLICT (k) DO UPDATE SET n = held.n + excluded.n")
    return engine.query("SELECT k, n FROM held")


@managed("managed_alter", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'none' AS note FROM nation", ("nation",))
def _alter(engine: Engine) -> DataFrame:
    engine.query("ALTER TABLE nation ADD COLUMN note text DEFAULT 'none', DROP COLUMN n_name")
    engine.query("ALTER TABLE nation ALTER COLUMN n_regionkey TYPE text")
    return engine.query("SELECT * FROM nation")


@managed("managed_view", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey", ("customer",))
def _view(engine: Engine) -> DataFrame:
    engine.query("CREATE VIEW rich AS SELECT * FROM customer WHERE c_acctbal > 0")
    engine.query("CREATE OR REPLACE VIEW rich AS SELECT * FROM customer WHERE c_acctbal > 5000")
    return engine.query("SELECT c_nationkey, count(*) AS n FROM rich GROUP BY c_nationkey")


@managed("managed_transaction", f"SELECT s_suppkey, {_RAISED} AS s_acctbal FROM supplier WHERE s_nationkey <> 7", ("supplier", "nation"))
def _transaction(engine: Engine) -> DataFrame:
    engine.query("BEGIN")
    engine.query("UPDATE supplier SET s_acctbal = s_acctbal * 1.5 + 10 WHERE s_acctbal < 1000 OR s_nationkey = 3")
    engine.query("DELETE FROM supplier WHERE s_nationkey = 7")
    engine.query("DELETE FROM nation")
    engine.query("COMMIT")
    engine.query("BEGIN")
    engine.query("DELETE FROM supplier")
    engine.query("ROLLBACK")
    assert engine.count("nation") == 0
    return engine.query("SELECT s_suppkey, s_acctbal FROM supplier")


@managed("managed_snapshot", _SUPPLIER, ("supplier",))
def _snapshot(engine: Engine) -> DataFrame:
    data = engine.catalog.data(engine.tenant, "supplier")
    base = data.version()
    engine.query("TRUNCATE TABLE supplier")
    return data.read(base).drop(ROWID)


@managed("managed_prepared", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 99.99", ("customer",))
def _prepared(engine: Engine) -> DataFrame:
    engine.query("PREPARE of_nation AS SELECT c_custkey, c_name FROM customer WHERE c_nationkey = $1 AND c_acctbal > $2")
    return engine.query("EXECUTE of_nation(3, 99.99)")


@managed("managed_serial", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_ids, CAST(1 AS BIGINT) AS low, CAST(count(*) AS BIGINT) AS high FROM orders", ("orders",))
def _serial(engine: Engine) -> DataFrame:
    engine.query("CREATE TABLE numbered (id serial primary key, o_orderkey bigint)")
    engine.insert("numbered", engine.query("SELECT o_orderkey FROM orders").repartition(7))
    return engine.query("SELECT count(*) AS n, count(DISTINCT id) AS n_ids, CAST(min(id) AS BIGINT) AS low, CAST(max(id) AS BIGINT) AS high FROM numbered")


@managed("managed_analyze", "SELECT 's_name' AS attname, 0.0::DOUBLE AS null_frac, count(DISTINCT s_name) AS n_distinct FROM supplier UNION ALL SELECT 's_nationkey', 0.0, count(DISTINCT s_nationkey) FROM supplier", ("supplier",))
def _analyze(engine: Engine) -> DataFrame:
    engine.query("ANALYZE supplier")
    engine.query("DELETE FROM supplier")  # what was stored stays until the next time
    return engine.query("SELECT attname, null_frac, n_distinct FROM pg_stats WHERE attname IN ('s_name', 's_nationkey')")
