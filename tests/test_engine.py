"""The embedded engine: DDL, DML, transactions, views, parameters, system relations."""

import pytest

from granary.catalog import Catalog, oid
from granary.client import Engine, SqlError, clause, split_top
from granary.functions import types
from granary.sources.tables import ConflictError


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.query("CREATE TABLE users (id serial primary key, name varchar(10) not null, email text unique, age int default 18, active bool, check (age >= 0))")
    e.query("INSERT INTO users (name, email, age, active) VALUES ('Alice', 'a@x', 30, true), ('Bob', 'b@x', 25, true), ('Charlie', 'c@x', 35, false)")
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_select_filters_sorts_and_cuts(engine):
    got = engine.query("SELECT name FROM users WHERE active = true AND age > $1 ORDER BY age DESC LIMIT 1", [20])
    assert rows(got) == [("Alice",)]
    assert rows(engine.query("SELECT count(*) AS n FROM users WHERE age BETWEEN 20 AND 31")) == [(2,)]
    assert len(engine.query("SELECT * FROM users").columns) == 5
    assert rows(engine.query("SELECT name FROM users WHERE name = $1 OR email = $2", ["Bob", "$1"])) == [("Bob",)]


def test_defaults_serials_and_constraints(engine):
    engine.query("INSERT INTO users (name, email) VALUES ('Dan', 'd@x')")
    assert rows(engine.query("SELECT age, id FROM users WHERE name = 'Dan'"))[0][0] == 18
    assert engine.query("SELECT count(DISTINCT id) FROM users").first()[0] == 4
    for bad in ("('Eve', 'a@x', 1)", "(NULL, 'e@x', 1)", "('Eve', 'e@x', -1)"):
        with pytest.raises(ValueError):
            engine.query(f"INSERT INTO users (name, email, age) VALUES {bad}")
    with pytest.raises(Exception, match="too long"):
        engine.query("INSERT INTO users (name) VALUES ('abcdefghijkl')")
    assert engine.count("users") == 4


def test_update_delete_returning(engine):
    assert rows(engine.query("UPDATE users SET age = age + $1, name = 'A, B' WHERE age > 26 RETURNING name, age", [1])) == [("A, B", 31), ("A, B", 36)]
    assert rows(engine.query("DELETE FROM users WHERE age > 100")) == [("DELETE 0",)]
    assert rows(engine.query("DELETE FROM users WHERE NOT active RETURNING age")) == [(36,)]
    assert engine.count("users") == 2
    assert engine.update("users", {"age": 40}, {"active": True}) == 2
    assert engine.delete("users") == 2


def test_upsert(engine):
    engine.query("INSERT INTO users (id, name, email, age) VALUES (1, 'Zed', 'z@x', 5) ON CONFLICT (id) DO UPDATE SET age = users.age + excluded.age")
    assert rows(engine.query("SELECT name, age FROM users WHERE id = 1")) == [("Alice", 35)]
    engine.query("INSERT INTO users (id, name, age) VALUES (1, 'Zed', 5) ON CONFLICT (id) DO NOTHING")
    assert rows(engine.query("SELECT age FROM users WHERE id = 1")) == [(35,)]


def test_transactions(engine, spark):
    engine.query("BEGIN")
    engine.query("DELETE FROM users WHERE name = 'Bob'")
    assert engine.count("users") == 2
    other = Engine(spark, engine.catalog.root)
    assert other.count("users") == 3
    engine.query("ROLLBACK")
    assert engine.count("users") == 3
    engine.query("BEGIN")
    engine.query("UPDATE users SET age = 1")
    other.query("UPDATE users SET age = 2 WHERE name = 'Bob'")
    with pytest.raises(ConflictError):
        engine.query("COMMIT")
    assert rows(engine.query("SELECT age FROM users")) == [(2,), (30,), (35,)]
    with pytest.raises(SqlError):
        engine.query("COMMIT")


def test_conflicting_commits(engine):
    data = engine.catalog.data(1, "users")
    base = data.version()
    data.commit(data.read(base), base)
    with pytest.raises(ConflictError):
        data.commit(data.read(base), base)
    assert data.read(base).count() == 3


def test_alter(engine):
    engine.query("ALTER TABLE users ADD COLUMN note text DEFAULT 'x', DROP COLUMN active")
    assert rows(engine.query("SELECT DISTINCT note FROM users")) == [("x",)]
    engine.query("ALTER TABLE users ALTER COLUMN age TYPE text")
    assert dict(engine.query("SELECT age FROM users").dtypes) == {"age": "string"}
    engine.query("ALTER TABLE users ADD CONSTRAINT named UNIQUE (name)")
    with pytest.raises(ValueError):
        engine.query("ALTER TABLE users ADD CONSTRAINT bad CHECK (name <> 'Bob')")
    engine.query("ALTER TABLE users DROP CONSTRAINT named")
    with pytest.raises(KeyError):
        engine.query("ALTER TABLE users DROP CONSTRAINT named")


def test_views_and_indexes(engine):
    engine.query("CREATE VIEW adults AS SELECT name, age FROM users WHERE age > 26")
    assert rows(engine.query("SELECT name FROM adults")) == [("Alice",), ("Charlie",)]
    with pytest.raises(ValueError):
        engine.query("CREATE VIEW adults AS SELECT 1")
    engine.query("CREATE OR REPLACE VIEW adults (who) AS SELECT name FROM users")
    assert engine.query("SELECT * FROM adults").columns == ["who"]
    engine.query("CREATE INDEX by_age ON users (age)")
    assert engine.catalog.list_indexes(1, "users") == ["by_age"]
    engine.query("DROP INDEX by_age")
    engine.query("DROP VIEW adults")
    engine.query("DROP VIEW IF EXISTS adults")
    with pytest.raises(KeyError):
        engine.query("DROP VIEW adults")


def test_functions_and_system_relations(engine):
    assert rows(engine.query("SELECT version() AS v, current_schema AS s, current_user AS u"))[0][1:] == ("public", "granary")
    assert rows(engine.query("SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'")) == [("users",)]
    assert rows(engine.query("SELECT attname FROM pg_catalog.pg_attribute WHERE attnotnull")) == [("id",), ("name",)]
    assert rows(engine.query("SELECT oid FROM pg_class WHERE relname = 'users'")) == [(oid("table", "users"),)]
    assert rows(engine.query("SELECT n_live_tup FROM pg_stat_user_tables")) == [(3,)]
    assert {r.attname: r.n_distinct for r in engine.query("ANALYZE users").collect()}["active"] == 2
    assert engine.query("SELECT null_frac FROM pg_stats WHERE attname = 'name'").first()[0] == 0.0
    assert "Filter" in engine.explain("SELECT name FROM users WHERE age > 1")


def test_auto_created_tables_and_calls(engine):
    engine.insert("things", [{"a": 1, "b": "x", "c": {"k": 1}}, {"a": 2, "b": None}])
    assert rows(engine.query("SELECT a, b, get_json_object(c, '$.k') FROM things")) == [(1, "x", "1"), (2, None, None)]
    last = engine.insert("things", {"a": 3})
    assert engine.get("things", last).first().a == 3
    assert engine.update_by_id("things", last, {"b": "z"}) == 1
    assert engine.delete_by_id("things", last) == 1
    assert engine.from_("things").order_by("a desc").limit(1).get()[0].a == 2


def test_tenants_are_apart(engine, spark):
    other = Engine(spark, engine.catalog.root, tenant=2)
    with pytest.raises(KeyError):
        other.table("users")
    other.query("CREATE TABLE users (x int)")
    assert other.count("users") == 0 and engine.count("users") == 3
    assert Catalog(spark, engine.catalog.root).list_tables(2) == ["users"]


def test_drop_table(engine):
    engine.query("DROP TABLE users")
    engine.query("DROP TABLE IF EXISTS users")
    with pytest.raises(KeyError):
        engine.query("DROP TABLE users")
    with pytest.raises(SqlError):
        engine.query("VACUUM")


def test_parsing_helpers():
    assert split_top("a, f(b, c), 'x,y'") == ["a", "f(b, c)", "'x,y'"]
    assert clause("a = 'where' and (where) where b", "where") == 24
    assert types.name_of("character varying(20)") == ("varchar", (20,))
    assert types.name_of("INT8") == ("bigint", ())
    with pytest.raises(ValueError):
        types.name_of("point")


def test_types(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("550E8400-e29b-41d4-a716-446655440000", "12", "{\"a\": [1]}"), ("", "x", "nope")], "u string, n string, j string")
    got = df.select(types.convert(F.col("u"), "uuid"), types.try_convert(F.col("n"), "smallint"), types.is_valid(F.col("j"), "json")).collect()
    assert [tuple(r) for r in got] == [("550e8400-e29b-41d4-a716-446655440000", 12, True), (None, None, False)]
    with pytest.raises(Exception, match="(?i)overflow|out of range|CAST"):
        df.limit(1).select(types.convert(F.lit(70000), "smallint")).collect()


def test_stream_equals_batch(spark, tmp_path):
    from granary.plans.registry import table
    from granary.streaming import rollup

    events = table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = rollup.daily_stream(rollup.event_stream(spark, f"{tmp_path}/in", events.schema))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("rolled").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("rolled")) == rows(rollup.daily(events))
