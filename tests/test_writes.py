"""Writes by several writers, keys with nulls, repeated keys, ids over partitions, appends, definitions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.client import Engine, SqlError
from granary.operators import dml, statistics
from granary.sources.log import ConflictError
from granary.sources.tables import ManagedTable


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.query("CREATE TABLE accounts (id bigint primary key, balance bigint)")
    e.query("INSERT INTO accounts VALUES (1, 100), (2, 100)")
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("statement", ["UPDATE accounts SET balance = balance + 1", "DELETE FROM accounts WHERE id = 1", "INSERT INTO accounts VALUES (3, 5)", "INSERT INTO accounts (id, balance) VALUES (1, 7) ON CONFLICT (id) DO UPDATE SET balance = 7"])
def test_no_update_is_lost(engine, spark, statement, monkeypatch):
    other = Engine(spark, engine.catalog.root)
    write = ManagedTable.write

    def between(self, rows, base):
        folder = write(self, rows, base)
        monkeypatch.setattr(ManagedTable, "write", write)
        other.query("UPDATE accounts SET balance = 150 WHERE id = 2")
        return folder

    monkeypatch.setattr(ManagedTable, "write", between)
    with pytest.raises(ConflictError):
        engine.query(statement)
    assert rows(engine.query("SELECT id, balance FROM accounts")) == [(1, 100), (2, 150)]
    engine.query(statement)


def test_several_tables_are_committed_at_once(engine, spark):
    engine.query("CREATE TABLE journal (note text)")
    other = Engine(spark, engine.catalog.root)
    engine.query("BEGIN")
    engine.query("INSERT INTO journal VALUES ('paid')")
    engine.query("UPDATE accounts SET balance = 0")
    other.query("UPDATE accounts SET balance = 1 WHERE id = 1")
    with pytest.raises(ConflictError):
        engine.query("COMMIT")
    assert engine.count("journal") == 0 and rows(engine.query("SELECT balance FROM accounts")) == [(1,), (100,)]
    engine.query("BEGIN")
    engine.query("INSERT INTO journal VALUES ('paid')")
    engine.query("UPDATE accounts SET balance = 0")
    other.query("CREATE TABLE unrelated (x int)")
    other.query("INSERT INTO unrelated VALUES (1)")
    engine.query("COMMIT")
    assert other.count("journal") == 1 and rows(other.query("SELECT DISTINCT balance FROM accounts")) == [(0,)]


def test_definitions_of_two_writers(engine, spark):
    other = Engine(spark, engine.catalog.root)
    other.catalog.tenant(1)
    engine.query("CREATE TABLE a (x int)")
    with pytest.raises(ConflictError):
        other.catalog.create_view(1, __import__("granary.catalog", fromlist=["ViewDef"]).ViewDef("v", "SELECT 1"))
    other.query("CREATE VIEW v AS SELECT 1 AS one")
    assert engine.query("SELECT * FROM v").columns == ["one"] and other.catalog.list_tables(1) == ["a", "accounts"]


def test_upsert_keeps_rows_without_keys(spark):
    schema = "k long, a string, n long"
    old = spark.createDataFrame([(None, "keep", 7), (1, "x", 1)], schema)
    new = spark.createDataFrame([(None, "new", 8), (1, "y", 2), (2, "z", 3)], schema)
    assert sorted(map(str, map(tuple, dml.upsert(old, new, ["k"]).collect()))) == sorted(map(str, [(None, "keep", 7), (None, "new", 8), (1, "y", 2), (2, "z", 3)]))
    twice = new.union(new)
    with pytest.raises(Exception, match="changed twice"):
        dml.upsert(old, twice, ["k"]).collect()
    assert dml.upsert(old, twice, ["k"], {}).where("k = 2").count() == 1


def test_serial_ids_run_on_over_partitions(engine, spark):
    engine.query("CREATE TABLE many (id serial primary key, x bigint)")
    engine.insert("many", spark.range(1000).select(F.col("id").alias("x")).repartition(9))
    assert rows(engine.query("SELECT min(id), max(id), count(DISTINCT id) FROM many")) == [(1, 1000, 1000)]
    engine.insert("many", {"x": 5})
    assert engine.last_insert_id == 1001


def test_returning_is_lazy_and_sees_one_version(engine):
    changed = engine.query("UPDATE accounts SET balance = balance + 1 WHERE id = 1 RETURNING id, balance")
    engine.query("DELETE FROM accounts")
    assert rows(changed) == [(1, 101)]


def test_appends_add_folders_until_there_are_many(engine, monkeypatch):
    monkeypatch.setattr(ManagedTable, "MOST_FOLDERS", 3)
    log = engine.catalog.log(1)
    first = log.table("accounts")[1]
    engine.query("INSERT INTO accounts VALUES (3, 1)")
    assert log.table("accounts")[1][:1] == first and len(log.table("accounts")[1]) == 2
    for i in range(4, 9):
        engine.query(f"INSERT INTO accounts VALUES ({i}, 1)")
    assert len(log.table("accounts")[1]) <= 3 and engine.count("accounts") == 8
    with pytest.raises(ValueError):
        engine.query("INSERT INTO accounts VALUES (8, 1)")
    with pytest.raises(ValueError):
        engine.query("INSERT INTO accounts VALUES (20, 1), (20, 2)")
    assert engine.count("accounts") == 8


def test_commit_numbers_are_taken_once(engine, spark):
    log = engine.catalog.log(1)
    number, state = log.latest()
    assert not log._put(number, "{}")
    assert log.latest() == (number, state)
    fs, where = log._fs(f"{log.path}/.half")
    fs.create(where, False).close()  # a writer that died
    engine.query("INSERT INTO accounts VALUES (9, 9)")
    assert engine.count("accounts") == 3 and log.latest()[0] == number + 1


def test_truncate_and_prepared(engine):
    engine.query("PREPARE rich AS SELECT id FROM accounts WHERE balance >= $1")
    assert rows(engine.query("EXECUTE rich(100)")) == [(1,), (2,)]
    with pytest.raises(SqlError):
        engine.query("PREPARE rich AS SELECT 1")
    engine.query("DEALLOCATE rich")
    with pytest.raises(SqlError):
        engine.query("EXECUTE rich(100)")
    engine.query("TRUNCATE accounts")
    assert engine.count("accounts") == 0


def test_middle_values(spark):
    import random

    rnd = random.Random(4)
    values = [f"Customer#{rnd.randrange(10**6):06d}" for _ in range(500)] + ["outlier", None, "Customer#000001", "Customer#000001"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    there = sorted(v for v in values if v is not None)
    assert tuple(statistics.histogram(df, "v").first()) == (there[0], there[len(there) // 2], there[-1])
    stats = statistics.all_stats(df, ["v"]).first()
    assert stats.histogram_bounds == "{" + ",".join((there[0], there[len(there) // 2], there[-1])) + "}"
    assert stats.n_distinct == len(set(there)) and abs(stats.null_frac - 1 / 504) < 1e-12 and stats.most_common_vals.startswith("{Customer#000001,")
    none = statistics.all_stats(df.where("v is null"), ["v"]).first()
    assert (none.null_frac, none.n_distinct, none.histogram_bounds) == (1.0, 0, "{}")
    empty = statistics.all_stats(df.limit(0), ["v"]).first()
    assert (empty.null_frac, empty.n_distinct, empty.most_common_vals) == (0.0, 0, "{}")


@pytest.mark.parametrize("levels", [1, 2])
def test_middles_of_odd_groups(spark, levels):
    import random

    rnd = random.Random(5)
    long = "<!DOCTYPE html><html><head>" * 20
    groups = {
        "behind a long start": [long + str(rnd.random()) for _ in range(2000)],
        "outliers": ["", "zz", long + "x"] + [long * 2 + str(rnd.random()) for _ in range(2000)],
        "one often": ["é"] * 5000 + [f"{n:05d}" for n in range(2000)] + ["日本"] * 4999,
        "two": ["b", "a"], "one": ["same"], "empty": [""], "starts": ["a" * n for n in range(400)], "nulls": [None] * 3,
    }
    df = spark.createDataFrame([(g, v, n) for g, vs in groups.items() for v, n in Counter(vs).items()], "attname string, value string, count long")
    want = {g: sorted(vs, key=str.encode)[len(vs) // 2] for g, vs in groups.items() if vs[0] is not None}
    assert {r.attname: r.middle for r in statistics.middles(df, levels=levels).collect()} == want


def test_statistics_keep_a_column_spread(spark):
    """No task of them reads a column's values alone, even if no table seems small enough to go to all tasks."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).selectExpr("concat('<html>', sha2(cast(id as string), 256)) as page")
        store = spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext.setJobGroup("spread", "spread")
        (got,) = statistics.all_stats(df, ["page"]).collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("spread") for s in tracker.getJobInfo(j).stageIds}
        read = []
        for s in stages:
            tasks = store.taskList(s, 0, 1000)
            read += [m.get().shuffleReadMetrics().recordsRead() for m in (tasks.apply(i).taskMetrics() for i in range(tasks.size())) if m.isDefined()]
        assert got.n_distinct == 20_000 and len(read) > 16
        assert max(read) < 3000, sorted(read)[-5:]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in was.items():
            spark.conf.set(k, v)
