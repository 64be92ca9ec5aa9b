"""Row-exact semantics on small fixtures: three-valued logic, order of nulls, empty groups, DML."""

import pytest
from pyspark.sql import functions as F

from granary.operators import constraints, dml, joins, statistics
from granary.plans.builder import Query, QueryOptions, page, run
from granary.plans.predicates import And, Compare, Not, Or, column_of, holds


@pytest.fixture(scope="module")
def users(spark):
    rows = [(1, 25, "Beijing", True), (2, 30, "Shanghai", True), (3, 20, "Beijing", False), (4, 35, "Shenzhen", True), (5, None, None, None)]
    return spark.createDataFrame(rows, "id long, age int, city string, active boolean")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (And([Compare("age", ">", 20), Compare("city", "=", "Beijing")]), [1]),
        (Or([Compare("age", "<", 22), Compare("age", ">", 33)]), [3, 4]),
        (Not(Compare("active", "=", True)), [3]),
        (Compare("city", "in", ["Beijing", "Shanghai"]), [1, 2, 3]),
        (Compare("age", "between", (25, 32)), [1, 2]),
        (Not(Compare("age", ">", 20)), [3]),
        (Compare("age", "=", None), []),
        (Compare("active", "is null"), [5]),
        (Compare("age", ">", 24.5), [1, 2, 4]),
        (Compare("city", "like", "S%"), [2, 4]),
        ({"age": {"$gte": 25, "$lt": 35}}, [1, 2]),
        ({"city": None}, [5]),
        ({"age": {"$ne": 25}}, [2, 3, 4]),
        ({}, [1, 2, 3, 4, 5]),
        (And([]), [1, 2, 3, 4, 5]),
        (Or([]), []),
        ("age > 20 and active", [1, 2, 4]),
        (None, [1, 2, 3, 4, 5]),
    ],
)
def test_filters(users, predicate, want):
    assert ids(users.where(column_of(predicate))) == want


def test_unknown_operators(users):
    with pytest.raises(ValueError):
        column_of(Compare("age", "~", 1))
    with pytest.raises(ValueError):
        column_of({"age": {"$near": 1}})


def test_null_order(users):
    up = [r.age for r in run(users, QueryOptions(["age"], order=["age"])).collect()]
    down = [r.age for r in run(users, QueryOptions(["age"], order=["age desc"])).collect()]
    assert up == [20, 25, 30, 35, None]
    assert down == [None, 35, 30, 25, 20]


def test_filter_sort_offset_limit(users):
    got = run(users, QueryOptions(["id"], Compare("age", ">", 20), ["age desc"], 1, 1)).collect()
    assert [r.id for r in got] == [2]
    rows, more = page(users, QueryOptions(order=["id"], limit=2))
    assert (len(rows), more) == (2, True)
    assert page(users, QueryOptions(order=["id"], limit=5))[1] is False


def test_builder(users):
    q = Query(users).where({"active": True}).group_by("city").agg(F.count(F.lit(1)).alias("n")).order_by("city")
    assert [(r.city, r.n) for r in q.get()] == [("Beijing", 1), ("Shanghai", 1), ("Shenzhen", 1)]
    assert Query(users).where_null("age").first().id == 5
    assert Query(users).where_in("id", [1, 9]).rows() == 1


def test_joins_do_not_match_nulls(spark, users):
    other = spark.createDataFrame([("Beijing", 1), (None, 2)], "place string, n int")
    assert ids(joins.equi(users, other, [("city", "place")])) == [1, 3]
    assert joins.equi(users, other, [("city", "place")], "right").where("id is null").count() == 1


def test_band_join(spark):
    a = spark.createDataFrame([(0.5,), (-1.2,)], "start double")
    b = spark.createDataFrame([(0.49,), (0.5,), (1.49,), (1.5,), (-0.3,)], "value double")
    assert sorted((r.start, r.value) for r in joins.band(a, b, "start", "value", 1.0).collect()) == [(-1.2, -0.3), (0.5, 0.5), (0.5, 1.49)]


def test_update_and_delete_leave_unknown_rows(users):
    after = {r.id: r.age for r in dml.update(users, {"age": F.col("age") + 1}, Compare("age", ">", 24)).collect()}
    assert after == {1: 26, 2: 31, 3: 20, 4: 36, 5: None}
    assert ids(dml.delete(users, Compare("age", ">", 20))) == [3, 5]
    assert ids(dml.delete_returning(users, Compare("age", ">", 20))) == [1, 2, 4]
    assert ids(dml.delete(users)) == []
    assert users.where(holds("age > 100 or null")).count() == 0
    with pytest.raises(ValueError):
        dml.update(users, {"nope": 1})


def test_insert_and_upsert(spark, users):
    more = spark.createDataFrame([(6, 44)], "id long, age int")
    assert dml.insert(users, more).where("id = 6").first().city is None
    new = spark.createDataFrame([(1, 99, "X", False), (7, 7, "Y", True)], users.schema)
    out = {r.id: (r.age, r.city) for r in dml.upsert(users, new, ["id"], {"age": F.col("old.age") + F.col("new.age")}).collect()}
    assert out[1] == (124, "Beijing") and out[7] == (7, "Y") and len(out) == 6
    assert {r.id: r.age for r in dml.upsert(users, new, ["id"], {}).collect()}[1] == 25


def test_constraints(spark, users):
    assert [r.city for r in constraints.repeated_keys(users, ["city"]).collect()] == ["Beijing"]
    assert ids(constraints.null_rows(users, ["age", "city"])) == [5]
    assert ids(constraints.failing_rows(users, "age >= 25")) == [3]
    assert ids(constraints.orphans(users, ["city"], spark.createDataFrame([("Beijing",)], "name string"), ["name"])) == [2, 4]


def test_statistics(users):
    got = {r.attname: r for r in statistics.column_stats(users).collect()}
    assert got["age"].null_frac == 0.2 and got["city"].n_distinct == 3 and got["id"].avg_width == 8
    assert [(r.value, r.freq) for r in statistics.most_common(users, "city").collect()] == [("Beijing", 0.5), ("Shanghai", 0.25), ("Shenzhen", 0.25)]
    assert tuple(statistics.histogram(users, "city").first()) == ("Beijing", "Shanghai", "Shenzhen")
    assert tuple(statistics.histogram(users.where("id = 5"), "city").collect()) in ((), ((None, None, None),))


def test_empty_aggregates(users):
    none = users.where("id > 100")
    assert tuple(none.agg(F.sum("age"), F.avg("age"), F.count("age")).first()) == (None, None, 0)
    assert none.groupBy("city").count().count() == 0
