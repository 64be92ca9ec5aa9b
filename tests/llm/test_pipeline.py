"""The pipeline on the smallest tables, each stage against brute force over what it was given."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import mixing, queries
from granary.llm._common import Scratch, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


def test_stages(spark):
    from test_operators import brute_components, lines_left

    scratch, docs = Scratch(spark, "test"), table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, SF), name.replace(" ", "_"))
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = (before, after)
        assert set(after) <= set(before) and len(after) == docs.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    before, after = seen["toxicity"]
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.98 * len(clean)
    before, after = seen["line dedup"]
    order = sorted(before)
    want = dict(zip(order, lines_left([before[i].text for i in order], 20), strict=True))
    assert {i: r.text.strip() for i, r in after.items()} == {i: t.strip() for i, t in want.items() if t.strip() or not before[i].text.strip()}
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = seen["near dedup"]
    order = sorted(before)
    roots, _ = brute_components([before[i].text for i in order])
    assert set(after) == {order[r] for r in roots}
    before, after = seen["mixing"]
    chance = mixing.probabilities(spark.createDataFrame(list(before.values()), table(spark, SF, "documents").schema))
    assert set(after) == {r.doc_id for r in chance.where(mixing.draw() < F.col("__probability")).collect()}
    before, after = seen["encoding"]
    assert set(before) == set(after) and all(len(r.ids) == r.n_tokens for r in after.values())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


ODD = "doc_id long, text string, lang string, source string, n_chars long, `__source` string, node long, `__row` long, score string, ids int"


def odd_folder(spark, root, rows):
    spark.createDataFrame(rows, ODD).write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 0, 0)]
    spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    plain = [(i, f"text number {i} says word{i % 7} and more of it" + " awful" * (i % 5 == 0), "en", "s", 10, "a", 1, 2, "x", 3) for i in range(40)]
    odd = [(None, None, None, None, None, None, None, None, None, None), (100, "", "de", None, 0, "b", 1, 1, "y", 1), (101, None, None, "s", None, "c", 1, 1, "z", 1)]
    long = "many different words " + " ".join(f"w{i}" for i in range(50_000))
    odd += [(102, long, "en", "s", len(long), "d", 1, 1, "x", 1), (103, long + " end", "en", "s", len(long), "d", 1, 1, "x", 1)]
    folder = odd_folder(spark, tmp_path, plain + odd + [plain[1], plain[1], odd[0]])
    docs = table(spark, folder, "documents")
    columns, scratch = docs.columns, Scratch(spark, "odd")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = scratch.save(stage(spark, docs, folder), name.replace(" ", "_"))
        assert docs.count() <= before
        if name != "encoding":
            assert docs.columns == columns
        if name == "toxicity":
            assert docs.where("text like '%awful%'").count() == 0 and docs.where("text is null").count() == 3
        if name == "near dedup":
            assert docs.where("doc_id in (102, 103)").count() == 1
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_empty_tables(spark, tmp_path):
    folder = odd_folder(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
