"""The methods themselves against independent recomputation, and the cases at their edges."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import _common, additive_quantization, fingerprints, html_text, language_id, license_scan, line_dedup, near_dedup, sentencepiece_chunks, toxicity
from test_operators import DOCS, brute_components, documents, empty, lines_left

# Shared plumbing.


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab  \n\té") for _ in range(3000)) + "x" * 500 + " tail"
    raw, offsets = _common.text_bytes(pa.array([text]))
    whole, at = _common.word_hashes(raw, offsets)
    shingles, _ = _common.shingle_hashes(whole, at)
    for size in (7, 64, 501, 1000):
        monkeypatch.setattr(_common, "SLICE_BYTES", size)
        pieces, at_pieces = _common.word_hashes(raw, offsets)
        assert (pieces == whole).all() and (at_pieces == at).all()
        parts = [h for h, _ in _common.shingle_pieces(whole, at, size=size)]
        assert (np.concatenate(parts) == shingles).all()


def test_checkpoint_folder_comes_from_the_session(spark, monkeypatch):
    assert _common.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        class sparkContext:  # noqa: N801
            master = "yarn"

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="share"):
        _common.checkpoint_root(Cluster)


def test_temporaries_go(spark):
    with _common.temporaries():
        scratch = _common.Scratch(spark, "gone")
        assert scratch.save(spark.range(3), "t").count() == 3
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(f"{scratch.root}/t").count()


def test_hot_keys_are_dealt_out(spark):
    big = spark.createDataFrame([(i, 1 if i % 3 == 0 else i) for i in range(300)] + [(None, None)], "i long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 2)] + [(1, "one")], "k long, v string")
    hot = _common.hot_keys(big, "k")
    assert [r.k for r in hot.collect()] == [1]
    got = {(r.i, r.k): r.v for r in _common.join_spread(big, small, "k", hot, F.xxhash64("i")).collect()}
    assert len(got) == 301 and got[(3, 1)] == "one" and got[(4, 4)] == "v4" and got[(5, 5)] is None and got[(None, None)] is None


# 1. Additive quantisation.


def test_search_takes_the_least_of_repeated_vectors_and_any_columns(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [0.9, 0.1], "x"), (1, [0.2, 0.1], "y"), (2, [0.9, 0.1], "x"), (3, [0.9, 0.1], "x"), (4, [1.0], "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("rank", F.lit(1)).withColumn("block", F.lit(2))
    got = additive_quantization.search(vectors, F.col("vec_id") == 0, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 0.9), (3, 0.9)]


def test_blocks_and_tasks_change_nothing(spark):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    options = {"k": 5, "rerank": 300, "books": 4, "words": 16}
    want = sorted(map(tuple, additive_quantization.search(vectors, F.col("vec_id") % 3 == 0, **options).collect()))
    got = sorted(map(tuple, additive_quantization.search(vectors, F.col("vec_id") % 3 == 0, query_bytes=640, page=32, spread=9, **options).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and len(want) == 500


# 2. Toxicity.


def test_gradient_is_the_losss():
    rng = np.random.default_rng(0)
    rows = [rng.choice(12, rng.integers(0, 6), replace=False) for _ in range(20)]
    loss = toxicity.Loss(rows, rng.integers(0, 2, 20).astype(float), [(3, [0, 1], [2]), (1, [4], []), (2, [2], [0, 5])], 12, 7.0, 0.1)
    w = rng.normal(size=13)
    _, grad = loss.at(w)
    for i in range(13):
        step = np.eye(13)[i] * 1e-6
        assert abs((loss.at(w + step)[0] - loss.at(w - step)[0]) / 2e-6 - grad[i]) < 1e-6
    z = np.array([w[r].sum() + w[12] for r in rows])
    by_hand = np.mean(np.log1p(np.exp(z)) - loss.y * z) + 0.05 * (w[:12] ** 2).sum()
    by_hand += 7 / 20 * (3 * (w[0] + w[1] - w[2]) ** 2 + w[4] ** 2 + 2 * (w[2] - w[0] - w[5]) ** 2)
    assert abs(loss.at(w)[0] - by_hand) < 1e-12


def test_swapped_sentences_change_what_changed_says():
    rnd = random.Random(5)
    for _ in range(300):
        kind = rnd.choice(toxicity.IDENTITY_TERMS)
        term, swap = rnd.sample(kind, 2)
        said = [rnd.choice(["muslin", "christ", "mano", "woma", "oldest", "young", term, swap, "blac"]) for _ in range(rnd.randint(0, 4))] + [term]
        before = toxicity.features(" ".join(said))
        after = toxicity.features(" ".join(swap if w == term else w for w in said))
        assert toxicity.changed(set(said), term, swap) == (before - after, after - before)


def test_penalty_closes_the_gap(spark):
    rnd = random.Random(9)
    texts, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        said = [f"word{rnd.randrange(40)}x" for _ in range(8)]
        if rnd.random() < (0.6 if toxic else 0.2):
            said[2] = "idiotic"
        if rnd.random() < (0.5 if toxic else 0.1):
            said[5] = "muslim"
        texts.append(" ".join(said))
        labels.append((i, 0, int(toxic)))
    docs, known = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    logit = lambda m, text: m.bias + sum(m.weights.get(x, 0.0) for x in toxicity.features(text))
    models = {p: toxicity.fit(docs, known, penalty=p) for p in (0.0, 10.0, 1000.0)}
    gaps = {p: abs(logit(m, "a muslim") - logit(m, "a christian")) for p, m in models.items()}
    assert gaps[0.0] > 0.5 and gaps[10.0] < gaps[0.0] / 5 and gaps[1000.0] < gaps[0.0] / 10
    assert models[10.0].swaps == 6 * sum("muslim" in t for t in texts)
    assert 0.1 < models[10.0].score("a muslim") < 0.6  # not saturated
    assert models[10.0].score("idiotic") > models[10.0].score("a muslim")


def test_toxicity_takes_contradicting_labels_as_toxic_and_threshold_as_above(spark):
    docs = documents(spark, ["bad word", "good word"] * 30)
    labels = [(i, 0, int(i % 2 == 0)) for i in range(60)] + [(0, 0, 0), (2, 0, 0)]
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.score("bad") > 0.5 > model.score("good")
    edge = model.score("bad word")
    assert toxicity.reject(docs, model, edge).count() == 30
    assert toxicity.fit(docs, spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")).score("bad word") < 0.01


# 3. License scans.


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_subsequences_are_longest():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        for pairs in (license_scan.common(a, b), license_scan.align(a, b)):
            assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(license_scan.common(a, b)) == longest(a, b) >= len(license_scan.align(a, b))
        gap = [["x", *"abab", *a, *a, "y"], ["z", *b, *b, *"baba", "w"]]  # every word stands twice: no anchors
        assert len(license_scan.align(*gap)) == longest(*gap)


def test_copies_beside_shuffled_words_are_found():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    rnd = random.Random(1)
    for name in ("MIT", "ISC", "BSD-3-Clause", "GPL-3.0-or-later", "Zlib"):
        w = license_scan.words(license_scan.TEMPLATES[name])
        for _ in range(15):
            drop = set(rnd.sample(range(len(w)), int(0.15 * len(w))))
            drop -= {i for i, x in enumerate(w) if x in ("3", "later")}
            part = [x for i, x in enumerate(w) if i not in drop]
            mixed = rnd.sample(w, len(w))
            text = " ".join(mixed[: rnd.randint(0, 40)] + part + mixed[: rnd.randint(0, 40)])
            assert name in {m[0] for m in scanner.scan(text)}, (name, text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under CC BY-NC-SA 3.0.", []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0-line"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-line"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ["CC-BY-NC-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 International License.", []),
    ],
)
def test_versions_and_variants_agree(text, want):
    assert [m[0] for m in license_scan.Scanner(license_scan.TEMPLATES).scan(f"x {text} y")] == want


def test_license_scan_rows(spark):
    long = "word " * 30_000 + license_scan.TEMPLATES["ISC"] + " word" * 30_000
    docs = documents(spark, [long, long, None]).withColumn("license", F.lit("x")).withColumn("coverage", F.lit(1))
    got = license_scan.scan(docs).collect()
    assert sorted((r.doc_id, r.license, r.coverage, r.first_word) for r in got) == [(0, "ISC", 1.0, 30_000), (1, "ISC", 1.0, 30_000)]


# 4. Fingerprints.


def test_fingerprints_by_definition():
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(n)) for n in (1, 3, 5, 9, 40, 60, 300, 4000)]
    got = fingerprints.fingerprints(*_common.text_bytes(pa.array(texts)))
    for row, text in zip(got, texts, strict=True):
        words = [int(h) for h in _common.word_hashes(*_common.text_bytes(pa.array([text])))[0]]
        runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
        bins = {}
        for run in runs:
            total = 0
            for w in (*run, *[0] * (5 - len(run))):
                total = (total * _common._BASE + w) % (1 << 64)
            h = int(_common.mix(np.array([(total + len(run)) % (1 << 64)], np.uint64))[0])
            b, low = h >> 55, h & ((1 << 55) - 1)
            bins[b] = min(low, bins.get(b, 1 << 60))
        for b in range(fingerprints.BINS):
            tries = sorted(range(fingerprints.BINS), key=lambda j: fingerprints._RANKS[b, j])
            source = b if b in bins else next(j for j in tries if j in bins)
            assert row[b] == bins[source] & 15


def test_fingerprints_of_any_columns_and_long_texts(spark):
    long = "some words that go on and on " * 40_000
    docs = documents(spark, [long, "b c d e f g", long]).withColumn("range", F.lit(1)).withColumn("place", F.lit(2)).withColumn("id", F.lit("x"))
    got = {r.doc_id: r for r in fingerprints.with_edited(docs).collect()}
    assert got[0].fingerprint == got[2].fingerprint and got[0].n_chars == len(long) and len(got) == 3


# 5. Line dedup.


def test_lines_of_many_documents(spark):
    rnd = random.Random(2)
    hot = "this very line stands in a third of all documents"
    texts = []
    for i in range(400):
        own = [f"line number {rnd.randrange(10**9)} of document {i} and no other"]
        if i % 3 == 0:
            own.append(hot if i % 2 else hot.replace("very", "vary"))
        texts.append("\n".join(own))
    docs = documents(spark, texts).repartition(40).withColumn("__row", F.lit(1)).withColumn("__places", F.lit("x")).withColumn("kin", F.lit(0))
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, keep_emptied=True).collect()}
    assert [got[i].strip() for i in range(400)] == [t.strip() for t in lines_left(texts, 20)]


def test_long_lines_and_texts(spark):
    line = "x y " * 50_000
    texts = [line, line[:-1] + "!", "short\n" * 20_000 + line.replace("x", "z", 1), "other text"]
    got = line_dedup.dedup(documents(spark, texts), keep_emptied=True, count=True).orderBy("doc_id").collect()
    assert [r.n_dropped for r in got][1] == 1 and got[0].n_dropped == 0
    assert got[2].n_dropped == 20_000 and got[2].n_lines == 20_001 and got[3].text == "other text"


def test_one_edit_is_told_from_more():
    from test_operators import within_one

    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8)))
        b = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 8)))
        assert line_dedup.within_one(a, b) == within_one(a, b)


def test_variants_hash_what_is_left():
    line = "some line with 漢字 and é"
    v, w = line_dedup.deletions(line, 0, len(line))
    for i in range(len(line)):
        a, b = line_dedup.whole(line[:i] + line[i + 1 :])
        assert v[i] == a[0] and w[i] == b[0]


# 6. Language identification.


def test_language_pieces_ties_and_names(spark, monkeypatch):
    docs = documents(spark, ["aba cab", "aba cab"] * 20, ["xx", "yy"])
    model = language_id.fit(docs)
    odd = documents(spark, ["abacab " * 30_000, "aba"]).withColumn("lang_pred", F.lit("z")).withColumn("score", F.lit("z"))
    got = language_id.predict(odd, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in got] == [("xx", 0.5), ("xx", 0.5)]  # equal code lengths: the first by name
    raw, offsets = _common.text_bytes(pa.array(["abra cadabra", "", "x", "cab aba " * 9]))
    want = model.bits(raw, offsets)
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(language_id, "SLICE_BYTES", size)
        assert np.allclose(model.bits(raw, offsets), want)
    with pytest.raises(ValueError, match="languages"):
        monkeypatch.setattr(language_id, "MOST_LANGS", 1)
        language_id.fit(docs)


def test_all_bytes_seen_leave_no_escape():
    raw = np.tile(np.arange(256, dtype=np.uint8), 3)
    grams, counts = np.unique(language_id._grams(raw, np.array([0, len(raw)])), return_counts=True)
    model = language_id.build(["x"], np.zeros(len(grams), int), grams, counts)
    bits = model.costs(grams)[:, 0]
    assert np.isfinite(bits).all() and (bits >= 0).all()
    every = np.array([(256 * 257 + 256) * 257 * 257 + 256 * 257 + b for b in range(256)])  # at a text's start
    assert abs(np.exp2(-model.costs(every)[:, 0]).sum() - 1) < 1e-4


# 7. SentencePiece.


def test_long_texts_are_encoded_in_pieces(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(6)
    with open(path, "rb") as f:
        table = sentencepiece_chunks.ChunkTable(f.read(), 4_000)
    for size in (1, 3, 10, 50):
        monkeypatch.setattr(sentencepiece_chunks, "SLICE_BYTES", size)
        for _ in range(60):
            text = "".join(rnd.choice([" ", "  ", "▁", "a", "the", "é", "\n", "😀", "word"]) for _ in range(rnd.randint(0, 60)))
            ids = sp.encode(text)
            ((joined, back),) = list(table.encode([text]))
            assert joined == ",".join(map(str, ids)) and back == sp.decode(ids), repr(text)
    docs = documents(spark, ["a b", None]).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    assert [r.ids for r in sentencepiece_chunks.encode(docs, path, ids=True).orderBy("doc_id").collect()] == [sp.encode("a b"), []]


# 8. HTML.

LONG = "This is the story of a dog that went to the market with a friend and came back in the evening, as it was late."
CJK = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 3
RUSSIAN = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 2


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='overflow-hidden'><p>{LONG}</p></div>", LONG),
        (f"<div id='related-work'><p>{LONG}</p></div><section class=side-effects><p>{LONG}</p></section>", f"{LONG} {LONG}"),
        (f"<div class='legal-analysis'><p>{LONG}</p></div><div class='legal'><p>{LONG}</p></div>", LONG),
        (f"<div class='site-footer'><p>{LONG}</p></div><p>{LONG}</p><div class='ad-slot box'>{LONG}</div><div hidden>{LONG}</div>", LONG),
        (f"<article><p title=it's>{LONG}</p><p class=\"x\"\">{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>A short teaser.</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<div><p>{CJK}</p></div>", CJK),
        (f"<div><p>{RUSSIAN}</p><p>Да.</p></div><div><a href=x>{RUSSIAN}</a></div>", f"{RUSSIAN.strip()} Да."),
        (f"<form id=page><div><p>{LONG}</p></div></form>", LONG),
        (f"<div><p>{LONG}</p></div><form><p>{LONG}</p></form>", LONG),
        (f"<article><p>{LONG} <span class=ad>Buy <span>now</span></span> end</p><p>a <span class=ad>open</p><p>{LONG}</p></article>", f"{LONG} end a {LONG}"),
        (f"<main><div><p>{LONG}</p></div><article><p>{LONG}</p><p>{LONG}</p></article></main>", f"{LONG} {LONG}"),
        ("<p>x < 3 and y > 2 <!-- > --> z <!--", "x < 3 and y > 2 z"),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title {LONG}"),
    ],
)
def test_rules(page, want):
    assert html_text.main_text(page) == want


def test_first_pass_decides_in_articles_too():
    menu = "".join(f"<li><a href={i}>a link to another page {i}</a></li>" for i in range(5))
    found = html_text.blocks(f"<article><p>{LONG}</p><ul>{menu}</ul><p>Short.</p><p>{LONG}</p></article>")
    first = [html_text.judge(b) for b in found]
    assert first == [True, False, False, False, False, False, None, True]
    assert html_text.second(first, list(range(8)), False, [False] * 8) == [0, 6, 7]  # as near to both: the good one
    assert html_text.second([True, False, None, False], [0, 1, 2, 3], False, [False] * 4) == [0]


def test_articles_are_found_without_their_element():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    same = sum(html_text.main_text(h) == html_text.main_text(re.sub(r"(</?)article", r"\1div", h)) for h in pages)
    assert same >= 0.99 * len(pages)


def test_odd_markup_takes_linear_time():
    for part in ("<span class='ad'>x ", "<button>x ", '<p class="x>', "<div><li>", "<!--", "<svg>", "<a href='"):
        began = time.perf_counter()
        html_text.main_text(f"<article><p>{LONG}</p>" + part * 20_000)
        assert time.perf_counter() - began < 5


# 9. Near-dedup.


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    plain = near_dedup.nodes_of
    monkeypatch.setattr(near_dedup, "nodes_of", lambda h, at, salt=0: plain(h, at, salt) if salt else plain(h, at) % 5)
    rnd = random.Random(7)
    texts = []
    for i in range(30):
        words = [f"t{i}w{j}" for j in range(60)]
        texts += [" ".join(words), " ".join(words), " ".join([*words[:-1], "x"])][: rnd.randint(1, 3)]
    got = near_dedup.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()
    want, sizes = brute_components(texts)
    assert [r.component_id for r in got] == want and [r.n_shingles for r in got] == sizes


def test_blocks_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_BLOCK_SHINGLES", 500)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(100)] = f"z{rnd.randrange(50)}"
        texts.append(" ".join(own))
    got = near_dedup.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == brute_components(texts)[0]


def test_near_dedup_of_a_long_text(spark):
    rnd = random.Random(1)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(300_000))
    docs = documents(spark, [long + " end", long, "a b", long.upper()])
    got = near_dedup.near_duplicates(docs).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 0, 2, 0] and got[1].n_shingles > 299_000


def test_components_that_do_not_settle_raise(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_MOST_STARS", 1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    with pytest.raises(RuntimeError):
        near_dedup.components(edges, _common.Scratch(spark, "t"), "x")


def test_empty_tables(spark):
    assert line_dedup.dedup(empty(spark)).columns == [c.split()[0] for c in DOCS.split(", ")]
