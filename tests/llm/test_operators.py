"""The training-data operators against brute force, on small fixtures with nulls, empty texts and repeated rows."""

import functools
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import additive_quantization, fingerprints, html_text, language_id, license_scan, line_dedup, mixing, near_dedup, sentencepiece_chunks, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"])[i % len(langs or [0])], (sources or ["s0", "s1"])[i % len(sources or [0, 1])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1. Additive quantisation.


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(1000, None, 0), (1001, [], 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [float("inf")] + [1.0] * 15, 0), (1061, [None] + [1.0] * 15, 0), (None, x[0].tolist(), 0), (20, x[20].tolist(), 0)]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = additive_quantization.search(vectors, F.col("vec_id") % 20 == 0, rerank=120, books=8, words=32).toPandas()
    assert set(got.query_id) == set(range(0, 600, 20))
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want = np.lexsort((np.arange(600), -score))[:20]
        hits += len(set(want) & set(part.vec_id))
        assert list(part["rank"]) == list(range(1, 21))
        assert np.allclose(part.score, score[part.vec_id], atol=1e-9)
        assert list(zip(-part.score, part.vec_id)) == sorted(zip(-part.score, part.vec_id))
    assert hits / 600 >= 0.95


def test_search_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], 0)], schema)
    got = additive_quantization.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert additive_quantization.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    books = additive_quantization.train(x, books=4, words=16)
    error = [((books.decode(books.encode(x, b)[0]) - x) ** 2).sum(1).mean() for b in (1, 8)]
    assert error[1] <= error[0] < (x**2).sum(1).mean()


# 2. Toxicity.


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(4)
    vocabulary = [f"word{i}x" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        words = [rnd.choice(vocabulary) for _ in range(20)]
        toxic = i % 4 == 0
        if toxic:
            words[3] = rnd.choice(("idiotic", "scummy"))
        # The label goes along with one group's name; the penalty must not let the name decide.
        if rnd.random() < (0.5 if toxic else 0.1):
            words[10] = "muslim"
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_what_is_said_not_who_is_named(labelled):
    docs, labels = labelled
    fair = toxicity.fit(docs, labels, penalty=1000.0)
    plain = toxicity.fit(docs, labels, penalty=0.0)
    assert fair.score("you scummy one") > 0.5 > fair.score("word1x word2x")
    gap = lambda m: abs(m.score("a muslim and word1x") - m.score("a christian and word1x"))
    assert gap(fair) < 0.02 and gap(fair) <= gap(plain)
    scored = toxicity.score(docs, fair).join(labels, "doc_id").toPandas()
    assert ((scored.score >= 0.3) == (scored.toxic == 1)).mean() > 0.99


def test_toxicity_penalty_covers_beginnings_of_words(spark):
    # Names and labels overlap, and the cue words leave something for the name to explain; the production penalty.
    rnd = random.Random(8)
    texts, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        said = [f"word{rnd.randrange(60)}x" for _ in range(12)]
        if toxic and rnd.random() < 0.7:
            said[3] = rnd.choice(("idiotic", "scummy"))
        if rnd.random() < (0.5 if toxic else 0.1):
            said[8] = "muslim"
        texts.append(" ".join(said))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    logit = lambda text: model.bias + sum(model.weights.get(x, 0.0) for x in toxicity.features(text))
    for other in ("christian", "atheist", "hindu"):
        assert abs(logit("a muslim and more") - logit(f"a {other} and more")) < 0.1
    assert model.score("you scummy one") > 0.5 > model.score("a muslim and more")
    assert toxicity.changed({"man", "old"}, "man", "woman") == ({"man", "^man"}, {"woman", "^woma", "^woman"})
    assert toxicity.changed({"muslim", "muslims"}, "muslim", "hindu") == ({"muslim"}, {"hindu", "^hind", "^hindu"})


def test_toxicity_edge_cases(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)))
    odd = documents(spark, [None, "", "idiotic " * 20_000, "idiotic", "idiotic"]).withColumn("score", F.lit("x"))
    got = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert got[0].score == got[1].score < 0.3 < got[2].score == got[3].score == got[4].score
    left = toxicity.reject(odd, model)
    assert left.columns == odd.columns and left.count() == 2
    assert toxicity.fit(docs, labels.limit(0)).score("idiotic") < 1e-9
    assert toxicity.score(empty(spark), model).count() == 0


# 3. License scans.


def test_license_scan(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"]
    changed = apache.replace("agreed to in writing", "agreed in writing").replace("express", "explicit")
    texts = ["bla " * 50 + changed + " bla" * 50, "x\nReleased under the MIT License.\ny", "nothing here", None, "", "the license of the version " * 40, ("All rights reserved. " + "w " * 30) * 2, "a" * 50_000]
    got = license_scan.scan(documents(spark, texts)).toPandas()
    assert sorted(zip(got.doc_id, got.license)) == [(0, "Apache-2.0"), (1, "MIT-line"), (6, "All-rights-reserved"), (6, "All-rights-reserved")]
    assert 0.95 < got[got.doc_id == 0].coverage.iloc[0] < 1
    assert license_scan.scan(empty(spark)).count() == 0


def test_license_scan_finds_copies_side_by_side():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    line, isc = "Released under the MIT License.", license_scan.TEMPLATES["ISC"]
    places = lambda text: [(m[0], m[2], m[3]) for m in scanner.scan(text)]
    for n in (1, 2, 4, 7):
        assert places(" ".join([line] * n)) == [("MIT-line", 5 * i, 5 * i + 4) for i in range(n)]
    size = len(license_scan.words(isc))
    part = " ".join(isc.split()[: int(size * 0.85)])
    assert [m[0] for m in scanner.scan(f"{part} {isc} x y {isc}")] == ["ISC"] * 3
    parted = isc.split()
    parted[40:40] = ["zz"] * 30
    assert [(m[0], m[1]) for m in scanner.scan(" ".join(parted))] == [("ISC", 1.0)]


def test_license_scan_tells_whole_texts_apart():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        assert [(m[0], m[1]) for m in scanner.scan("before " + text + " after")] == [(name, 1.0)]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"):
        rest = license_scan.TEMPLATES[name].split()
        rest[5:8] = ["other"]
        assert [m[0] for m in scanner.scan(" ".join(rest))] == [name]
    first = license_scan.TEMPLATES["MIT-grant-line"]
    assert [m[0] for m in scanner.scan(first)] == ["MIT-grant-line"]


def test_alignment_rises_and_reaches_the_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(60):
        a = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))]
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    words = [f"w{i}" for i in range(50)]
    assert len(license_scan.align(words, words[:20] + ["x"] + words[21:])) == 49


# 4. Fingerprints.


def test_fingerprints(spark):
    rnd = random.Random(3)
    words = [f"v{i}" for i in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 300))) for _ in range(60)] + ["", None, "é ß", "One two", "ONE two", "a b c d e f"]
    texts.append(texts[0])
    texts[5] = texts[4] + " more words at the end"
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in fingerprints.with_edited(docs).collect()}
    assert len(got) == len(texts)
    order = sorted(range(len(texts)), reverse=True)
    for i, nxt in zip(order, [*order[1:], order[0]]):
        t, n = texts[i] or "", texts[nxt] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, n)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.12 or min(len(a), len(b)) < 30
    assert got[0].fingerprint == got[len(texts) - 1].fingerprint
    assert got[63].fingerprint == got[64].fingerprint != ""  # A-Z as a-z
    assert got[60].fingerprint == got[61].fingerprint == ""


def test_fingerprint_edges(spark):
    assert fingerprints.with_edited(empty(spark)).count() == 0
    lone = fingerprints.with_edited(documents(spark, ["a b c d e f g"])).first()
    assert lone.near_next == 1.0
    rows = spark.createDataFrame([(None, "x y"), (3, "p q"), (3, "p q"), (7, None)], "doc_id long, text string")
    got = fingerprints.with_edited(rows).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 3), (3, 3), (3, 3), (7, 0)]


# 5. Line dedup.


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def lines_left(texts, least):
    """By brute force: a line goes if any earlier one is the same or (both long enough) within one edit."""
    seen, out = [], []
    for text in texts:
        keep = []
        for line in (text or "").split("\n"):
            t = line.strip(" \t\r")
            if not t:
                keep.append(line)
                continue
            same = any(t == s or (len(t) >= least and len(s) >= least and within_one(t, s)) for s in seen)
            seen.append(t)
            if not same:
                keep.append(line)
        out.append("\n".join(keep))
    return out


@pytest.mark.parametrize("bits", [27, 6])
def test_line_dedup(spark, bits):
    rnd = random.Random(8)
    pool = ["".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 14))).strip() for _ in range(25)]
    texts = []
    for _ in range(70):
        own = []
        for _ in range(rnd.randint(0, 5)):
            line = rnd.choice(pool)
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                at = rnd.randint(0, len(line))
                line = rnd.choice((line[:at] + rnd.choice("abz") + line[at:], line[:at] + line[at + 1 :], line[:at] + "z" + line[at + 1 :]))
            own.append(rnd.choice(("", " ")) + line)
        texts.append("\n".join(own))
    texts += [None, "", texts[3], "\n\n"]
    got = line_dedup.dedup(documents(spark, texts), keep_emptied=True, count=True, least=5, bits=bits).orderBy("doc_id").collect()
    want = lines_left(texts, 5)
    assert [(r.text or "").strip() for r in got] == [w.strip() for w in want]
    assert sum(r.n_dropped for r in got) > 50


def test_line_dedup_rows(spark):
    long = "one rather long line that stands in two documents"
    docs = documents(spark, [long + "\nfirst", long.replace("rather", "rathe") + "\nsecond", "nothing else", long, None, "", " "]).withColumn("row", F.lit(1)).withColumn("h", F.lit(2))
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert {k: r.text for k, r in got.items()} == {0: long + "\nfirst", 1: "second", 2: "nothing else", 4: None, 5: "", 6: " "}  # 3 has lost all
    assert line_dedup.dedup(docs).columns == docs.columns
    assert line_dedup.dedup(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, long), (4, long), (4, long)], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in line_dedup.dedup(nulls).collect()) == [4, 4]


# 6. Language identification.


def test_language_id(spark):
    texts = ["the cat and the dog of the house were there with them", "der hund und die katze sind nicht in dem haus", "le chat et le chien ne sont pas dans la maison"] * 30
    docs = documents(spark, texts, ["en", "de", "fr"])
    model = language_id.fit(docs)
    odd = documents(spark, ["the dog and the cat", "die katze und der hund", "le chien et la maison", None, "", "123 !!", "\U0001f600 ñ the"])
    got = language_id.predict(odd, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][:6] == ["en", "de", "fr", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score > 0.9
    nothing = language_id.fit(empty(spark))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def ppm_bits(model_texts, text):
    """By the definition: orders 3 to 0 with escapes and exclusion of seen symbols, then the uniform order."""
    counts = {}
    for t in model_texts:
        b = t.encode()
        for i, s in enumerate(b):
            for k in range(4):
                context = tuple(b[j] if j >= 0 else -1 for j in range(i - k, i))
                counts.setdefault(context, Counter())[s] += 1

    @functools.cache
    def p(context, s):
        c = counts.get(context)
        shorter = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
        if not c:
            return shorter(s)
        total, kinds = sum(c.values()), len(c)
        left = sum(shorter(x) for x in range(256) if x not in c)
        if left <= 0:
            return c[s] / total
        return c[s] / (total + kinds) if s in c else kinds / (total + kinds) * shorter(s) / left

    b = text.encode()
    return -sum(math.log2(p(tuple(b[j] if j >= 0 else -1 for j in range(i - 3, i)), s)) for i, s in enumerate(b))


def test_code_lengths_are_exact(spark):
    from granary.llm._common import text_bytes

    import pyarrow as pa

    texts = ["abra cadabra", "banana bandana", "cab"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    asked = ["abracad", "zzz", "ban", "a", "danaé"]
    got = model.bits(*text_bytes(pa.array(asked)))[:, 0]
    assert np.allclose(got, [ppm_bits(texts, t) for t in asked], rtol=1e-4)


# 7. SentencePiece.


def test_sentencepiece_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    alphabet = [" ", "▁", "a", "the", "é", "\n", "\t", "😀", "　", "<s>", "́", "  ", "word", "\x00"]
    texts = ["", None, " ", "  ", "▁", " a", "a ", "x" * 3000] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    texts += texts[:5]
    got = sentencepiece_chunks.encode(documents(spark, texts), path, ids=True, decoded=True, limit=50).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ids = sp.encode(t or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert sentencepiece_chunks.encode(empty(spark), path).count() == 0


# 8. HTML.

LONG = "This is the story of a dog that went to the market with a friend and came back in the evening, as it was late."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; x</footer>", f"Title {LONG} Short."),
        (f"<body><div class='sidebar'>{LONG}</div><div id=content><h1>Title</h1><p>{LONG}</p><p>Tiny &amp; <b>bo</b>ld</p></div><div class=comments><p>{LONG}</p></div></body>", f"Title {LONG} Tiny & bold"),
        (f"<article><p>{LONG}</p><div class='ad'>Buy</div><form><p>Name</p></form><script>var x = '<p>no</p>';</script><aside>{LONG}</aside><p>a<br>b\n c</p></article>", f"{LONG} a b c"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>{LONG}</a></li></ul></article>", LONG),
        ("<article><p>One.</p></article><div>other</div>", "One."),
        ("", ""),
        (None, ""),
        ("<html><head><title>T</title></head><body></body></html>", ""),
        (f"<article><!-- <p>no</p> --><p>{LONG}</p><style>p{{}}", LONG),
        ("<p", ""),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>"), (1, None, None), (None, "u", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages, "html", "page_id", "url").collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(LONG)]


# 9. Near-dedup.


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = []
    for _ in range(120):  # a large group of near copies
        own = list(base)
        for _ in range(rnd.choice((0, 1, 1, 2, 2, 3))):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        texts.append(" ".join(own))
    for _ in range(40):
        first = [rnd.choice(words) for _ in range(rnd.randint(3, 80))]
        for _ in range(rnd.randint(1, 3)):
            own = list(first)
            if rnd.random() < 0.7:
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(" ".join(own))
    texts += ["", None, "  ", "A b", "a B", "x y", texts[0], texts[0].upper().lower()]
    rnd.shuffle(texts)
    got = near_dedup.near_duplicates(documents(spark, texts)).orderBy("doc_id").collect()
    want, sizes = brute_components(texts)
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == sizes
    assert [r.kept for r in got] == [i == w for i, w in enumerate(want)]


def test_near_dedup_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(3, text), (2, text), (None, text), (5, "other words here"), (2, text)], "doc_id long, text string").withColumn("node", F.lit(0)).withColumn("n", F.lit(0))
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, 2, False), (2, 2, True), (2, 2, True), (3, 2, False), (5, 5, True)]
    left = near_dedup.deduplicate(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 2, 2, 5]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_dedup_matches_follow_percent(spark):
    for percent in (50, 70, 80, 85, 95):
        m, p = near_dedup.matches_at(percent), percent / 100
        miss = lambda n: sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(n))
        assert miss(m) <= near_dedup.MISS < miss(m + 1)
    assert near_dedup.matches_at(85) == 90
    texts = []
    for i in range(40):  # pairs of similarity 76 / 154 = 0.494
        words = [f"t{i}w{j}" for j in range(120)]
        texts += [" ".join(words), " ".join(words[:80] + [f"u{i}v{j}" for j in range(38)])]
    got = near_dedup.near_duplicates(documents(spark, texts), percent=48).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


# 10. Mixing.


def test_mixing_meets_its_targets(spark):
    texts = [f"some words number {i} " + ("| a | b " if i % 3 == 0 else "") for i in range(600)]
    docs = documents(spark, texts, ["en", "de", "fr", "en", "en"], ["a", "a", "a", "b"])
    wanted = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.2, "de": 0.4, "fr": 0.4}}
    found = mixing.probabilities(docs, wanted, keep=0.1, rounds=20).toPandas()
    assert found["__probability"].max() < 1  # no cell gives all it has, so all targets can be met
    mass = found.assign(m=found["__tokens"] * found["__probability"])
    for dimension in ("source", "lang"):
        share = mass.groupby(f"__{dimension}").m.sum() / mass.m.sum()
        for value, want in wanted[dimension].items():
            assert abs(share[value] - want) < 0.01
    assert abs(mass.m.sum() / found["__tokens"].sum() - 0.1) < 0.01


def test_mixing_matches_sql_and_edges(spark):
    import duckdb

    texts = ["a licensed text, License", "b | c", "SHOUT!!", None, "", "mail me@x", "plain words only"] * 30
    docs = documents(spark, texts, ["en", "de", None], ["s0", None, "s1", "s0"]).withColumn("w", F.lit(1)).withColumn("t", F.lit("x"))
    documents_ = docs.toPandas()  # noqa: F841  read by DuckDB
    c = duckdb.connect()
    c.register("documents", documents_)
    want = {r[0]: r for r in c.execute(mixing.oracle_sql()).fetchall()}
    found = mixing.probabilities(docs).select("doc_id", F.round("__probability", 6).alias("p"), (mixing.draw() < F.col("__probability")).alias("kept")).collect()
    assert {r.doc_id: (r.p, r.kept) for r in found} == {k: (v[5], v[6]) for k, v in want.items()}
    drawn = mixing.sample(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(r.kept for r in found)
    assert mixing.sample(empty(spark)).count() == 0


def test_mixing_meets_its_targets_where_cells_are_capped(spark):
    # At the production defaults: 'contacts' has too few tokens for its tempered share of 80 %.
    rnd = random.Random(6)
    tails = ["", "", "", "", "", "", " License", " a | b", " !!", " me@x"]
    texts = [" ".join(["word"] * rnd.randint(5, 60)) + rnd.choice(tails) for _ in range(800)]
    docs = documents(spark, texts, ["en", "en", "en", "de", "fr"], ["a", "a", "a", "b", "c", "a", "a"])
    found = mixing.marginals(docs).toPandas()
    assert (found.share - found.feasible).abs().max() < 1e-6
    assert (found.feasible - found.target).abs().max() > 0.01  # some targets ask for more than there is
    assert (found.kept - 0.8).abs().max() < 1e-9
    chance = mixing.probabilities(docs).toPandas()
    assert 0 < chance["__probability"].min() and chance["__probability"].max() == 1
    mass = chance.assign(m=chance["__tokens"] * chance["__probability"])
    assert abs(mass.m.sum() / mass["__tokens"].sum() - 0.8) < 1e-9
    for r in found.itertuples():
        own = mass[mass[f"__{r.dimension}"] == r.value]
        assert abs(own.m.sum() / mass.m.sum() - r.share) < 1e-9
        # A value gives all it has, or all such values are asked for the same multiple of their share.
        if r.feasible < r.target - 1e-9:
            assert (own["__probability"] == 1).all()
    ratio = (found.feasible / found.target)[found.feasible > found.target + 1e-9].groupby(found.dimension)
    assert (ratio.max() - ratio.min()).max() < 1e-9


def test_mixing_names_and_contradictions(spark):
    texts = ["a b c", "d e f g", "h !!", None]
    docs = documents(spark, texts * 10, ["en", "de"], ["x", "y"]).withColumn("__source", F.lit("mine")).withColumn("__probability", F.lit(7))
    found = mixing.probabilities(docs)
    assert found.columns[: len(docs.columns)] == docs.columns and "___probability" in found.columns
    assert {r["__source"] for r in found.collect()} == {"mine"}
    drawn = mixing.sample(docs)
    assert drawn.columns == docs.columns and 0 < drawn.count() <= 40
    # Each source has one language: half of the one and all of the other can't go together.
    with pytest.warns(UserWarning, match="can't be met together"):
        mixing.probabilities(documents(spark, ["a b"] * 40, ["en", "de"], ["x", "y"]), {"source": {"x": 0.9, "y": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, keep=0.3).count()
    none = mixing.probabilities(documents(spark, ["a b"] * 40, ["en"], ["x", "y"]), {"source": {"x": 1.0, "y": 0.0}}, keep=0.4).toPandas()
    assert set(none[none["__source"] == "y"]["__probability"]) == {0.0}
    assert np.allclose(none[none["__source"] == "x"]["__probability"], 0.8)
