"""Language identification by prediction by partial matching (PPM).

Per language, a context tree over bytes of order 0 to 3 gives every symbol a probability: a context that was
seen T times with q different symbols gives a seen symbol count/(T+q) and passes the escape mass q/(T+q) to the
next shorter context, restricted to the symbols not seen here (exclusion); below order 0 lies a uniform order
over the 256 bytes.  The statistics are frozen after learning, so the cost of a symbol depends on the last three
bytes only.

The tree is kept sparse, as sorted keys: bits of each symbol seen in a context, and bits of the escape from each
context, which are the same for all symbols not seen there.  A text's distinct runs of four bytes are looked up, order by order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import SLICE_BYTES, Scratch, map_arrow, slices, text_bytes

ORDER = 3
#: Bytes that a model may take in each worker, and languages that it may tell apart.
MOST_BYTES, MOST_LANGS = 512 << 20, 2_000


@dataclass
class Order:
    """One language's statistics of one order: packed context and symbol with bits, packed context with escape bits."""

    seen: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.seen.nbytes + self.bits.nbytes + self.contexts.nbytes + self.escape.nbytes


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key stands in sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


@dataclass
class Model:
    """``langs``, and for each its statistics of order 0 to ORDER."""

    langs: list[str]
    trees: list[list[Order]]

    @property
    def nbytes(self) -> int:
        return sum(o.nbytes for tree in self.trees for o in tree)

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each packed gram's last byte, (grams, languages)."""
        out = np.zeros((len(grams), len(self.langs)))
        for j, tree in enumerate(self.trees):
            open_, cost = np.arange(len(grams)), np.zeros(len(grams))
            for k in range(ORDER, -1, -1):
                if not len(open_):
                    break
                order, asked = tree[k], grams[open_] % 257 ** (k + 1)
                at, hit = _find(order.seen, asked)
                cost[open_[hit]] += order.bits[at[hit]]
                open_, asked = open_[~hit], asked[~hit]
                at, known = _find(order.contexts, asked // 257)
                cost[open_[known]] += order.escape[at[known]]
            cost[open_] += 8  # the uniform order over the 256 bytes
            out[:, j] = cost
        return out

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length in bits of each text under each language, in pieces of bounded memory."""
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        for start in range(0, len(raw), SLICE_BYTES):
            end, lead = min(len(raw), start + SLICE_BYTES), min(start, ORDER)
            cut = np.clip(offsets, start, end) - start
            grams, where = np.unique(_grams(raw[start - lead : end], offsets - start + lead)[lead:], return_inverse=True)
            costs = self.costs(grams)
            full = np.flatnonzero(np.diff(cut))
            for j in range(len(self.langs)):  # one language at a time: a column of the piece's size
                total[full, j] += np.add.reduceat(costs[where, j], cut[full])
        return total


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, packed; a context byte before the text's start packs as 256.

    ``offsets`` may begin before ``raw`` and end behind it, where that is a part of the texts.
    """
    at = np.arange(len(raw))
    at = at - offsets[np.searchsorted(offsets, at, "right") - 1]
    packed = np.zeros(len(raw), np.int64)
    for k in range(ORDER, 0, -1):
        before = np.full(len(raw), 256, np.int64)
        before[k:] = raw[:-k]
        packed = packed * 257 + np.where(at >= k, before, 256)
    return packed * 257 + raw


def build(langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
    """The model from counts of packed grams by language number."""
    trees = []
    for j in range(len(langs)):
        own, n = gram[lang == j], count[lang == j].astype(float)
        tree: list[Order] = []
        chance = np.zeros(0)  # of the seen symbols, one order below
        for k in range(ORDER + 1):
            seen, at = np.unique(own % 257 ** (k + 1), return_inverse=True)
            counts = np.bincount(at, n, len(seen))
            contexts, at = np.unique(seen // 257, return_inverse=True)
            total, kinds = np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))
            # What the symbols seen here have one order below; all else there is left to the escape.
            below = np.full(len(seen), 1 / 256) if k == 0 else chance[_find(tree[k - 1].seen, seen % 257**k)[0]]
            left = 1 - np.bincount(at, below, len(contexts))
            whole = kinds == 256  # nothing to escape to
            chance = counts / np.where(whole, total, total + kinds)[at]
            escape = np.where(whole, 0.0, -np.log2(kinds / (total + kinds) / np.where(whole, 1.0, left)))
            tree.append(Order(seen, -np.log2(chance).astype(np.float32), contexts, escape.astype(np.float32)))
        trees.append(tree)
    return Model(list(langs), trees)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_per_lang: int = 1500) -> Model:
    """Learns from about ``sample_per_lang`` texts of each language (all, where there are fewer).

    The sample is the rows with the smallest hashes of their key, by a threshold from the counts: the model
    stays bounded, whatever the corpus holds.  Rows with null text or language teach nothing.  Without any
    usable row the model knows no language and ``predict`` answers ``und``.  Its size is checked, as that of the
    statistics is before they are gathered: more than MOST_BYTES or MOST_LANGS raise an error.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(key_col).cast("string")), F.lit(1 << 20)).alias("at")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages in {lang_col}")
    langs = sorted(counts)
    if not langs:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1, sample_per_lang / counts[lang]) * (1 << 20)))])
    sample = rows.where(F.col("at") <= share[F.col("lang")])
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        for batch in slices(batches, "text"):
            names = np.array([number[x] for x in batch.column(0).to_pylist()])
            raw, offsets = text_bytes(batch.column(1))
            owner = np.repeat(names, np.diff(offsets))
            both, n = np.unique(_grams(raw, offsets) * len(langs) + owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both // len(langs)), pa.array((both % len(langs)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["gram", "l", "n"])

    scratch = Scratch(docs.sparkSession, "language")
    got = map_arrow(sample.select("lang", "text"), count, "gram long, l int, n long").groupBy("gram", "l").agg(F.sum("n").alias("n"))
    got = scratch.save(got, "grams")
    if 40 * got.count() > MOST_BYTES:  # an entry of each order at most
        raise ValueError("the statistics are too many: lower sample_per_lang")
    got = got.toPandas().sort_values(["l", "gram"])
    scratch.drop()
    return build(langs, got["l"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """Returns id_col, lang_pred, score (0 to 1: the language's share of the posterior), then carried columns.

    ``und`` with score 0 if the text is null or has no letter, or the model knows no language.  Ties (equal code
    lengths) go to the first language in order of name.  Texts are scored whole, in pieces of bounded memory.  Carried
    columns may not be named lang_pred or score.
    """
    keys = [id_col, *carry]
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # MOST_BYTES at most, see fit
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys) + ", lang_pred string, score double"

    def run(batches):
        m = cloudpickle.loads(held.value)
        for batch in slices(batches, text_col):
            text = batch.column(len(keys))
            raw, offsets = text_bytes(text)
            bits = m.bits(raw, offsets)
            letters = np.array([any(map(str.isalpha, t or "")) for t in text.to_pylist()])
            if m.langs:
                best = bits.argmin(1)
                score = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
                lang = [m.langs[b] if has else "und" for b, has in zip(best, letters, strict=True)]
            else:
                lang, score, letters = ["und"] * len(text), np.zeros(len(text)), np.zeros(len(text), bool)
            out = [batch.column(i) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))], names=[*keys, "lang_pred", "score"])

    return map_arrow(docs.select(*keys, text_col), run, schema)
