"""Toxicity: a classifier with counterfactual regularisation.

A logistic model over the presence of words and word beginnings is fitted on labelled texts.  Every labelled sentence that names a group is
also written with the other terms of the same kind, and the squared difference between the two logits, over all
features that the swap changes (words and beginnings), is penalised: the score then follows what is said, not which group is named.
``Model.swaps`` tells how many such sentences there were; without any the penalty changes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Scratch, map_arrow, slices

#: Identity terms by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man"),
    ("women", "men"),
    ("immigrant", "refugee", "foreigner", "migrant"),
    ("immigrants", "refugees", "foreigners", "migrants"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("ausländer", "flüchtling", "einwanderer"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("immigré", "réfugié", "étranger"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
    ("inmigrante", "refugiado", "extranjero"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _marked(met: set[str]) -> set[str]:
    return met | {"^" + w[:4] for w in met} | {"^" + w[:5] for w in met}


def features(text: str | None) -> set[str]:
    """The words of a text and their first four and five letters (marked by ^), for inflected forms."""
    return _marked(words(text))


def changed(met: set[str], term: str, swap: str) -> tuple[set[str], set[str]]:
    """Features that a text of these words loses, and those it gains, where ``swap`` stands for ``term``."""
    near = {w for w in met if w[:4] in (term[:4], swap[:4])} | {term}  # others share no feature with the two
    before, after = _marked(near), _marked(near - {term} | {swap})
    return before - after, after - before


@dataclass
class Model:
    """Weights by feature, a bias, and the number of swapped sentences that the fit has seen."""

    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    swaps: int = 0

    def score(self, text: str | None) -> float:
        w = self.weights
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(w[x] for x in features(text).intersection(w)), -40, 40))))


class Loss:
    """Mean log loss of the texts, plus l2 / 2 * |w|^2, plus ``penalty`` times the mean squared logit difference of swaps.

    rows: feature numbers of each text; swaps: (count, features lost, features gained).  The bias is the last weight.
    """

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, swaps: list[tuple[int, list[int], list[int]]], size: int, penalty: float, l2: float):
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.y, self.size, self.penalty, self.l2 = y, size, penalty / max(len(y), 1), l2
        self.times = np.array([n for n, _, _ in swaps], float)
        self.moved = np.array([x for _, lost, gained in swaps for x in (*lost, *gained)], np.int64)
        self.sign = np.array([x for _, lost, gained in swaps for x in (*[1.0] * len(lost), *[-1.0] * len(gained))])
        self.swap_of = np.repeat(np.arange(len(swaps)), [len(lost) + len(gained) for _, lost, gained in swaps])

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its gradient."""
        n, size = max(len(self.y), 1), self.size
        z = np.bincount(self.owner, w[self.flat], len(self.y)) + w[size]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - self.y) / n
        loss = float((np.logaddexp(0, z) - self.y * z).sum() / n + self.l2 / 2 * (w[:size] ** 2).sum())
        grad = np.append(np.bincount(self.flat, g[self.owner], size) + self.l2 * w[:size], g.sum())
        if len(self.times):
            gap = np.bincount(self.swap_of, self.sign * w[self.moved], len(self.times))
            loss += float(self.penalty * (self.times * gap**2).sum())
            grad[:size] += np.bincount(self.moved, self.sign * (2 * self.penalty * self.times * gap)[self.swap_of], size)
        return loss, grad


def _descend(loss: Loss, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam."""
    w = np.zeros(loss.size + 1)
    rate = loss.y.mean() if len(loss.y) else 0.5
    w[-1] = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, grad = loss.at(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, sample_rows: int = 20_000, chi_square: float = 10.83, least: int = 5, penalty: float = 10.0, l2: float = 1e-3, steps: int = 400, terms=IDENTITY_TERMS) -> Model:
    """Fits on ``sample_rows`` labelled texts at most (about; all, if there are fewer).

    The sample is taken by a hash of the key, so its size and the model's stay bounded at any input.  A key with
    several labels counts as toxic if any says so; null labels and keys teach nothing.  Features are all
    words and beginnings whose presence goes along with the label (by ``chi_square``, at 1 in 1,000), met in ``least``
    sampled texts at least, and the identity terms.  Without labelled rows every score is 0.
    """
    spark = docs.sparkSession
    said = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y"))
    total = said.count()
    if not total:
        return Model(bias=-40.0)
    at = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1 << 30))
    chosen = said.where(at <= int(min(1.0, sample_rows / total) * (1 << 30))).groupBy("key").agg(F.max("y").alias("y"))
    scratch = Scratch(spark, "toxicity")

    def tokens(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(features(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["y", "words"])

    # The sample is bounded by sample_rows: it may be broadcast, and no text is shuffled.
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key").select("y", "text")
    sample = scratch.save(map_arrow(texts, tokens, "y int, words array<string>"), "sample")
    n, pos = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Model(bias=-40.0)
    seen = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    rate = pos / n
    gap = F.col("p") - F.col("c") * rate
    best = seen.where(gap * gap > F.col("c") * (chi_square * rate * (1 - rate))).select("word").collect()  # features of the sample
    swaps = {t: [u for u in kind if u != t] for kind in terms for t in kind}
    index = {w: i for i, w in enumerate(dict.fromkeys([*sorted(r["word"] for r in best), *swaps]))}

    def numbers(batches):
        for batch in batches:
            rows = [sorted(index[w] for w in ws if w in index) for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["y", "at"])

    def swapped(batches):
        from collections import Counter

        met: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in batch.column(1).to_pylist():
                for sentence in _SENTENCE.split((text or "").lower()):
                    said = words(sentence)
                    for t in said.intersection(swaps):
                        for u in swaps[t]:
                            # Features outside the model make no difference (and would make the keys many).
                            lost, gained = (tuple(sorted(index[x] for x in side if x in index)) for side in changed(said, t, u))
                            if lost or gained:
                                met[lost, gained] += 1
        if met:
            pairs = sorted(met)
            yield pa.RecordBatch.from_arrays([*(pa.array([list(p[i]) for p in pairs], pa.list_(pa.int32())) for i in (0, 1)), pa.array([met[p] for p in pairs], pa.int64())], names=["lost", "gained", "n"])

    got = map_arrow(sample, numbers, "y int, at array<int>").toPandas()
    pairs = map_arrow(texts, swapped, "lost array<int>, gained array<int>, n long").groupBy("lost", "gained").agg(F.sum("n").alias("n")).orderBy("lost", "gained").collect()
    scratch.drop("sample")
    rows = [np.asarray(r, np.int64) for r in got["at"]]
    w, bias = _descend(Loss(rows, got["y"].to_numpy(float), [(r["n"], r["lost"], r["gained"]) for r in pairs], len(index), penalty, l2), steps)
    return Model(bias, {x: float(w[i]) for x, i in index.items() if w[i]}, sum(r["n"] for r in pairs))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """Returns id_col, score (0 to 1; null and empty texts get the bias alone), then carried columns.

    Texts are scored whole; repeated rows repeat; equal texts have equal scores, and a score at a threshold counts as
    above it; the model is bounded and goes to the workers with the task.
    """
    keys = [id_col, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys) + ", score double"

    def run(batches):
        for batch in slices(batches, text_col):
            got = [model.score(t) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(got, pa.float64())], names=[*keys, "score"])

    return map_arrow(docs.select(*keys, text_col), run, schema)


def reject(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays below ``threshold``."""
    at = docs.schema.fieldNames().index(text_col)

    def run(batches):
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
