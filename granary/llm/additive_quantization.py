"""Approximate nearest neighbours by additive quantisation, for the largest inner product.

A vector is the sum of one full-dimensional codeword from each of M codebooks.  Codebooks are fitted on the
residuals of a bounded sample and refined by least squares; vectors are encoded by beam search over partial sums,
with their norm and their code's norm stored beside the code.  A query's inner products with all codewords form a
look-up table: a vector's score is the sum of M entries, scaled by the stored norms.  The best candidates are
ranked again by exact inner products in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Scratch, map_arrow


@dataclass
class Codebooks:
    words: np.ndarray  # (M, K, d) float32

    def __post_init__(self):
        m, k, d = self.words.shape
        flat = self.words.reshape(m * k, d)
        self.norms = (flat**2).sum(1).reshape(m, k)

    def encode(self, x: np.ndarray, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, M) uint8 of float32 rows by beam search, and the squared norms of their sums."""
        n, (m, k, d) = len(x), self.words.shape
        residual = x[:, None, :]  # (n, beams, d)
        codes = np.zeros((n, 1, 0), np.uint8)
        error = np.zeros((n, 1), np.float32)
        for book, norm in zip(self.words, self.norms, strict=True):
            b = residual.shape[1]
            # |r - c|^2 = |r|^2 - 2 r.c + |c|^2
            cost = (error[:, :, None] - 2 * (residual.reshape(n * b, d) @ book.T).reshape(n, b, k) + norm).reshape(n, b * k)
            keep = min(beam, b * k)
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < b * k else np.tile(np.arange(b * k), (n, 1))
            row = np.arange(n)[:, None]
            error = cost[row, best]
            parent, word = best // k, best % k
            codes = np.concatenate([codes[row, parent], word[:, :, None].astype(np.uint8)], 2)
            residual = residual[row, parent] - book[word]
        first = error.argmin(1)
        codes = codes[np.arange(n), first]
        return codes, (self.decode(codes) ** 2).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.words.shape[2]), np.float32)
        for m in range(self.words.shape[0]):
            out += self.words[m][codes[:, m]]
        return out


def train(x: np.ndarray, books: int = 16, words: int = 256, rounds: int = 8, refits: int = 1, seed: int = 7) -> Codebooks:
    """Residual k-means for each codebook in turn, then least squares for all codebooks at the beam's codes."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    k = min(words, n)
    made = np.zeros((books, k, d), np.float32)
    residual = x.astype(np.float32).copy()
    for m in range(books):
        centre = residual[rng.choice(n, k, replace=False)].copy()
        for _ in range(rounds):
            near = np.argmax(residual @ centre.T - 0.5 * (centre**2).sum(1), 1)
            count = np.bincount(near, minlength=k)
            for j in range(d):
                centre[:, j] = np.where(count > 0, np.bincount(near, residual[:, j], k) / np.maximum(count, 1), centre[:, j])
        near = np.argmax(residual @ centre.T - 0.5 * (centre**2).sum(1), 1)
        made[m] = centre
        residual -= centre[near]
    found = Codebooks(made)
    for _ in range(refits):
        codes, _ = found.encode(x, 4)
        # Normal equations of one-hot codes, a little ridge towards the present words.
        at = codes.astype(np.int64) + np.arange(books) * k
        gram = np.zeros((books * k, books * k), np.float32)
        for m in range(books):
            for o in range(books):
                gram[m * k : (m + 1) * k, o * k : (o + 1) * k] = np.bincount(codes[:, m].astype(np.int64) * k + codes[:, o], minlength=k * k).reshape(k, k)
        right = np.zeros((books * k, d), np.float32)
        for j in range(d):
            right[:, j] = sum(np.bincount(at[:, m], x[:, j], books * k) for m in range(books))
        ridge = np.float32(4)
        gram[np.diag_indices(books * k)] += ridge
        flat = np.linalg.solve(gram, right + ridge * found.words.reshape(books * k, d)).astype(np.float32)
        found = Codebooks(flat.reshape(books, k, d))
    return found


class Best:
    """The best scores of each query so far, by look-up tables of _QUERIES queries at a time."""

    _QUERIES, _CODES = 2_048, 1_024

    def __init__(self, words: np.ndarray, ids: np.ndarray, queries: np.ndarray, most: int):
        self.m, self.k, d = words.shape
        self.flat, self.ids, self.queries, self.most = words.reshape(self.m * self.k, d), ids, queries, most
        self.score = np.full((len(ids), 0), -np.inf, np.float32)
        self.who = np.full((len(ids), 0), -1, np.int64)

    def meet(self, ids: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> None:
        """A page of codes: each query's inner products with all codewords, added up along the codes."""
        codes = codes.reshape(len(ids), self.m).astype(np.int64) + np.arange(self.m) * self.k
        parts = [self._meet(slice(s, s + self._QUERIES), ids, codes, factor) for s in range(0, len(self.ids), self._QUERIES)]
        self.score, self.who = (np.concatenate([x[i] for x in parts]) for i in (0, 1))

    def _meet(self, part: slice, ids: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = np.ascontiguousarray((self.queries[part] @ self.flat.T).T)  # (M * K, queries)
        own, score, who = self.ids[part], self.score[part], self.who[part]
        for start in range(0, len(ids), self._CODES):
            at = slice(start, start + self._CODES)
            new = np.zeros((len(ids[at]), len(own)), np.float32)
            for j in range(self.m):
                new += table[codes[at, j]]
            new *= factor[at, None]
            new[ids[at][:, None] == own] = -np.inf
            score, who = np.concatenate([score, new.T], 1), np.concatenate([who, np.tile(ids[at], (len(own), 1))], 1)
            if score.shape[1] > self.most:
                top = np.argpartition(-score, self.most - 1, axis=1)[:, : self.most]
                score, who = np.take_along_axis(score, top, 1), np.take_along_axis(who, top, 1)
        return score, who

    def found(self):
        for s in range(0, len(self.ids), 256):
            score, who = self.score[s : s + 256], self.who[s : s + 256]
            q, c = np.nonzero(~np.isneginf(score))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[s : s + 256][q]), pa.array(who[q, c]), pa.array(score[q, c].astype(np.float64))], names=["query_id", "vec_id", "near"])


def _good(vector: Column) -> Column:
    """Not null, not empty, finite throughout and not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def search(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, rerank: int = 600,
    books: int = 16, words: int = 256, beam: int = 8, sample_rows: int = 16_000, query_bytes: int = 16 << 20, page: int = 4_096, spread: int = 4,
) -> DataFrame:
    """Each query's ``k`` nearest other rows by inner product: query_id, rank (from 1), vec_id, score.

    ``queries`` selects the query rows; the candidates are all rows but the query's own id.  Nearest first, ties
    to the smaller id; all candidates, if there are fewer.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do null ids, nor vectors of another length than most (of two lengths as
    common, the smaller one counts).  Rows that repeat an id count once (the least vector).

    The codebooks are fitted on ``sample_rows`` rows at most (those with the smallest hashes of their id); all
    rows are encoded.  Queries are dealt into blocks of ``query_bytes`` at most (8 blocks of 256 queries, if there are as
    many); each block meets all codes as pages of ``page`` codes, in ``spread`` tasks; a task keeps the ``rerank`` best
    scores of each query (ties: any).  So a page travels once a block, candidates grow with the queries alone, and what
    a task holds is bounded, whatever the table's size.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "additive")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & _good(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first()["d"]
    empty = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == first).groupBy("id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    rows = scratch.save(rows, "vectors")
    total = rows.count()
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = rows.where(at <= int(min(1.0, sample_rows / total) * (1 << 30))).select("id", "v").toPandas().sort_values("id")
    learnt = np.stack(sample["v"].to_numpy()).astype(np.float32)
    scale = float(np.sqrt((learnt.astype(np.float64) ** 2).sum(1)).max()) or 1.0
    books_ = train(learnt / np.float32(scale), books, words)
    held = spark.sparkContext.broadcast(cloudpickle.dumps((books_.words, scale)))  # books * words * d floats: fixed

    def pages(batches):
        """Pages of codes: ids, codes, scales (stored norm over the code's norm)."""
        book, unit = cloudpickle.loads(held.value)
        book = Codebooks(book)
        for batch in batches:
            for start in range(0, batch.num_rows, page):
                part = batch.slice(start, page)
                x = (part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) / unit).astype(np.float32)
                codes = np.concatenate([book.encode(x[i : i + 512], beam)[0] for i in range(0, len(x), 512)])
                norm, coded = np.sqrt((x**2).sum(1)), np.sqrt((book.decode(codes) ** 2).sum(1))
                factor = (norm / np.maximum(coded, 1e-12)).astype(np.float32)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()]), pa.array([codes.tobytes()]), pa.array([factor.tobytes()]), pa.array([int(ids[0])], pa.int64())], names=["ids", "codes", "factors", "page"])

    coded = scratch.save(map_arrow(rows.select("id", "v"), pages, "ids binary, codes binary, factors binary, page long"), "codes")
    asked = rows.where("is_query").select("id", "v")
    n_asked = asked.count()
    blocks = max(1, -(-n_asked * 8 * first // query_bytes), min(8, n_asked // 256))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    # A block's queries go to each of its tasks, a page to one task of each block.
    sides = (
        asked.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("task"), F.lit(0).alias("side"), "id", "v", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("factors"))
        .unionByName(
            coded.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.pmod(F.xxhash64("page", F.lit(2)), F.lit(spread)).cast("int").alias("task"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "ids", "codes", "factors")
        )
        .repartition(min(1 << 20, blocks * spread), "block", "task")
        .sortWithinPartitions("block", "task", "side", "id")
    )

    def candidates(batches):
        words_, unit = cloudpickle.loads(held.value)
        best, key, asked_ = None, None, ([], [])
        for batch in batches:
            blocks_, tasks, side = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                if key != (blocks_[i], tasks[i]):
                    if best:
                        yield from best.found()
                    best, key, asked_ = None, (blocks_[i], tasks[i]), ([], [])
                if side[i] == 0:
                    asked_[0].append(batch.column(3)[i].as_py())
                    asked_[1].append(np.asarray(batch.column(4)[i].values.to_numpy(zero_copy_only=False), np.float32))
                elif asked_[0]:
                    best = best or Best(words_, np.asarray(asked_[0]), np.stack(asked_[1]) / np.float32(unit), rerank)
                    best.meet(*(np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((5, np.int64), (6, np.uint8), (7, np.float32))))
        if best:
            yield from best.found()

    found = map_arrow(sides, candidates, "query_id long, vec_id long, near double")
    # The best of all tasks of a query: an aggregate keeps them, spread * rerank rows a query at most.
    found = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("near", "vec_id")), asc=False), 1, rerank).alias("best"))
    pairs = found.select("query_id", F.explode("best").alias("b")).select("query_id", F.col("b.vec_id").alias("vec_id"))
    exact = (
        pairs.join(rows.select(F.col("id").alias("vec_id"), F.col("v").alias("x")), "vec_id")
        .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        .select("query_id", "vec_id", F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("score"))
    )
    ranked = exact.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
