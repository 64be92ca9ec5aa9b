"""Shared plumbing of the training-data operators: scratch tables, Arrow slices, hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds in vectorised form at a time (one longer text is a slice alone).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.  Where none is set, a folder of our own if driver and
    executors are one process, and an error on a cluster: executors can't see the driver's disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables in the shared checkpoint folder.  They cut lineage and outlive lost executors."""

    #: Folders made since the outermost ``temporaries`` block began; None outside of one.
    made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if Scratch.made is not None:
            Scratch.made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads; without names, all."""
        jvm = self.spark.sparkContext._jvm
        for path in [f"{self.root}/{name}" for name in names] or [self.root]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporaries():
    """Deletes, at its end, the scratch tables that operators make inside.  For steps whose results are saved."""
    before, Scratch.made = Scratch.made, []
    try:
        yield
    finally:
        held, Scratch.made = Scratch.made, before
        for scratch in held:
            scratch.drop()


def parts_for(df: DataFrame, column: str, size: int = 32 << 20) -> int:
    """Partitions of about ``size`` bytes of a text column for a shuffle; the session's shuffle partitions at least."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of more than a 4 * P-th of all rows, P being the shuffle partitions: 4 * P keys at most."""
    most = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("__n") * most > F.col("__all")).select(key)  # one row beside all


def join_spread(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: Column) -> DataFrame:
    """``big`` with the columns of ``small`` (one row a key) where there is one, no task getting all rows of a hot key.

    ``hot`` holds a bounded number of keys (see hot_keys): their rows of ``small`` are broadcast, and rows of
    ``big`` that have met them are dealt out by ``by`` in the join with the rest.
    """
    columns = [c for c in small.columns if c != key]
    held = F.struct(*columns)
    first = small.join(F.broadcast(hot), key, "left_semi").select(key, held.alias("__hot"))
    rest = small.join(F.broadcast(hot), key, "left_anti").select(F.col(key).alias("__key"), held.alias("__rest"))
    met = big.join(F.broadcast(first), key, "left")
    met = met.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(by))
    found = F.coalesce("__hot", "__rest")
    out = met.join(rest, "__key", "left").withColumn("__found", found)
    return out.select(*big.columns, *(F.col(f"__found.{c}").alias(c) for c in columns))


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Gives freed memory back: a worker is used again, and the executor's next task may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of 4 MB (unless the session sets another size); memory is released after each task."""
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(4 << 20))

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(trimmed, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds about ``size`` bytes of the text column, one row at least."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        text = batch.column(i)
        if pa.types.is_large_string(text.type):
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        else:
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else [0]
        start = 0
        while start < len(text):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; nulls count as empty."""
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if text.null_count:
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes 0x09-0x0D and 0x20 part words; A-Z count as a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C55


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, in order, and the word offsets of the texts.

    A long text is hashed in pieces of ``SLICE_BYTES``; a word that a cut parts is put together again.
    """
    if len(raw) <= SLICE_BYTES or len(offsets) != 2:
        values, starts = _word_sums(raw, offsets, seed)
        return mix(values), np.searchsorted(starts, offsets).astype(np.int64)
    made, length = [], 0  # length: of the word that the last piece left open
    for start in range(0, len(raw), SLICE_BYTES):
        piece = raw[start : start + SLICE_BYTES]
        values, starts = _word_sums(piece, np.array([0, len(piece)]), seed)
        gaps = _GAP[piece]
        if len(values) and starts[0] == 0 and length:
            made[-1][-1:] += values[:1] * np.uint64(pow(_BASE, length, 1 << 64))
            values = values[1:]
        if len(values):
            made.append(values)
        open_from = len(piece) - (int(gaps[::-1].argmax()) if gaps.any() else len(piece))
        length = len(piece) - open_from + (length if open_from == 0 else 0)
    out = mix(np.concatenate(made)) if made else np.zeros(0, np.uint64)
    return out, np.array([0, len(out)])


def _word_sums(raw: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' polynomials, and where the words start."""
    if len(raw) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_GAP[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), starts
    at = np.arange(len(raw), dtype=np.int64)
    rank = np.cumsum(first) - 1
    place = np.where(word, at - starts[np.maximum(rank, 0)], 0)
    values = (_FOLD[raw].astype(np.uint64) + np.uint64(1 + seed)) * _powers(int(place.max()) + 1)[place]
    values[~word] = 0
    return np.add.reduceat(values, starts), starts


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words; a text with fewer words has its whole sequence as one, without words none.

    Returns the hashes (repeats included) and their text numbers.
    """
    count = np.diff(offsets)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), made)
    if len(doc) == 0:
        return np.zeros(0, np.uint64), doc
    start = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(offsets[:-1], made)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    left = np.repeat(count, made)
    out = np.zeros(len(doc), np.uint64)
    for i in range(width):
        out = out * np.uint64(_BASE) + np.where(i < left, padded[start + i], np.uint64(0))
    return mix(out + np.minimum(left, width).astype(np.uint64)), doc


def shingle_pieces(words: np.ndarray, offsets: np.ndarray, width: int = 5, size: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingle_hashes, of a long single text in several parts."""
    if len(offsets) != 2 or len(words) <= size:
        yield shingle_hashes(words, offsets, width)
        return
    for start in range(0, len(words) - width + 1, size):
        part = words[start : start + size + width - 1]
        yield shingle_hashes(part, np.array([0, len(part)]), width)
