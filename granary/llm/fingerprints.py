"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle of five words is hashed once; the hash's high bits choose one of 512 bins, and a bin keeps its
smallest hash.  An empty bin borrows from the first non-empty bin of its own fixed random probe order (optimal
densification: the order depends on the bin, not on the set).  Four low bits of each bin are stored, so a hex
digit is a bin.  The share of equal digits is corrected for the chance 1/16 that different values agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._common import map_arrow, mix, parts_for, shingle_pieces, slices, text_bytes, word_hashes

BINS, BITS = 512, 4
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probe_ranks() -> np.ndarray:
    """rank[i, j]: when bin i tries bin j."""
    keys = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x51ED270B)).reshape(BINS, BINS)
    return keys.argsort(1).argsort(1).astype(np.int16)


_RANKS = _probe_ranks()
_ORDER = _RANKS.argsort(1).astype(np.int16)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> np.ndarray:
    """The bins' low bits of each text, (texts, BINS) uint8; 255 throughout for a text without words."""
    n = len(offsets) - 1
    low = np.full(n * BINS, _NONE)
    for h, doc in shingle_pieces(*word_hashes(raw, offsets), width):
        np.minimum.at(low, doc * BINS + (h >> np.uint64(55)).astype(np.int64), h & np.uint64((1 << 55) - 1))
    low = low.reshape(n, BINS)
    empty = low == _NONE
    filled = BINS - empty.sum(1)
    out = (low & np.uint64(15)).astype(np.uint8)
    bins = np.arange(BINS)
    for i in np.flatnonzero((filled > 0) & (filled <= 48)):
        have = np.flatnonzero(~empty[i])
        own = have[_RANKS[:, have].argmin(1)]
        own[have] = have
        out[i] = out[i, own]
    row, at = np.nonzero(empty & (filled > 48)[:, None])
    for step in range(BINS):
        if not len(row):
            break
        other = _ORDER[bins[at], step]
        hit = ~empty[row, other]
        out[row[hit], at[hit]] = (low[row[hit], other[hit]] & np.uint64(15)).astype(np.uint8)
        row, at = row[~hit], at[~hit]
    out[filled == 0] = 255
    return out


def packed(bins: np.ndarray) -> list[str]:
    """One hex digit a bin; an empty string for a text without words."""
    return ["" if row[0] == 255 else _DIGITS[row].tobytes().decode() for row in bins]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of shingle sets, corrected for chance agreement; 1 if both have no words, 0 if one."""
    chance = 1 / (1 << BITS)
    near = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    none_a, none_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(none_a & none_b, 1.0, np.where(none_a | none_b, 0.0, near))


def _fingerprints_of(texts: list[str]) -> np.ndarray:
    return fingerprints(*text_bytes(pa.array(texts, pa.large_string())))


def fingerprint(docs: DataFrame, text_col: str = "text", *carry: str) -> DataFrame:
    """Returns the carried columns and ``fingerprint`` of every whole text (null: empty, fingerprint '')."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "fingerprint string"])

    def run(batches):
        for batch in slices(batches, text_col):
            made = packed(fingerprints(*text_bytes(batch.column(len(carry)))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(made, pa.string())], names=[*carry, "fingerprint"])

    return map_arrow(docs.select(*carry, text_col), run, schema)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text, its edited text and compares it with that and with the next document.

    Documents stand in descending id (integers; nulls last, equal ids by text), in a circle.  The edited text
    has its last floor(n/2) code points replaced by the first as many of the next document.  Returns id_col,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  Null texts are empty;
    a lone document follows itself.

    Texts are shuffled once, to ranges of ids whose bounds come from the ids alone, in partitions of about 32 MB; a
    range's largest document also goes to the range above, where it follows the smallest.  Other columns aren't read.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(lowest))
    parts = parts_for(rows, "text")
    ranges = 4 * parts  # several small ranges a partition even out
    share = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)], F.lit(1.0))
    bounds = np.unique(np.array(rows.agg(F.percentile_approx(key, share, F.lit(max(10_000, 20 * ranges))).alias("b")).first()["b"] or [lowest], np.int64))

    # Twice the range, plus 1 for the copy that goes to the range above (the last one's goes round to the first).
    @F.pandas_udf("array<int>")
    def places(ids):
        own = np.searchsorted(bounds, ids.to_numpy(np.int64))
        own = np.minimum(own, len(bounds) - 1)
        last = bounds[own] == ids.to_numpy(np.int64)
        return type(ids)([[2 * r, 2 * ((r + 1) % len(bounds)) + 1] if e else [2 * r] for r, e in zip(own.tolist(), last.tolist(), strict=True)])

    placed = rows.select("id", "text", F.explode(places(key)).alias("place")).withColumn("range", F.expr("place div 2"))
    dealt = placed.repartition(parts, "range").sortWithinPartitions("range", "place", F.desc_nulls_last("id"), "text")

    def run(batches):
        held = None  # id, text, bins and place of the last row
        for batch in slices(batches, "text"):
            ids, texts, place = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            bins = fingerprints(*text_bytes(batch.column(1)))
            if held is not None:
                ids, texts, place, bins = [held[0], *ids], [held[1], *texts], [held[3], *place], np.vstack([held[2], bins])
            held = (ids[-1], texts[-1], bins[-1:].copy(), place[-1])
            # Rows but copies have their next one in their range: an ordinary row, or the copy after the last.
            own = [i for i in range(len(ids) - 1) if place[i] % 2 == 0]
            if not own:
                continue
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
            new = _fingerprints_of(edited)
            after = np.array(own) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(packed(bins[own]), pa.string()),
                    pa.array(packed(new), pa.string()),
                    pa.array(likeness(bins[own], new)),
                    pa.array(likeness(bins[own], bins[after])),
                ],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(dealt.select("id", "text", "place"), run, schema)
