"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit (a character inserted, deleted or replaced) exactly if deleting one character from
one of them, or from each at the same place, gives the same string.  All such variants are emitted as hashed keys
and equal keys (96 bits of hash) meet; within a key only the earliest line matters, so a key's group is a minimum, not all pairs.
The edit distance of each pair so found is verified on the lines themselves, and the earliest line stays.

An edit leaves one half of a line as it is.  So a line's variants are emitted only for a half beside which the
other half, of the same length, also stands in another line.  The halves' keys are counted first and those met
in several lines are marked in a bitmap of fixed size: a full bitmap costs variants, never a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm._common import Scratch, join_spread, map_arrow, mix, slices

_ODD = 0x9E3779B97F4A7C55
_BACK = np.uint64(pow(_ODD, -1, 1 << 64))


def lines(text: str) -> list[str]:
    """Lines without blanks, tabs and carriage returns at their ends."""
    return [x.strip(" \t\r") for x in text.split("\n")]


def line_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def half_keys(line: str) -> Iterator[tuple[int, int, int, int]]:
    """(key, role, start, end): the rest of the line beside [start, end), for a line as the longer (role 0) or,
    without a range, as the shorter of two (role 1).  Lines of one key have equal rests and lengths."""
    n = len(line)
    for role, size in ((0, n), (1, n + 1)):
        mid = size // 2
        for half, rest, start, end in ((0, line[n - (size - mid) :], 0, mid), (1, line[:mid], mid, size)):
            key = xxhash.xxh3_64_intdigest(rest.encode("utf-8", "surrogatepass"), seed=2 * size + half)
            yield key, role, start, end if role == 0 else start


_ODD2 = 0xD6E8FEB86659FD93
_BACK2 = np.uint64(pow(_ODD2, -1, 1 << 64))


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    power = np.full(n, base, np.uint64)
    power[:1] = 1
    return np.multiply.accumulate(power)


def deletions(line: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes, of 64 and 32 bits, of the line without the character at each place of [start, end)."""
    c, out = _codes(line), []
    for base, back in ((_ODD, _BACK), (_ODD2, _BACK2)):
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * _powers(len(c), base), dtype=np.uint64)])
        out.append(mix((before[start:end] + (before[-1] - before[start + 1 : end + 1]) * back) ^ np.uint64(len(c) - 1)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def whole(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the line as a variant that another line could have."""
    c = _codes(line)
    both = [mix(np.array([(c * _powers(len(c), base)).sum(dtype=np.uint64)]) ^ np.uint64(len(c))) for base in (_ODD, _ODD2)]
    return both[0], (both[1] >> np.uint64(32)).astype(np.uint32)


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most parts two lines; in linear time, however long they are."""
    if abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))  # the length of the common beginning, by halving
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = 20, bits: int = 27, scratch: Scratch | None = None) -> DataFrame:
    """The lines to drop: id (0 for null), row_key, place (line numbers from 0).

    A line goes if an earlier one (by id, nulls last, then row and place) is the same, or if both have ``least``
    code points and differ by one edit; the earlier line counts whether it goes itself or not.  Blank lines
    neither go nor count.  Rows that repeat id and text are one document.  Shorter lines than ``least`` go only if
    equal: a character more or less makes another word of them.

    Rows are known by id and a 64-bit hash of id and text, lines by 128 bits, variants by 96 bits and their place.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    # Nulls last: the order is (id is null, id, row, place), and all four fit a struct that min() compares.
    source = docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), _row_key(id_col, text_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = "struct<none: boolean, id: bigint, row: bigint, place: int>"

    def hashes(batches):
        for batch in slices(batches, "text"):
            at, place, made = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for j, line in enumerate(lines(text)):
                    if line:
                        at.append(i)
                        place.append(j)
                        made.append(line_hash(line))
            took = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), batch.column(2).take(took), pa.array(place, pa.int32()), pa.array(made, pa.binary())], names=["none", "id", "row", "place", "h"])

    all_lines = map_arrow(source, hashes, "none boolean, id long, row long, place int, h binary")
    seen = all_lines.groupBy("h").agg(F.min(F.struct("none", "id", "row", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.save(seen.where("n > 1"), "repeated")

    def keys(batches):
        for batch in slices(batches, "text"):
            met: set[str] = set()
            key, own = [], []
            for text in batch.column(3).to_pylist():
                met.update(x for x in lines(text) if len(x) >= least)
            for line in met:
                h = int.from_bytes(line_hash(line)[:8], "little", signed=True)
                for k, _, _, _ in half_keys(line):
                    key.append(k)
                    own.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(own, pa.int64())], names=["key", "h"])

    shared = map_arrow(source, keys, "key long, h long").groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    slots = shared.select(F.pmod("key", F.lit(1 << bits)).alias("slot"))
    marked = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("mask")).toPandas()
    bitmap = np.zeros(max(1, 1 << (bits - 6)), np.int64)  # 2 ** bits bits: 16 MB by default
    bitmap[marked["word"].to_numpy(np.int64)] = marked["mask"].to_numpy(np.int64)
    held = spark.sparkContext.broadcast(cloudpickle.dumps(bitmap))

    def variants(batches):
        words = cloudpickle.loads(held.value).view(np.uint64)
        size = (len(words) << 6) - 1

        def several(key: int) -> bool:
            at = key & size
            return bool(int(words[at >> 6]) >> (at & 63) & 1)

        for batch in slices(batches, "text"):
            first: dict[str, tuple] = {}
            for none, i, row, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                for j, line in enumerate(lines(text)):
                    if len(line) >= least:
                        at = (none, i, row, j)
                        if line not in first or at < first[line]:
                            first[line] = at
            for line, at in first.items():
                hits = [(role, a, b) for k, role, a, b in half_keys(line) if several(k)]
                if not hits:
                    continue
                made = [(*deletions(line, a, b), np.arange(a, b, dtype=np.int32)) for role, a, b in hits if role == 0]
                if any(role == 1 for role, _, _ in hits):
                    made.append((*whole(line), np.array([-1], np.int32)))
                v, w, place = (np.concatenate([x[i] for x in made]) for i in range(3))
                n = len(v)
                h = line_hash(line)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.view(np.int64)), pa.array(w.view(np.int32)), pa.array(np.full(n, int.from_bytes(h[:8], "little", signed=True), np.int64)), pa.array(place), pa.array([h] * n, pa.binary()), pa.StructArray.from_arrays([pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array([at[2]] * n, pa.int64()), pa.array([at[3]] * n, pa.int32())], names=["none", "id", "row", "place"])],
                    names=["v", "w", "line", "at", "h", "pos"],
                )

    emitted = scratch.save(map_arrow(source, variants, f"v long, w int, line long, at int, h binary, pos {order}"), "variants")
    held.destroy()
    # Most variants stand alone: those of several lines are found by their hashes, then looked at as a whole.
    several_lines = emitted.groupBy("v").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("v")
    emitted = emitted.join(scratch.save(several_lines, "several"), "v", "left_semi")
    # Each slice of texts emits a line of its own: one row for each line and variant stays.
    emitted = scratch.save(emitted.groupBy("v", "w", "at", "h").agg(F.min("pos").alias("pos")), "met")
    scratch.drop("variants", "several")
    # Replaced characters: equal variants with the same place; each line meets the earliest of them.
    early = emitted.where("at >= 0").groupBy("v", "w", "at").agg(F.min(F.struct("pos", "h")).alias("e"))
    swapped = emitted.join(early, ["v", "w", "at"]).where("h <> e.h").select("h", "pos", F.col("e.h").alias("h0"), F.col("e.pos").alias("pos0"))
    # Inserted or deleted characters: a line that is another's variant.
    alone = emitted.where("at = -1").select("v", "w", F.col("h").alias("hs"), F.col("pos").alias("ps"))
    met = emitted.where("at >= 0").join(alone, ["v", "w"]).where("h <> hs").select("h", "pos", "hs", "ps")
    later = met.where("pos > ps").select("h", "pos", F.col("hs").alias("h0"), F.col("ps").alias("pos0"))
    sooner = met.where("pos < ps").groupBy("hs").agg(F.min(F.struct("pos", "h")).alias("e"), F.min("ps").alias("ps")).select(F.col("hs").alias("h"), F.col("ps").alias("pos"), F.col("e.h").alias("h0"), F.col("e.pos").alias("pos0"))
    pairs = swapped.unionByName(later).unionByName(sooner).groupBy("h").agg(F.min(F.struct("pos0", "h0")).alias("e"), F.min("pos").alias("pos"))
    pairs = scratch.save(pairs.select("h", "pos", F.col("e.h0").alias("h0"), F.col("e.pos0").alias("pos0")), "pairs")
    scratch.drop("met")

    # The two lines themselves, for the distance.
    wanted = pairs.select("pos").union(pairs.select("pos0")).distinct().select("pos.id", "pos.row", "pos.place").groupBy("id", "row").agg(F.collect_set("place").alias("places"))
    texts = source.join(scratch.save(wanted, "wanted"), ["id", "row"]).select("id", "row", F.explode("places").alias("place"), "text")
    texts = texts.select("id", "row", "place", F.trim(F.element_at(F.split("text", "\n", -1), F.col("place") + 1), F.lit(" \t\r")).alias("line")).dropDuplicates(["id", "row", "place"])
    texts = scratch.save(texts, "texts")
    both = (
        pairs.select("h", *(F.col(f"pos.{c}").alias(c) for c in ("id", "row", "place")), *(F.col(f"pos0.{c}").alias(f"{c}0") for c in ("id", "row", "place")), "pos0")
        .join(texts, ["id", "row", "place"])
        .join(texts.select(*(F.col(c).alias(f"{c}0") for c in ("id", "row", "place", "line"))), ["id0", "row0", "place0"])
        .select("h", F.col("pos0").alias("near"), "line", "line0")
    )

    def verified(batches):
        for batch in batches:
            fits = [within_one(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["h", "near"]).filter(pa.array(fits, pa.bool_()))

    near = map_arrow(both, verified, f"h binary, near {order}")
    # A line's earliest kin: the same line's first place, or a near line's.
    near = scratch.save(near, "near")
    scratch.drop("pairs", "wanted", "texts")
    kin = scratch.save(repeated.join(near, "h", "full_outer").select("h", F.least("first", "near").alias("kin"), F.coalesce("n", F.lit(1)).alias("n")), "kin")
    scratch.drop("repeated", "near")
    # Lines of more than a 4 * P-th of the repeated places (4 * P lines at most) are dealt out, not joined by key.
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = kin.agg(F.sum("n").alias("total"))
    hot = kin.crossJoin(F.broadcast(total)).where(F.col("n") * most > F.col("total")).select("h")  # one row beside all
    here = F.struct("none", "id", "row", "place")
    met = join_spread(all_lines, kin.select("h", "kin"), "h", hot, F.to_binary(F.hex(F.xxhash64("row", "place")), F.lit("hex")))
    gone = met.where(here > F.col("kin"))
    gone = scratch.save(gone.select("id", "row", "place").distinct(), "gone")
    scratch.drop("kin")
    return gone.select("id", F.col("row").alias("row_key"), "place")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_emptied: bool = False, count: bool = False, **options) -> DataFrame:
    """``docs``, all columns, with the text's repeated and nearly repeated lines dropped (see dropped_lines).

    Other lines stay as they are, in order.  Documents that lose all of their text go, unless ``keep_emptied``;
    documents that had none, and those without repeated lines, stay untouched.  ``count`` adds n_lines (not
    blank) and n_dropped.  Nulls may stand in any column; a null text stays null.  Columns may have any names but
    those that begin with ``__granary``.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = dropped_lines(docs, id_col, text_col, scratch=scratch, **options)
    places = gone.groupBy("id", "row_key").agg(F.collect_set("place").alias("__granary_places")).select(F.col("id").alias("__granary_id"), F.col("row_key").alias("__granary_row"), "__granary_places")
    places = scratch.save(places, "places")
    scratch.drop("gone")
    at = docs.columns.index(text_col)
    named = docs.withColumns({"__granary_id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__granary_row": _row_key(id_col, text_col)})
    joined = named.join(places, ["__granary_id", "__granary_row"], "left").select(*docs.columns, "__granary_places")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += ", n_lines long, n_dropped long" * count

    def run(batches):
        for batch in slices(batches, text_col):
            texts, places = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out, keep, n_lines, n_dropped = [], [], [], []
            for text, drop in zip(texts, places, strict=True):
                if drop:
                    drop = set(drop)
                    left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                    keep.append(keep_emptied or bool(left.strip()))
                    out.append(left if left.strip() else "")
                else:
                    keep.append(True)
                    out.append(text)
                if count:
                    n_lines.append(sum(map(bool, lines(text or ""))))
                    n_dropped.append(len(drop or ()))
            columns = [batch.column(i) if i != at else pa.array(out, batch.schema.field(at).type) for i in range(batch.num_columns - 1)]
            names = list(batch.schema.names[:-1])
            if count:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                names += ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return map_arrow(joined, run, schema)
