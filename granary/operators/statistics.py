"""Column statistics over whole tables: null share, width, distinct values, common values, histogram bounds."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The columns of stored statistics.
SCHEMA = T.StructType([
    T.StructField("attname", T.StringType()), T.StructField("null_frac", T.DoubleType()), T.StructField("avg_width", T.DoubleType()), T.StructField("n_distinct", T.LongType()),
    T.StructField("most_common_vals", T.StringType()), T.StructField("most_common_freqs", T.StringType()), T.StructField("histogram_bounds", T.StringType()),
])


def width_of(df: DataFrame, name: str) -> Column:
    """Bytes of a value: fixed for numbers, dates and booleans, the length for texts and bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.lit(1)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(F.col(name))
    return F.lit(8)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_live_tup"))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """A row per column: null_frac, avg_width, n_distinct.  One pass over the table.

    Exact distinct counts expand the rows by column before the shuffle; ``approximate`` keeps sketches instead.
    """
    names = list(columns or df.columns)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts = [
        F.struct(
            F.lit(c).alias("attname"),
            F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias("null_frac"),
            F.coalesce(F.avg(F.when(F.col(c).isNotNull(), width_of(df, c))), F.lit(0.0)).cast("double").alias("avg_width"),
            distinct(c).cast("bigint").alias("n_distinct"),
        ).alias(f"_{i}")
        for i, c in enumerate(names)
    ]
    return df.agg(*parts).select(F.inline(F.array(*(f"_{i}" for i in range(len(names))))))


def most_common(df: DataFrame, column: str, top: int = 3) -> DataFrame:
    """The ``top`` most frequent values and their share of all rows that aren't null; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).count()
    best = counts.orderBy(F.desc("count"), "value").limit(top)
    total = counts.agg(F.sum("count").alias("total"))
    return best.crossJoin(F.broadcast(total)).select("value", (F.col("count") / F.col("total")).alias("freq"))  # one row beside few


def counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """attname, value (as text, null where it is), count: one pass over the table for all columns."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("attname"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(each.alias("x")).groupBy("x.attname", "x.value").agg(F.count(F.lit(1)).alias("count"))


def _there() -> Column:
    """Whether a counted value isn't null.  The count is part of the test, so that the filter stays above the counting and all
    that is made of the counts shares one shuffle of them."""
    return F.when(F.col("value").isNotNull(), F.col("count")) > 0


def _last(holds: Callable[[Column], Column], bits: int) -> Column:
    """The greatest number of so many bits for which ``holds`` is true; it must be true of all smaller ones from 1 on."""
    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(bits)))), F.lit(0), lambda n, more: F.when(holds(n + more), n + more).otherwise(n))


#: Cuts of a column on an average, and characters of a cut.
CUTS, KEY = 128, 128


def middles(counts: DataFrame, by: str = "attname", levels: int = 2) -> DataFrame:
    """by, middle: of each group's values that aren't null, with their counts, the one in the middle (number floor(n/2) from 0).

    A group's values are cut into ranges by about CUTS of them, which their hashes choose; what counts is the text behind
    what all begin with.  Running counts over the ranges find the one with the middle; its values are cut in the same way, and
    the values of the range found last are ranked.  The cuts decide how much is ranked, not what is found.  Only a row per group
    (its cuts, its range) goes to all tasks; values stay where they were counted until the last range is known.
    """
    values, place = counts.where(_there()).select(by, "value", "count"), F.floor(F.sum("count") / 2)
    key = F.substring("value", F.col("lead") + 1, F.lit(KEY))
    for _ in range(levels):
        span = values.groupBy(by).agg(place.alias("at"), F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        span = span.select(by, "at", "n", _last(lambda n: F.substring("low", F.lit(1), n) == F.substring("high", F.lit(1), n), 25).alias("lead"))
        chosen = F.shiftrightunsigned(F.xxhash64("value"), 11) * F.col("n").cast("double") < CUTS * 2.0**53
        # the sum keeps the counts in this pass, so that it reads the same shuffle as the others
        cuts = values.select(by, "value", "count").join(F.broadcast(span), by).groupBy(by, "at", "lead").agg(F.collect_set(F.when(chosen, key)).alias("cuts"), F.sum("count").alias("held"))
        cuts = cuts.where("held > 0").select(by, "at", "lead", F.slice(F.array_sort("cuts"), 1, 255).alias("cuts"))
        ranged = values.select(by, "value", "count").join(F.broadcast(cuts), by).withColumn("range", _last(lambda n: F.get("cuts", n - 1) <= key, 8))
        ranges = ranged.groupBy(by, "at", "lead", "range", F.get("cuts", F.col("range") - 1).alias("from"), F.get("cuts", F.col("range")).alias("to")).agg(F.sum("count").alias("held"))
        upto = F.sum("held").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = ranges.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("held") <= F.col("at")))
        found = found.select(by, "lead", "from", "to", (F.col("at") - F.col("upto") + F.col("held")).alias("at"))
        inside = (F.col("from").isNull() | (key >= F.col("from"))) & (F.col("to").isNull() | (key < F.col("to")))
        values, place = values.select(by, "value", "count").join(F.broadcast(found), by).where(inside).select(by, "value", "count", "at"), F.max("at")
    upto = F.sum("count").over(Window.partitionBy(by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("count") <= F.col("at"))).select(by, F.col("value").alias("middle"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """The least, the middle and the greatest value of those that aren't null, as texts in order of text: one row."""
    counts = counted(df, [column])
    ends = counts.groupBy("attname").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.join(middles(counts), "attname", "left").select("low", "middle", "high")


def fixed_widths(df: DataFrame, columns: Sequence[str]) -> dict[str, int | None]:
    """Bytes of each column's values; None where they differ."""
    kinds = {c: df.schema[c].dataType for c in columns}
    return {c: None if isinstance(k, (T.StringType, T.BinaryType)) else 1 if isinstance(k, T.BooleanType) else 8 for c, k in kinds.items()}


def all_stats(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """A row per column: attname, null_frac, avg_width, n_distinct, the most common values with their shares of all that
    aren't null, and the histogram's bounds.  One pass over the table; a column's values meet as counts."""
    return stats_of_counts(counted(df, columns), fixed_widths(df, columns), top)


def stats_of_counts(counts: DataFrame, fixed: Mapping[str, int | None], top: int = 3, wanted: Collection[str] = SCHEMA.names) -> DataFrame:
    """The same from counted values of the columns in ``fixed``; of SCHEMA, attname and what is ``wanted``."""
    there = F.col("value").isNotNull()
    n = F.coalesce(F.sum(F.when(there, F.col("count"))), F.lit(0))
    base = counts.groupBy("attname").agg(
        n.alias("n"), F.sum("count").alias("rows"), F.count("value").alias("n_distinct"), F.sum(F.octet_length("value") * F.col("count")).alias("bytes"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    place = F.row_number().over(Window.partitionBy("attname").orderBy(F.desc("count"), "value"))
    best = counts.where(_there()).withColumn("place", place).where(F.col("place") <= top).groupBy("attname").agg(F.sort_array(F.collect_list(F.struct("place", "value", "count"))).alias("best"))
    named = counts.sparkSession.createDataFrame(list(fixed.items()), "attname string, fixed int")
    whole = named.join(base, "attname", "left")
    if {"most_common_vals", "most_common_freqs"} & {*wanted}:
        whole = whole.join(best, "attname", "left")
    if "histogram_bounds" in wanted:
        whole = whole.join(middles(counts), "attname", "left")
    share = F.transform("best", lambda x: (x["count"] / F.col("n")).cast("string"))
    width = F.when(F.col("n") > 0, F.coalesce(F.col("fixed").cast("double"), F.col("bytes") / F.col("n"))).otherwise(F.lit(0.0))
    text = lambda a: F.concat(F.lit("{"), F.array_join(a, ","), F.lit("}"))
    made = {
        "attname": F.col("attname"), "null_frac": F.coalesce(1 - F.col("n") / F.col("rows"), F.lit(0.0)), "avg_width": width, "n_distinct": F.coalesce("n_distinct", F.lit(0)).cast("bigint"),
        "most_common_vals": text(F.coalesce(F.col("best.value"), F.array())), "most_common_freqs": text(F.coalesce(share, F.array())), "histogram_bounds": text(F.array_compact(F.array("low", "middle", "high"))),
    }
    return whole.select(*(c.alias(k) for k, c in made.items() if k == "attname" or k in wanted))
