"""Joins by keys, by conditions and by bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[tuple[str, str]]


def equi(left: DataFrame, right: DataFrame, keys: Keys, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Joins on equal keys (nulls match nothing).  Spark picks the strategy, unless a hint is given.

    A broadcast hint is for a side whose size the caller knows.
    """
    right = right.hint(strategy) if strategy else right
    return left.join(right, [left[a] == right[b] for a, b in keys], how)


def chain(frames: Sequence[DataFrame], keys: Sequence[Keys]) -> DataFrame:
    """Joins frames from left to right; the cost-based optimiser may reorder them."""
    out = frames[0]
    for frame, on in zip(frames[1:], keys, strict=True):
        out = out.join(frame, [F.col(a) == F.col(b) for a, b in on])
    return out


def theta(left: DataFrame, right: DataFrame, condition: str | Column, how: str = "inner") -> DataFrame:
    """Joins on any condition.  Its equalities become keys; a condition without any pairs all rows with all."""
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, how)


def band(left: DataFrame, right: DataFrame, start: str, value: str, width: float) -> DataFrame:
    """Rows with start <= value < start + width.

    Values are cut into buckets of the band's width: a left row's band touches two of them, so the join has an
    equality and needs no product of all rows.
    """
    if width <= 0:
        raise ValueError("a band needs a width")
    bucket = F.floor(F.col(start) / width).cast("bigint")
    touched = left.withColumn("__bucket", F.explode(F.array(bucket, bucket + 1)))
    placed = right.withColumn("__at", F.floor(F.col(value) / width).cast("bigint"))
    inside = reduce(lambda a, b: a & b, [F.col("__bucket") == F.col("__at"), F.col(value) >= F.col(start), F.col(value) < F.col(start) + width])
    return touched.join(placed, inside).drop("__bucket", "__at")
