"""Constraints as queries: each returns what breaks it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that stand in several rows; a key with a null repeats nothing."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.where(whole).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def failing_rows(df: DataFrame, check: str) -> DataFrame:
    """Rows where the check is false (null passes)."""
    return df.where(~F.coalesce(F.expr(check), F.lit(True)))


def orphans(df: DataFrame, columns: Sequence[str], other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't null and isn't in the other table."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    there = other.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)))
    return df.where(whole).join(there, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)], "left_anti")
