"""Inserts, updates, deletes and upserts as transforms from a table's rows to its rows afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.predicates import Predicate, holds


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _assigned(df: DataFrame, changes: Mapping[str, Any]) -> dict[str, Column]:
    unknown = set(changes) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return {name: _value(v).cast(df.schema[name].dataType) for name, v in changes.items()}


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Missing columns are null; further ones an error."""
    if extra := set(rows.columns) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(extra)}")
    return df.unionByName(rows.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns if c in rows.columns)), allowMissingColumns=True).select(*df.columns)


def update(df: DataFrame, changes: Mapping[str, Any], where: Predicate | None = None) -> DataFrame:
    """Changes see the old row; rows where the predicate is false or null stay."""
    new, hit = _assigned(df, changes), holds(where)
    return df.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def update_returning(df: DataFrame, changes: Mapping[str, Any], where: Predicate | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """The changed rows, after the change."""
    new = _assigned(df, changes)
    return df.where(holds(where)).select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns)).select(*(columns or df.columns))


def delete(df: DataFrame, where: Predicate | None = None) -> DataFrame:
    """Rows stay where the predicate is false or null."""
    return df.where(~holds(where))


def delete_returning(df: DataFrame, where: Predicate | None = None, columns: Sequence[str] = ()) -> DataFrame:
    return df.where(holds(where)).select(*(columns or df.columns))


def once(rows: DataFrame, keys: Sequence[str], several: str | None = None) -> DataFrame:
    """Rows with each key once (keys with a null repeat nothing): an error if a key comes again, or ``several`` = 'first'."""
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    if several == "first":
        return rows.where(whole).dropDuplicates(list(keys)).unionByName(rows.where(~whole))
    again = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    said = F.raise_error(F.lit(f"a row can't be changed twice: several new rows have the same {', '.join(keys)}")).cast("boolean")
    return rows.withColumn("__again", again).where(F.when(whole & F.col("__again"), said).otherwise(F.lit(True))).drop("__again")


def upsert(df: DataFrame, rows: DataFrame, keys: Sequence[str], changes: Mapping[str, Any] | None = None) -> DataFrame:
    """Inserts rows; one whose keys exist changes that row instead (ON CONFLICT DO UPDATE).

    ``changes`` gives values as columns over the old row's names and the new row's as ``new.<name>``; without
    it the new row's values replace the old ones.  Keys with a null meet nothing: old rows stay, new ones are added.
    Several new rows of one key are an error, but with empty ``changes`` (DO NOTHING) one of them is added.  One full join on
    the keys, so one shuffle of either side, which the check of the keys shares.
    """
    rows = once(rows, keys, "first" if changes is not None and not changes else None)
    old, new = df.withColumn("__old", F.lit(True)).alias("old"), rows.withColumn("__new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    there, given = F.col("old.__old").isNotNull(), F.col("new.__new").isNotNull()
    out = []
    for c in df.columns:
        fresh = F.col(f"new.{c}").cast(df.schema[c].dataType) if c in rows.columns else F.lit(None).cast(df.schema[c].dataType)
        if changes is None:
            changed = fresh if c in rows.columns and c not in keys else F.col(f"old.{c}")
        else:
            changed = _value(changes[c]).cast(df.schema[c].dataType) if c in changes else F.col(f"old.{c}")
        out.append(F.when(there & given, changed).when(there, F.col(f"old.{c}")).otherwise(fresh).alias(c))
    return old.join(new, on, "full_outer").select(*out)
