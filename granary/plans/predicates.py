"""Predicate trees and their translation to Spark columns, with SQL's three-valued logic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators of the mapping form, e.g. {"age": {"$gt": 20}}.
_MAPPED = {"$eq": "=", "$ne": "!=", "$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<=", "$in": "in", "$between": "between", "$like": "like"}


@dataclass(frozen=True)
class Compare:
    """column op value; op: = != > >= < <= in between like, and 'is null' or 'is not null' without a value."""

    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class And:
    parts: Sequence[Predicate]


@dataclass(frozen=True)
class Or:
    parts: Sequence[Predicate]


@dataclass(frozen=True)
class Not:
    part: Predicate


Predicate = Compare | And | Or | Not | Mapping | Column | str


def _compare(p: Compare) -> Column:
    col, v = F.col(p.column), p.value
    match p.op.lower():
        case "=" | "==":
            return col == F.lit(v)
        case "!=" | "<>":
            return col != F.lit(v)
        case ">":
            return col > F.lit(v)
        case ">=":
            return col >= F.lit(v)
        case "<":
            return col < F.lit(v)
        case "<=":
            return col <= F.lit(v)
        case "in":
            return col.isin(list(v))
        case "between":
            return col.between(*v)
        case "like":
            return col.like(v)
        case "is null":
            return col.isNull()
        case "is not null":
            return col.isNotNull()
    raise ValueError(f"unknown operator: {p.op}")


def _mapping(conditions: Mapping[str, Any]) -> Column:
    """All of the conditions; a plain None asks for null, as in the embedded API."""
    parts: list[Column] = []
    for name, want in conditions.items():
        if isinstance(want, Mapping) and want and all(str(k).startswith("$") for k in want):
            for op, v in want.items():
                if op == "$null":
                    parts.append(F.col(name).isNull() if v else F.col(name).isNotNull())
                elif op in _MAPPED:
                    parts.append(_compare(Compare(name, _MAPPED[op], v)))
                else:
                    raise ValueError(f"unknown operator: {op}")
        else:
            parts.append(F.col(name).isNull() if want is None else F.col(name) == F.lit(want))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def column_of(p: Predicate | None) -> Column:
    """None and empty conjunctions hold for every row."""
    match p:
        case None:
            return F.lit(True)
        case Column():
            return p
        case str():
            return F.expr(p)
        case Compare():
            return _compare(p)
        case And():
            return reduce(lambda a, b: a & b, map(column_of, p.parts), F.lit(True))
        case Or():
            return reduce(lambda a, b: a | b, map(column_of, p.parts), F.lit(False))
        case Not():
            return ~column_of(p.part)
        case Mapping():
            return _mapping(p)
    raise TypeError(f"not a predicate: {p!r}")


def holds(p: Predicate | None) -> Column:
    """True where the predicate is true; false where it is false or null (what UPDATE and DELETE act on)."""
    return F.coalesce(column_of(p).cast("boolean"), F.lit(False))
