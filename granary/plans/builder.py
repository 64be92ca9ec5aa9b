"""Query options and a fluent builder over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.predicates import Predicate, column_of


def order_of(spec: str | Column) -> Column:
    """'name', 'name asc' or 'name desc' with nulls last on the way up and first on the way down."""
    if isinstance(spec, Column):
        return spec
    name, _, way = spec.strip().rpartition(" ")
    if way.lower() not in ("asc", "desc") or not name:
        name, way = spec.strip(), "asc"
    return F.desc_nulls_first(name) if way.lower() == "desc" else F.asc_nulls_last(name)


@dataclass(frozen=True)
class QueryOptions:
    columns: Sequence[str | Column] = ()
    where: Predicate | None = None
    order: Sequence[str | Column] = ()
    limit: int | None = None
    offset: int = 0


def run(df: DataFrame, options: QueryOptions) -> DataFrame:
    """Filter, sort, skip, cut, project: in SQL's order, whatever the index."""
    out = df.where(column_of(options.where)) if options.where is not None else df
    if options.order:
        out = out.orderBy(*map(order_of, options.order))
    if options.offset:
        out = out.offset(options.offset)
    if options.limit is not None:
        out = out.limit(options.limit)
    return out.select(*options.columns) if options.columns else out


def page(df: DataFrame, options: QueryOptions) -> tuple[list[Any], bool]:
    """The rows of one page and whether there are more (one row more is fetched)."""
    if options.limit is None:
        return run(df, options).collect(), False
    rows = run(df, replace(options, limit=options.limit + 1)).collect()
    return rows[: options.limit], len(rows) > options.limit


@dataclass(frozen=True)
class Query:
    """Builds a DataFrame step by step; every step returns a new query."""

    source: DataFrame
    columns: tuple = ()
    conditions: tuple = ()
    groups: tuple = ()
    aggregates: tuple = ()
    group_conditions: tuple = ()
    orders: tuple = ()
    count: int | None = None
    skip: int = 0
    joins: tuple = field(default=())

    def _with(self, **changes) -> Query:
        return replace(self, **changes)

    def select(self, *columns: str | Column) -> Query:
        return self._with(columns=self.columns + columns)

    def where(self, predicate: Predicate) -> Query:
        return self._with(conditions=(*self.conditions, predicate))

    def where_in(self, column: str, values: Sequence[Any]) -> Query:
        return self.where(F.col(column).isin(list(values)))

    def where_null(self, column: str) -> Query:
        return self.where(F.col(column).isNull())

    def where_not_null(self, column: str) -> Query:
        return self.where(F.col(column).isNotNull())

    def join(self, other: DataFrame, on: str | Column | list[str], how: str = "inner") -> Query:
        return self._with(joins=(*self.joins, (other, F.expr(on) if isinstance(on, str) and "=" in on else on, how)))

    def left_join(self, other: DataFrame, on: str | Column | list[str]) -> Query:
        return self.join(other, on, "left")

    def right_join(self, other: DataFrame, on: str | Column | list[str]) -> Query:
        return self.join(other, on, "right")

    def group_by(self, *columns: str | Column) -> Query:
        return self._with(groups=self.groups + columns)

    def agg(self, *aggregates: Column) -> Query:
        return self._with(aggregates=self.aggregates + aggregates)

    def having(self, predicate: Predicate) -> Query:
        return self._with(group_conditions=(*self.group_conditions, predicate))

    def order_by(self, *orders: str | Column) -> Query:
        return self._with(orders=self.orders + orders)

    def limit(self, n: int) -> Query:
        return self._with(count=n)

    def offset(self, n: int) -> Query:
        return self._with(skip=n)

    def dataframe(self) -> DataFrame:
        df = self.source
        for other, on, how in self.joins:
            df = df.join(other, on, how)
        for p in self.conditions:
            df = df.where(column_of(p))
        if self.groups or self.aggregates:
            df = df.groupBy(*self.groups).agg(*(self.aggregates or (F.count(F.lit(1)).alias("count(*)"),)))
            for p in self.group_conditions:
                df = df.where(column_of(p))
        return run(df, QueryOptions(self.columns, None, self.orders, self.count, self.skip))

    def get(self) -> list:
        return self.dataframe().collect()

    def first(self):
        return self.limit(1).dataframe().first()

    def rows(self) -> int:
        return self.dataframe().count()
