"""The builder: each call adds an operator to a lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Query:
    def __init__(self, engine, df: DataFrame):
        self.engine, self.df = engine, df

    def _expr(self, x) -> Column:
        from .dialect import Rewriter

        return x if isinstance(x, Column) else F.expr(self.engine.ready(Rewriter(self.engine.dialect, self.engine.variables).rewrite(x)))

    def _next(self, df: DataFrame) -> Query:
        return Query(self.engine, df)

    def where(self, condition) -> Query:
        return self._next(self.df.filter(self._expr(condition)))

    filter = where

    def select(self, *columns) -> Query:
        return self._next(self.df.select(*map(self._expr, columns)))

    def exclude(self, *columns: str) -> Query:
        return self._next(self.df.drop(*columns))

    def compute(self, **derived) -> Query:
        return self._next(self.df.withColumns({k: self._expr(v) for k, v in derived.items()}))

    def join(self, other: Query | DataFrame, on, how: str = "inner") -> Query:
        right = other.df if isinstance(other, Query) else other
        return self._next(self.df.join(right, on if isinstance(on, (list, Column)) else self._expr(on), how))

    def group_by(self, *columns, **aggregates) -> Query:
        aggs = [self._expr(v).alias(k) for k, v in aggregates.items()]
        keys = [self._expr(c) for c in columns]
        return self._next(self.df.groupBy(*keys).agg(*aggs) if keys else self.df.agg(*aggs))

    aggregate = group_by

    def order_by(self, *columns) -> Query:
        return self._next(self.df.orderBy(*(F.col(c[:-5]).desc() if isinstance(c, str) and c.lower().endswith(" desc") else self._expr(c) for c in columns)))

    def limit(self, n: int, offset: int = 0) -> Query:
        return self._next(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def distinct(self) -> Query:
        return self._next(self.df.distinct())

    def union(self, other: Query, all: bool = False) -> Query:
        df = self.df.union(other.df)
        return self._next(df if all else df.distinct())

    def pipe(self, f, *args, **kwargs) -> Query:
        return self._next(f(self.df, *args, **kwargs))

    def explain(self) -> None:
        self.df.explain("formatted")

    def collect(self):
        return self.df.collect()
