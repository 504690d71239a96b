"""Exact aggregates as plans of two levels where one expression would hold a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], column: str, k: int = 5) -> DataFrame:
    """The k most frequent values of each group with exact counts; null is a value, ties: null first, then by value.

    Counts are combined before the shuffle; Spark cuts each group to k rows by rank before it moves them again.
    """
    counts = df.groupBy(*by, column).agg(F.count("*").alias("count"))
    order = [F.desc("count"), F.col(column).asc_nulls_first()]
    kept = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    pack = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("item"), "count"))), lambda x: F.struct(x["item"].alias("item"), x["count"].alias("count")))
    return kept.groupBy(*by).agg(pack.alias("top"))


def wrapped_sum(column: str) -> Column:
    """SUM of BIGINT modulo 2^64."""
    return F.expr(f"cast(pmod(sum(cast({column} as decimal(38,0))) + 9223372036854775808, 18446744073709551616) - 9223372036854775808 as bigint)")


def grouped_top_n(df: DataFrame, by: list[str], aggregates: dict[str, Column], order: list, n: int) -> DataFrame:
    """GROUP BY .. ORDER BY .. LIMIT n: each task keeps its best n, no total sort."""
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in aggregates.items())).orderBy(*order).limit(n)
