"""Window functions that Spark's SQL lacks: GROUPS frames, DISTINCT aggregates, session numbers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates whose value is the same in any order of the rows.
ANY_ORDER = ("sum", "count", "min", "max", "avg", "mean", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "bit_and", "bit_or", "bit_xor")
#: Groups of a frame up to which rows are put into each frame of theirs.
FRAMES = 8


def groups_frame(df: DataFrame, aggregate: Column, name: str, by: list[str], order: list, start: int, end: int) -> DataFrame:
    """aggregate over GROUPS BETWEEN start AND end: frames count groups of peers, so a RANGE over their dense rank.

    Where the order of a frame's rows doesn't matter and it holds its own group and few others, no task sorts or holds a
    partition: only the distinct groups are ranked, and each row goes into the aggregates of all the frames that it is in.
    """
    kind = re.match(r"Column<'(\w+)\(", str(aggregate))
    plain = kind and kind[1].lower() in ANY_ORDER and all(isinstance(o, str) for o in order) and df._jdf.queryExecution().analyzed().deterministic()
    if not plain or not start <= 0 <= end or end - start >= FRAMES:
        rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))
        w = Window.partitionBy(*by).orderBy("__g").rangeBetween(start, end)
        return df.withColumn("__g", rank).withColumn(name, aggregate.over(w)).drop("__g")
    keys = list(dict.fromkeys([*by, *order]))
    names = [f"__k{k}" for k in range(len(keys))]
    parts = [names[keys.index(b)] for b in dict.fromkeys(by)]

    def same(rows: DataFrame, peers: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (rows[c].eqNullSafe(peers[n]) for c, n in zip(keys, names)))

    peers = df.select(*(df[c].alias(n) for c, n in zip(keys, names))).distinct()
    peers = peers.withColumn("__g", F.dense_rank().over(Window.partitionBy(*parts).orderBy(*(names[keys.index(o)] for o in order))))
    inside = df.join(peers, same(df, peers)).withColumn("__frame", F.explode(F.sequence(F.col("__g") - end, F.col("__g") - start)))
    values = inside.groupBy(*parts, "__frame").agg(aggregate.alias("__value")).toDF(*(f"__v{k}" for k in range(len(parts))), "__frame", "__value")
    on = reduce(lambda a, b: a & b, (peers[n].eqNullSafe(values[f"__v{k}"]) for k, n in enumerate(parts)), peers["__g"] == values["__frame"])
    framed = peers.join(values, on).select(*names, F.col("__value").alias("__of_frame"))
    return df.join(framed, same(df, framed), "left").drop(*names).withColumn(name, F.col("__of_frame")).drop("__of_frame")


def count_distinct_over(column: str, w) -> Column:
    return F.size(F.collect_set(column).over(w)).cast("long")


def sum_distinct_over(column: str, w) -> Column:
    return F.aggregate(F.collect_set(F.col(column).cast("double")).over(w), F.lit(0.0), lambda a, x: a + x)


def avg_distinct_over(column: str, w) -> Column:
    n = F.size(F.collect_set(column).over(w))
    return F.when(n > 0, sum_distinct_over(column, w) / n)


def session_number(df: DataFrame, column: str, delta: int, name: str, by: list[str], order: list) -> DataFrame:
    """Numbers sessions from 1: a new one where the value is more than delta above the last one before it that isn't null."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.coalesce((F.col(column) - before > delta).cast("int"), F.lit(0)))
    total = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return df.withColumn(name, total.cast("long")).drop("__new")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("__q", condition).where("__q").drop("__q")
