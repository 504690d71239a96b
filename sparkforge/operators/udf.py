"""User-defined functions: scalar, aggregate, table."""

from __future__ import annotations

import inspect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, MapType, StructType

#: Rows of results that go back to Spark at once.
ROWS = 10_000


def scalar(engine, name: str, f, returns: str, nulls: str = "propagate") -> None:
    """f takes and returns pandas Series. nulls: propagate (a null argument gives null without a call's result) or call."""
    from ..functions.registry import known

    if known(name):
        raise ValueError(f"{name} is a built-in function")
    engine.spark.udf.register(name, F.pandas_udf(f, returns))
    engine.functions[name.lower()] = (f, returns, nulls)


def aggregate(engine, name: str, f, returns: str) -> None:
    """f takes Series of a group and returns one value."""
    engine.spark.udf.register(name, F.pandas_udf(f, returns))
    engine.functions[name.lower()] = (f, returns, "aggregate")


def two_phase(df: DataFrame, by: list[str], init, update, combine, finalize, state: str, returns: str, salts: int = 32) -> DataFrame:
    """An aggregate by init/update/combine/finalize whose groups needn't fit one task: partial states by salt, then combined.

    update(state, rows of a part as a DataFrame), combine(state, state); a state is a tuple of the schema `state`.
    """
    names = [c.split()[0] for c in state.split(", ")]
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in by)

    def part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key[: len(by)], *update(init(), rows)]], columns=[*by, *names])

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = init()
        for r in rows[names].itertuples(index=False):
            s = combine(s, tuple(r))
        return pd.DataFrame([[*key, finalize(s)]], columns=[*by, returns.split()[0]])

    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    parts = each([salted], [*by, "__salt"], lambda x: part(first(x, by), x.drop(columns="__salt")), f"{keys}, {state}")
    return each([parts], by, lambda x: whole(first(x, by), x), f"{keys}, {returns}")


def first(rows: pd.DataFrame, by: list[str]) -> tuple:
    return tuple(rows[c].iat[0] for c in by)


def table(df: DataFrame, f, returns: str, partition_by: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """A table function over each partition in order; without keys over the parts that Spark has."""
    if not partition_by:

        def every(batches):
            for b in batches:
                yield f(b)

        return df.mapInPandas(every, returns)
    return each([df], partition_by, f, returns, order_by)


def cogroup(left: DataFrame, right: DataFrame, by: list[str], f, returns: str) -> DataFrame:
    """f(rows of the left, rows of the right), or f(key, left, right), for each key of either side."""
    if len(inspect.getfullargspec(f).args) == 3:
        return each([left, right], by, lambda a, b: f(first(a if len(a) else b, by), a, b), returns)
    return each([left, right], by, f, returns)


def each(sides: list[DataFrame], by: list[str], f, returns: str, order_by: list[str] | None = None) -> DataFrame:
    """f over the rows that each key has on one or two sides.

    Rows come sorted by key and go through Python in batches that are cut there: Spark's own calls by group cost
    milliseconds for each, however small. A group has the types that it would have alone (whole numbers stay so
    unless one of its own is null), so nulls of those travel as bits. Nested columns have no such bits and go by groups.
    """
    types = [[t.dataType for t in d.schema] for d in sides]
    whole = [[k for k, t in enumerate(x) if isinstance(t, (IntegralType, BooleanType))] for x in types]
    if any(isinstance(t, (ArrayType, MapType, StructType)) for x in types for t in x) or max(map(len, whole)) > 60:
        if len(sides) == 2:
            return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInPandas(lambda a, b: f(a, b), returns)
        return sides[0].groupBy(*by).applyInPandas(lambda x: f(x.sort_values(order_by) if order_by else x), returns)
    both, order = None, [F.col("__side"), *(F.col(f"__o{k}").asc_nulls_last() for k in range(len(order_by or [])))]
    for s, d in enumerate(sides):
        nulls = sum((F.when(d[d.columns[k]].isNull(), 2 << i).otherwise(0).cast("long") for i, k in enumerate(whole[s])), F.lit(0).cast("long"))
        keys = [d[c].alias(f"__k{k}") for k, c in enumerate(by)] + [d[c].alias(f"__o{k}") for k, c in enumerate(order_by or [])]
        d = d.select(F.lit(s).alias("__side"), nulls.alias("__bits"), *keys, *(d[c].alias(f"__{s}_{k}") for k, c in enumerate(d.columns)))
        both = d if both is None else both.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*(f"__k{k}" for k in range(len(by)))).orderBy(*order)
    bits = F.col("__bits") + F.when(F.row_number().over(w) == 1, 1).otherwise(0)
    filled = [F.coalesce(f"__{s}_{k}", F.lit(False) if isinstance(t, BooleanType) else F.lit(0).cast(t)).alias(f"__{s}_{k}") if k in whole[s] else F.col(f"__{s}_{k}") for s, x in enumerate(types) for k, t in enumerate(x)]
    names = [list(d.columns) for d in sides]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from together(f(*x) for x in groups(batches, names, whole))

    return both.select("__side", bits.alias("__bits"), *filled).mapInPandas(run, returns)


def groups(batches: Iterable[pd.DataFrame], names: list[list[str]], whole: list[list[int]]) -> Iterator[list[pd.DataFrame]]:
    """The frames of each group, one for each side, from batches of sorted rows; a group may go over many batches."""
    held: list[list[pd.DataFrame]] = [[] for _ in names]
    bits_held: list[list[np.ndarray]] = [[] for _ in names]

    def alone(s: int, rows: pd.DataFrame, bits: np.ndarray) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        null = int(np.bitwise_or.reduce(bits)) >> 1 if len(bits) else 0
        for i, k in enumerate(whole[s]) if null else ():
            if null >> i & 1:
                is_bool = rows.dtypes.iloc[k] == bool
                v = rows.iloc[:, k].to_numpy(dtype=object if is_bool else np.float64, copy=True)
                v[(bits >> (i + 1) & 1).astype(bool)] = None if is_bool else np.nan
                rows.isetitem(k, v)
        return rows

    def ready() -> list[pd.DataFrame]:
        out = [alone(s, pd.concat(held[s], ignore_index=True) if len(held[s]) > 1 else held[s][0], np.concatenate(bits_held[s])) for s in range(len(names))]
        for s in range(len(names)):
            held[s].clear()
            bits_held[s].clear()
        return out

    for rows in batches:
        if not len(rows):
            continue
        side, bits = rows["__side"].to_numpy(), rows["__bits"].to_numpy()
        parts = []
        for s, columns in enumerate(names):
            part = rows[[f"__{s}_{k}" for k in range(len(columns))]]
            part.columns = columns
            parts.append(part)
        starts = np.flatnonzero(bits & 1)
        edges = [0, *starts.tolist(), len(rows)] if not len(starts) or starts[0] else [*starts.tolist(), len(rows)]
        # Where each group's second side begins.
        cuts = [b - int(n) for b, n in zip(edges[1:], np.add.reduceat(side, edges[:-1]))]
        for a, c, b in zip(edges, cuts, edges[1:]):
            if bits[a] & 1 and held[0]:
                yield ready()
            spans = [(a, c), (c, b)][: len(names)]
            if bits[a] & 1 and b < len(rows):
                yield [alone(s, parts[s].iloc[x:y], bits[x:y]) for s, (x, y) in enumerate(spans)]
                continue
            for s, (x, y) in enumerate(spans):
                held[s].append(parts[s].iloc[x:y])
                bits_held[s].append(bits[x:y])
    if held[0]:
        yield ready()


def together(results: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small frames as larger ones; frames whose types differ stay apart, so that no value changes."""
    part, n, kind = [], 0, None
    for r in results:
        k = (tuple(r.columns), tuple(r.dtypes))
        if part and (n >= ROWS or k != kind):
            yield pd.concat(part, ignore_index=True)
            part, n = [], 0
        # An empty frame without columns is no rows; any other goes on to be checked against the schema.
        if len(r) or len(r.columns):
            part.append(r)
            n, kind = n + len(r), k
    if part:
        yield pd.concat(part, ignore_index=True)
