"""Joins beyond Catalyst's own: as-of, ranges by bins, merged USING columns, the dialect's NOT IN, skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a table goes whole to every task.
SMALL = 10_000_000


def using(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """USING: one merged column for each key, the left's, the right's (right join) or the first that isn't null (full)."""
    return left.join(right, columns, how)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c.lower() in {x.lower() for x in right.columns}]
    return left.join(right, shared, how) if shared else left.crossJoin(right)


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    on = None
    for a, b in pairs:
        c = left[a].eqNullSafe(right[b])
        on = c if on is None else on & c
    return left.join(right, on, how)


def not_in(left: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Nulls among the values don't count; a null on the left stays only where there is no row of values at all."""
    v = values.toDF("__v")
    kept = left.where(F.col(column).isNotNull()).join(v.where("__v is not null").distinct(), F.col(column) == F.col("__v"), "left_anti")
    nulls = left.where(F.col(column).isNull()).join(v.limit(1), F.lit(True), "left_anti")
    return kept.union(nulls)


def between_bins(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of points inside [low, high] of rows of ranges, by an equi-join on bins of `width` in place of all pairs.

    Bins double in width from level to level. A range is put in the two or three bins that it touches on the level of its
    own length, however long it is; a point is looked up once for every level that some range is on (64 at most), or, if
    all its rows must stay (left), beside the rows that found nothing.
    """
    first, last = F.greatest(F.col(low).cast("double"), F.lit(-width * 2.0**60)), F.least(F.col(high).cast("double"), F.lit(width * 2.0**60))
    r = ranges.withColumn("__level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(last - first, F.lit(width)) / width))).cast("int"))
    r = r.where(first <= last)
    size = F.lit(width) * F.pow(F.lit(2.0), "__level")
    levels = sorted(x[0] for x in r.select("__level").distinct().collect())
    r = r.withColumn("__bins", F.explode(F.sequence(F.floor(first / size), F.floor(last / size))))
    p = (points.withColumn("__row", F.struct(*points.columns)) if how == "left" else points).withColumn("__levels", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    p = p.withColumn("__bin", F.floor(F.col(at) / (F.lit(width) * F.pow(F.lit(2.0), "__levels"))))
    on = (F.col("__levels") == F.col("__level")) & (F.col("__bin") == F.col("__bins")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    found = p.join(r, on)
    if how == "left":
        # A point that finds nothing on one level may find something on another, so only those without any are added.
        hit = found.select(F.col("__row").alias("__hit")).distinct()
        alone = points.withColumn("__row", F.struct(*points.columns)).join(hit, F.col("__row").eqNullSafe(F.col("__hit")), "left_anti")
        found = found.unionByName(alone, allowMissingColumns=True)
    elif how != "inner":
        raise ValueError("a join by bins is inner or left")
    return found.drop("__row", "__levels", "__level", "__bin", "__bins")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time (before it, if strict).

    One union, one sort: a running last value over both sides' rows, in place of a range join.
    """
    tag = 1 if strict else -1
    cols = left.columns
    a = left.select(*cols, F.col(left_at).alias("__t"), F.lit(0).alias("__o"))
    packed = F.struct(*(right[v] for v in values))
    b = right.select(*[F.col(k) for k in by], right[right_at].alias("__t"), F.lit(tag).alias("__o"), packed.alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    # A null in a key equals nothing, though a window holds nulls together.
    whole = F.lit(True)
    for k in by:
        whole = whole & F.col(k).isNotNull()
    out = both.withColumn("__v", F.when(whole, F.last("__v", ignorenulls=True).over(w))).where("__o = 0")
    return out.select(*cols, *(F.col(f"__v.{v}").alias(v) for v in values))


def salted(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys spread over `salts` tasks: the left is salted, the right repeated for each salt.

    Right rows without a match (right, full) are found apart, by a join with the left's distinct keys, so each comes once.
    A right side that is small once repeated goes whole to every task and needs no salt. Any other is merged: Catalyst takes
    the repeated side to be as small as before and would send all its copies through the driver.
    """
    if how in ("right", "full"):
        met = salted(left, right, key, salts, "inner" if how == "right" else "left")
        alone = right.join(left.select(key).distinct(), key, "left_anti")
        return met.unionByName(alone, allowMissingColumns=True)
    if bytes_of(right) * salts <= SMALL:
        return left.join(F.broadcast(right), key, how)
    a = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b.hint("merge"), [key, "__salt"], how).drop("__salt")


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if Catalyst's estimate of its size is at most `most` bytes; else df for a shuffled join."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def opaque(left: DataFrame, right: DataFrame, on: Column, predicate) -> DataFrame:
    """An equi-join filtered by a Python predicate over its rows (a vectorised function of Arrow columns)."""
    return left.join(right, on).where(predicate)
