"""Mixing sources to target weights by a splitting tree of block quotas.

Every document falls by hash into one of BLOCKS blocks of its source. A source is drawn in whole passes over its blocks
and one partial pass that stops at its target. A tree over the output shards splits the drawn blocks of all sources:
at each node the left half's share of every source is drawn from the multivariate hypergeometric distribution, so that
the quotas of the leaves add up exactly. A shard then takes the next blocks in the permuted order of each source, which
no other shard takes, and is shuffled locally.

The stop of the partial pass is found by a radix search on the hash: sizes are summed for 256 blocks of each source,
then for 256 parts of the block at the stop, and once more. No step sorts or collects documents; the driver holds one row
per source and node of the tree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Tables

BLOCKS, LEVELS, MOST, SHARDS, SEED = 256, 3, 3, 64, 20_240_229
#: Up to so many sources their rows are sent to every task.
FEW_SOURCES = 10_000
#: Permutations that a source may try, and the share of its target that is near enough.
TRIES, NEAR = 8, 0.002


def targets(sizes: list[int], weights: list[float] | None = None, total: float | None = None, most: int = MOST) -> list[float]:
    """Shares of total by weight, at most `most` times each size; what is over goes to the others by weight.

    The sizes are in the order of their sources; without weights these are 1, 2, 3, repeating.
    """
    weights = weights or [1 + i % 3 for i in range(len(sizes))]
    total = float(sum(sizes) if total is None else total)
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), min(total, float(most * sum(sizes)))
    while free:
        unit = left / math.fsum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left = total - math.fsum(x for i, x in enumerate(out) if i not in free)
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (column) for each shard (row). Columns add up to the quotas, rows differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        mid, n = (low + high) // 2, int(counts.sum())
        take = n * (mid - low) // (high - low)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(counts, take, method="marginals") if n else counts * 0
        split(left, low, mid)
        split(counts - left, mid, high)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def permuted(block, turn: int, seed: int):
    """Rank of a block in a pass: an odd multiplier makes a permutation of the 256 blocks."""
    a, c = 2 * ((seed * 31 + turn * 57 + 11) % 128) + 1, (seed * 17 + turn * 101) % BLOCKS
    return (block * a + c) % BLOCKS


def keyed(docs: DataFrame) -> DataFrame:
    """docs as one struct `row`, with what places a document."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))


def placed(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """rows with their source's columns of stops, the digits of their hash under the source's seed, and the rank of their block in the partial pass."""
    out = rows.join(stops, F.col("source").eqNullSafe(F.col("of")))
    out = out.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "seed"))
    for i in range(LEVELS):
        out = out.withColumn(f"d{i}", F.shiftrightunsigned("h", 56 - 8 * i).bitwiseAND(F.lit(255)).cast("int"))
    return out.withColumn("rank", F.coalesce(*(F.when(F.col("base") == i, permuted(F.col("d0"), i, SEED)) for i in range(MOST + 1))))


def search(rows: DataFrame, wanted: list[tuple], tables: Tables) -> list[dict]:
    """The stop of the partial pass of each source and seed: of wanted rows (of, base, need, seed), also k0.. and what is missing then."""
    stops = rows.sparkSession.createDataFrame(wanted, "of string, base int, need double, seed long")
    # Digit by digit: the last one whose running sum is still within what is needed.
    for level in range(LEVELS):
        part = placed(rows, stops)
        for i in range(level):
            part = part.where((F.col("rank") if i == 0 else F.col(f"d{i}")) == F.col(f"k{i}"))
        sums = part.groupBy("source", "seed", F.col("rank" if level == 0 else f"d{level}").alias("digit")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("source", "seed").orderBy("digit")) - F.col("n")
        sums = sums.select("digit", "n", run.alias("before"), F.col("source").alias("at"), F.col("seed").alias("at_seed"))
        stop = stops.join(sums, F.col("of").eqNullSafe(F.col("at")) & (F.col("seed") == F.col("at_seed")), "left").where("before is null or before <= need")
        stop = stop.groupBy(*stops.columns).agg(F.max(F.struct("digit", "before", "n")).alias("x"))
        # At the last digit the whole part goes in where that comes nearer to the target.
        last = F.expr("if(2 * (need - x.before) >= x.n and x.n > 0, 1, 0)") if level == LEVELS - 1 else F.lit(0)
        left = F.col("need") - F.coalesce("x.before", F.lit(0)) - last * F.coalesce("x.n", F.lit(0))
        stops = stop.select(*(c for c in stops.columns if c != "need"), left.alias("need"), F.coalesce(F.col("x.digit") + last, F.lit(-1)).cast("int").alias(f"k{level}"))
        stops = tables.write(stops, f"stop{level}", len(wanted))
    return [r.asDict() for r in stops.collect()]


def stops_of(rows: DataFrame, weights: list[float] | None, shards: int, seed: int, tables: Tables, keep: bool = False) -> DataFrame:
    """A row for each source: of, source_size, target, base (whole passes), seed, k0.. (stop of the partial pass), bounds (of shards).

    A source of few documents may stop a large document away from its target; other permutations are tried for it.
    """
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    names, sizes = [r["source"] for r in found], [r["size"] for r in found]
    goal = dict(zip(names, targets(sizes, weights)))
    base = {n: min(MOST, int(goal[n] // s)) if s else 0 for n, s in zip(names, sizes)}
    need = {n: goal[n] - base[n] * s for n, s in zip(names, sizes)}
    best: dict = {}
    for turns in ([0], range(1, TRIES)):
        wanted = [n for n in names if n not in best or abs(best[n]["need"]) > goal[n] * NEAR]
        if not wanted:
            break
        found_stops = search(rows, [(n, base[n], need[n], seed + t) for n in wanted for t in turns], tables)
        for r in sorted(found_stops, key=lambda r: r["seed"]):
            if r["of"] not in best or abs(r["need"]) < abs(best[r["of"]]["need"]):
                best[r["of"]] = r
    drawn = [base[n] * BLOCKS + (max(0, best[n]["k0"] + 1) if need[n] > 0 else 0) for n in names]
    quotas = np.cumsum(splitting_tree(drawn, shards, seed), 0)
    out = [(n, s, goal[n], base[n], best[n]["seed"], *(best[n][f"k{i}"] for i in range(LEVELS)), [int(x) for x in quotas[:, i]]) for i, (n, s) in enumerate(zip(names, sizes))]
    head = "of string, source_size long, target double, base int, seed long, " + ", ".join(f"k{i} int" for i in range(LEVELS)) + ", bounds array<long>"
    tables.only(*([rows] if keep else []))
    stops = tables.write(spark.createDataFrame(out, head), "stops")
    return F.broadcast(stops) if len(found) <= FEW_SOURCES else stops


def drawn(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """rows with their source's columns of stops, copies, and the shard of each copy."""
    out = placed(rows, stops)
    place = F.struct(F.col("rank").alias("a"), *(F.col(f"d{i}").alias(f"b{i}") for i in range(1, LEVELS)))
    extra = (place < F.struct(*(F.col(f"k{i}").alias(f"c{i}") for i in range(LEVELS)))) & (F.col("target") > 0)
    turns = F.array(*(F.when(F.col("base") > i, i * BLOCKS + permuted(F.col("d0"), i, SEED)) for i in range(MOST)), F.when(extra, F.col("base") * BLOCKS + F.col("rank")))
    out = out.withColumn("turns", F.filter(turns, lambda x: x.isNotNull()))
    return out.withColumn("copies", F.size("turns")).withColumn("shards", F.expr("transform(turns, t -> size(filter(bounds, b -> b <= t)))"))


def sized(docs: DataFrame, tables: Tables) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("row.text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return tables.write(keyed(docs.select("doc_id", "source", "text")).withColumn("size", size).drop("row"), "sizes")


def plan(docs: DataFrame, weights: list[float] | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, shards (of its copies).

    A document's size is its number of words; null texts count as empty. Null is a source of its own, the last. Rows that
    repeat are separate documents that are drawn alike. An empty table gives no rows; other columns are not looked at.
    """
    tables = Tables(docs.sparkSession, "mixing")
    rows = sized(docs, tables)
    out = drawn(rows, stops_of(rows, weights, shards, seed, tables, keep=True))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "shards")


def mix(docs: DataFrame, weights: list[float] | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: docs' columns, each row as often as plan() draws it, and its shard. Shards are shuffled locally.

    Whether a row is drawn depends on its id and source and on a few numbers for each source, so documents meet no table
    of documents and move once, to their shards.
    """
    tables = Tables(docs.sparkSession, "mixing")
    stops = stops_of(sized(docs, tables), weights, shards, seed, tables)
    out = drawn(keyed(docs), stops).select("row", "doc_id", F.posexplode("shards").alias("turn", "shard"))
    order = F.xxhash64(F.col("doc_id").cast("string"), "turn", F.lit(seed + 1)).alias("order")
    out = out.select("row", "shard", order).repartition("shard", F.pmod("order", F.lit(16))).sortWithinPartitions("shard", "order")
    return out.select("row.*", "shard")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
