"""Shared pieces: written tables, word hashing, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: tab to carriage return, and space.
SPACES = "\x09\x0a\x0b\x0c\x0d\x20"
WORD = r"[^\x20\x09-\x0D]+"

#: Whether the shuffles of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="sparkforge-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Written intermediate tables. They survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, set()
        # Batches for Python hold blocks of texts or sets here; a few megabytes at a time keep executors small.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: as many as df has at most, if that is known; few rows then make few tasks and files."""
        path = new_path(self.spark, f"{self.name}-{name}")
        if rows is not None:
            df = df.coalesce(max(12, rows // 50_000))
        # A table that is written needs its shuffles no more; else they stay on disk until the driver collects its garbage.
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        out._table_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.paths.discard(t._table_path)
            remove(self.spark, t._table_path)

    def only(self, *kept: DataFrame) -> None:
        """Removes all tables but those that a result still reads."""
        for path in self.paths - {t._table_path for t in kept}:
            self.paths.discard(path)
            remove(self.spark, path)


def release() -> None:
    """Gives back what tasks of the tokenizer kept in this worker process; other tasks may have it next."""
    import sys

    if library := sys.modules.get("tokenizers"):
        vars(library).pop("_sparkforge", None)
    trim()


def trim() -> None:
    """Gives memory that earlier tasks of this worker process have freed back to the system."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound on entries."""

    LIMIT = 200_000

    def __init__(self):
        super().__init__()
        release()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; fewer words make one run of all of them, no words none."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    m = len(hashes) - n + 1
    out = np.full(m, np.uint64(n))
    for i in range(n):
        out *= MIX1
        out += hashes[i : i + m]
    return mix(out)


def as_bytes(column: str = "text"):
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(column)


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) of every node of edges(u, v), by alternating large-star and small-star until nothing changes.

    The component is its smallest node. Each half step is a minimum for every node (combined before the shuffle) that is
    written and joined back, so that Spark can split the rows of a node with very many neighbours.
    """
    now = tables.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = now.count()

    def stars(df: DataFrame) -> bool:
        """Whether every node has one parent at most and no parent has one."""
        ends = df.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    while n and not stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = tables.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "min", 2 * n)
        large = both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tables.write(large, "large", n)
        low = tables.write(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = tables.write(small.where("u <> v").distinct(), "small", 2 * n)
        tables.drop(mins, low, large, now)
        now, n = small, small.count()
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


__all__ = ["SPACES", "WORD", "Tables", "WordHashes", "as_bytes", "components", "mix", "new_path", "release", "remove", "shared_root", "shingles", "trim"]
