"""Near-duplicate documents: universal hash minima, banding, exact verification, connected components.

Texts with equal shingle sets form a class first, so that only different texts are compared. A class has `BANDS * ROWS`
minima under multiply-add hashes. Classes that agree in all minima of a band share a bucket. At similarity 0.8 the
chance that a pair shares none of 40 buckets of 5 minima is 1.3e-7. Buckets are never expanded into all pairs:

1. Star rounds. Each class is held against one pivot for every bucket (its smallest member at first, others later), by
   the low bytes of the minima; the best is verified on the full shingle sets. Verified links give components.
2. The rest. Only buckets whose members lie in different components are left. Members that the star rounds found alike
   are held against each other in blocks of full sets, the others in blocks of minima, of which pairs that agree are
   verified, the best of any two components first. No link that could join two components is skipped.

Minima estimate a pair only to leave it out where a similarity of 0.8 is less likely than 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, WordHashes, as_bytes, components, mix, release, shingles

BANDS, ROWS = 40, 5
K = BANDS * ROWS
#: Longest run of shingles that is hashed at once; bounds memory for very long texts.
BLOCK = 65_536
BLOOM_WORDS = 1 << 18


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the universal hashes x -> (a * x + b) mod 2^64, of which the upper half counts."""
    i = np.arange(1, K + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(i * np.uint64(0xD1B54A32D192ED03))


def shingle_set(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words of a text, A-Z in lower case."""
    return np.unique(shingles(hashes.of(text.lower().split()), n))


def minima(sets: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K minima of each set; the sets lie one after the other in `sets`."""
    out = np.empty((len(starts), K), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(K):
            out[:, k] = np.minimum.reduceat(sets * a[k] + b[k], starts) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set; null if empty), sig (low byte of each minimum), bands (bucket keys)."""
    schema = "doc_id long, n_shingles long, key binary, sig binary, bands array<long>"

    def run(batches):
        hashes, (a, b) = WordHashes(), coefficients()
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)

        def flush(ids, sets):
            full = [s for s in sets if len(s)]
            got = iter(())
            if full:
                starts = np.cumsum([0, *map(len, full[:-1])])
                m = minima(np.concatenate(full), starts, a, b)
                key = np.zeros((len(full), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(ROWS):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, r::ROWS] + salt)
                got = iter(zip((m & 255).astype(np.uint8), key.view(np.int64)))
            rows = []
            for i, s in zip(ids, sets):
                sig, bands = next(got) if len(s) else (None, None)
                rows.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, None if sig is None else sig.tobytes(), bands))
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "sig", "bands"])

        for batch in batches:
            ids, sets, size = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                s = shingle_set(t.as_py(), n, hashes)
                ids.append(i.as_py())
                sets.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield flush(ids, sets)
                    ids, sets, size = [], [], 0
            if ids:
                yield flush(ids, sets)

    return docs.select("doc_id", as_bytes()).mapInArrow(run, schema)


def agreeing(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose minima agree in `least` places or more, with their number as est."""
    sig = reps.select("doc_id", "sig", "n_shingles")
    one = sig.toDF("a", "sig_a", "n_a")
    two = sig.toDF("b", "sig_b", "n_b")

    def run(batches):
        for x in batches:
            if not len(x):
                continue
            p, q = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in (2, 3))
            est = (p == q).sum(1)
            on = np.flatnonzero(est >= least)
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(on)), x.column(1).take(pa.array(on)), pa.array(est[on], pa.int64())], names=["a", "b", "est"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, est long")


def bloom(spark: SparkSession, ids: DataFrame) -> bytes:
    """Bits of the ids, of a fixed size whatever their number; they only spare the shuffle texts that no pair needs."""
    h = F.xxhash64("id")
    words = ids.select((h.bitwiseAND(F.lit(BLOOM_WORDS - 1))).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id), 32) & 63 as int))").alias("bit"))
    bits = np.zeros(BLOOM_WORDS, np.int64)
    found = words.groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits[found["w"].to_numpy()] = found["bit"].to_numpy()
    return bits.tobytes()


def needed(docs: DataFrame, bits, make=None, schema: str = "id long, text binary") -> DataFrame:
    """(id, text) of the documents in the bit table, or (id, make(text)): one Python process for each task does both."""

    def run(batches):
        release()
        table = np.frombuffer(bits.value, np.int64)
        f = make() if make else None
        for x in batches:
            h = x.column(2).to_numpy(zero_copy_only=False)
            on = (table[h & (BLOOM_WORDS - 1)] >> ((h.view(np.uint64) >> np.uint64(32)).astype(np.int64) & 63)) & 1
            ids, texts = (c.filter(pa.array(on.astype(bool))) for c in x.columns[:2])
            if f:
                texts = pa.array([f(t.as_py()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, texts], names=["id", "text"])

    out = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), as_bytes(), F.xxhash64("doc_id").alias("h"))
    return out.mapInArrow(run, schema)


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, tables: Tables, rows: int | None = None) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    pairs = tables.write(pairs.select("a", "b").distinct(), "pairs", rows)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    bits = spark.sparkContext.broadcast(bloom(spark, ids))
    text = needed(docs, bits)

    def run(batches):
        hashes, kept = WordHashes(), {}

        def get(i, t):
            if (i, t) not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[i, t] = shingle_set(t, n, hashes)
            return kept[i, t]

        for x in batches:
            on = []
            for i, (a, b, ta, tb) in enumerate(zip(*(c.to_pylist() for c in x.columns))):
                p, q = get(a, ta), get(b, tb)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    on.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(on, pa.int64())) for c in x.columns[:2]], names=["a", "b"])

    one, two = text.toDF("a", "text_a"), text.toDF("b", "text_b")
    out = tables.write(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct(), "links")
    tables.drop(pairs)
    return out


def tiles(few: DataFrame, whole: DataFrame, keys: list[str], pairs: int = 64) -> DataFrame:
    """(few, whole) for all blocks with equal keys, dealt in tiles of about `pairs` pairs, so that no key is one task.

    few and whole have the keys, `part` (the number of the block) and the block. The blocks of `few` are repeated for
    every column of tiles and those of `whole` for every row, not for every pair.
    """
    f, w = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((few, "f"), (whole, "w")))
    n = f.join(w, keys).select(*keys, F.least("w", F.ceil(F.col("f") * F.col("w") / pairs)).alias("columns"), F.ceil(F.col("f") / pairs).alias("rows"))
    left = few.join(n, keys).select(*keys, "few", F.pmod("part", "rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    right = whole.join(n, keys).select(*keys, "whole", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod("part", "columns").alias("column"))
    return left.join(right, [*keys, "row", "column"]).select("few", "whole")


def block_links(side: DataFrame, near: DataFrame, docs: DataFrame, n: int, percent: int, tables: Tables, rows: int) -> tuple[DataFrame, DataFrame]:
    """Links across components inside a chain, and the chains: (a, b), (doc_id, chain).

    A chain is a component of the pairs that agreed in the star rounds, verified or not. A large group of copies with
    many edits each is one chain, in which very many pairs lie just below the similarity. The members outside a chain's
    largest component are held against the whole chain in blocks: the intersections of two blocks are one product of
    matrices, and only one link of a member with any component leaves it.
    """
    spark = docs.sparkSession
    chains = tables.write(components(near.toDF("u", "v"), tables).toDF("doc_id", "chain"), "chains", rows)
    one = side.select("doc_id", "n_shingles", "root").distinct().join(chains, "doc_id")
    sizes = one.groupBy("chain", "root").count().groupBy("chain").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    one = one.join(sizes.where("roots > 1"), "chain")
    # Similar sets have sizes whose classes differ by one at most.
    one = tables.write(one.withColumn("size", F.floor(F.log("n_shingles") / F.lit(float(np.log(100 / percent)) * 1.0001)).cast("int")), "inner", rows)
    bits = spark.sparkContext.broadcast(bloom(spark, one.select(F.col("doc_id").alias("id"))))

    def sets():
        hashes = WordHashes()
        return lambda t: shingle_set(t, n, hashes).tobytes()

    full = needed(docs, bits, sets).dropDuplicates(["id"]).toDF("doc_id", "shingles")
    most = F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.lit(20_000) / F.pow(F.lit(100 / percent), "size"))))
    parts = one.groupBy("chain", "size").agg(F.ceil(F.count("*") / F.max(most)).alias("parts"))
    full = one.join(full, "doc_id").join(parts, ["chain", "size"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    full = tables.write(full.select("chain", "size", "part", "doc_id", "root", "main", "shingles"), "full")
    pack = F.collect_list(F.struct("doc_id", "root", "shingles"))
    few = full.where("root <> main").groupBy("chain", "size", "part").agg(pack.alias("few"))
    few = few.select("chain", F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))).alias("size"), "part", "few")
    whole = full.groupBy("chain", "size", "part").agg(pack.alias("whole"))

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(0), b.column(1)):
                x, y = x.as_py(), y.as_py()
                p, q = ([np.frombuffer(r["shingles"], np.uint64) for r in z] for z in (x, y))
                words, place = np.unique(np.concatenate([*p, *q]), return_inverse=True)
                rows = np.repeat(np.arange(len(p) + len(q)), [*map(len, p), *map(len, q)])
                m = np.zeros((len(p) + len(q), len(words)), np.float32)
                m[rows, place] = 1
                both = (m[: len(p)] @ m[len(p) :].T).astype(np.int64)
                union = np.array([*map(len, p)])[:, None] + np.array([*map(len, q)]) - both
                linked = (both > 0) & (100 * both >= percent * union)
                for i, r in enumerate(x):
                    seen = {r["root"]}
                    for j in np.flatnonzero(linked[i]):
                        if y[j]["root"] not in seen:
                            seen.add(y[j]["root"])
                            out.append((r["doc_id"], y[j]["doc_id"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return tables.write(tiles(few, whole, ["chain", "size"]).mapInArrow(run, "a long, b long"), "block-links"), chains


def block_agreeing(side: DataFrame, reps: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b, est), a > b: pairs of a bucket in different chains and components whose minima agree in `least` places.

    Texts that share a common passage may meet in a bucket in large numbers without being alike, so members are compared
    in blocks of minima and only pairs that agree become rows.
    """
    rows = side.join(reps.select("doc_id", "sig"), "doc_id")
    parts = side.groupBy("bucket").agg(F.ceil(F.count("*") / 64).alias("parts"))
    rows = rows.join(parts, "bucket").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    pack = F.collect_list(F.struct("doc_id", "n_shingles", "root", "chain", "sig"))
    few = rows.where("root <> main").groupBy("bucket", "part").agg(pack.alias("few"))
    whole = rows.groupBy("bucket", "part").agg(pack.alias("whole"))

    def run(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(0), b.column(1)):
                p, q = ([np.array([r[k] for r in z], np.int64) for k in ("doc_id", "n_shingles", "root", "chain")] + [np.frombuffer(b"".join(r["sig"] for r in z), np.uint8).reshape(-1, K)] for z in (x.as_py(), y.as_py()))
                est = np.stack([(row == q[4]).sum(1) for row in p[4]])
                n, m = p[1][:, None], q[1][None]
                on = (est >= least) & (p[2][:, None] != q[2]) & (p[3][:, None] != q[3]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                i, j = np.nonzero(on)
                out.append((np.maximum(p[0][i], q[0][j]), np.minimum(p[0][i], q[0][j]), est[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["a", "b", "est"])

    return tiles(few, whole, ["bucket"]).mapInArrow(run, "a long, b long, est long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, component_id, kept.

    class_id is the smallest doc_id with the same shingle set. A null or empty text, or one of white space, has no
    shingles, is linked with nothing and kept. A text of fewer than n words has one shingle, all of its words. Rows that
    repeat a doc_id share its component. A row without doc_id is kept with a null component unless a copy of it has an
    id. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = int(K * percent / 100 - 6.5 * (K * percent / 100 * (1 - percent / 100)) ** 0.5)

    rows = tables.write(signatures(docs, n), "rows")
    first = rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("r"))
    reps = tables.write(first.select("key", "r.*"), "classes")
    bands = reps.select(F.explode("bands").alias("bucket"), "doc_id", "n_shingles")
    shared = bands.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("bucket")
    shared = tables.write(shared, "buckets")
    members = tables.write(bands.join(shared, "bucket"), "members")
    n_classes, n_members = reps.count(), members.count()
    links = done = None
    roots = members.withColumn("root", F.col("doc_id"))
    tried = every = None
    ratio = F.expr(f"100 * least(n_shingles, p_n) >= {percent} * greatest(n_shingles, p_n)")

    def joined(new: DataFrame):
        nonlocal links, done, roots
        links = tables.write(new if links is None else links.union(new), "all-links", 4 * n_classes)
        done = tables.write(components(links.toDF("u", "v"), tables), "components", n_classes)
        roots = tables.write(members.join(done.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("root")), "roots", n_members)

    cost = None
    for turn in range(12):
        # First the smallest member; then another for every bucket, so that a class is held against many and keeps the best.
        order = F.xxhash64("doc_id", "bucket", F.lit(turn)) if turn else F.col("doc_id")
        pivot = F.min(F.struct(order.alias("o"), F.col("doc_id").alias("p"), F.col("n_shingles").alias("p_n"), F.col("root").alias("p_root"))).alias("x")
        pivots = tables.write(roots.groupBy("bucket").agg(pivot, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket", "x.*").drop("o"), "pivots", n_members)
        pairs = roots.join(pivots, "bucket").where((F.col("root") != F.col("p_root")) & ratio)
        pairs = pairs.select(F.col("doc_id").alias("a"), F.col("p").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        near = tables.write(agreeing(pairs, reps, least), "near", n_members)
        best = near.groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
        best = tables.write(best, "best", n_classes)
        every = near.select("a", "b") if every is None else every.union(near.select("a", "b"))
        tables.drop(pivots)
        tried = best if tried is None else tables.write(tried.union(best), "tried", 4 * n_classes)
        new = verified(best, docs, n, percent, tables, n_classes)
        if new.isEmpty():
            break
        joined(new)
        left = roots.groupBy("bucket", "root").count().groupBy("bucket").agg(F.sum("count").alias("m"), F.max("count").alias("most"))
        before, (cost, few) = cost, left.where("m > most").agg(F.sum((F.col("m") - F.col("most")) * F.col("m")), F.sum(F.col("m") - F.col("most"))).first()
        # Enough when a class that is left has few partners, or when a turn hardly joins any more.
        if not cost or cost <= 3 * few or before and 20 * cost > 19 * before:
            break

    def mixed():
        """Members of buckets that lie in several components, and the largest component of each bucket."""
        per = roots.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
        per = tables.write(per.where("roots > 1").select("bucket", "main"), "mixed", n_members)
        return tables.write(roots.join(per, "bucket"), "side", n_members)

    new, chains = block_links(mixed(), every, docs, n, percent, tables, n_classes)
    if not new.isEmpty():
        joined(new)
    # Pairs of one bucket that no chain holds.
    side = mixed().join(chains, "doc_id", "left").withColumn("chain", F.coalesce("chain", "doc_id"))
    side = tables.write(side, "outer", n_members)
    rest = block_agreeing(side, reps, least, percent).groupBy("a", "b").agg(F.max("est").alias("est"))
    if tried is not None:
        rest = rest.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = tables.write(rest, "rest", n_members)
    for most in (1, 16, None):
        if rest.isEmpty():
            break
        if done is not None:
            r = done.toDF("x", "r")
            rest = rest.join(r.toDF("a", "ra"), "a", "left").join(r.toDF("b", "rb"), "b", "left")
            rest = rest.select("a", "b", "est", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        else:
            rest = rest.select("a", "b", "est", F.col("a").alias("ra"), F.col("b").alias("rb"))
        pick = rest.withColumn("i", F.row_number().over(Window.partitionBy(F.least("ra", "rb"), F.greatest("ra", "rb")).orderBy(F.desc("est"), "a", "b")))
        pick = tables.write((pick.where(f"i <= {most}") if most else pick).select("a", "b"), "pick", n_members)
        rest = tables.write(rest.select("a", "b", "est").join(pick, ["a", "b"], "left_anti"), "rest", n_members)
        new = verified(pick, docs, n, percent, tables)
        if not new.isEmpty():
            joined(new)

    classes = reps.select("key", F.col("doc_id").alias("class_id"))
    if done is not None:
        classes = classes.join(done.withColumnRenamed("node", "class_id"), "class_id", "left").select("key", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    else:
        classes = classes.withColumn("component_id", F.col("class_id"))
    classes = tables.write(classes.withColumnRenamed("key", "k"), "ids")
    tables.only(rows, classes)
    out = rows.select("doc_id", "n_shingles", "key").join(classes, F.col("key") == F.col("k"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, n=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")
