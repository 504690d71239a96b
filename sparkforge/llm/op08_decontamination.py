"""Benchmark decontamination that also finds re-parameterised questions.

Words become canonical: numbers, units of measure and names turn into typed placeholders, the rest is taken in lower case
without outer punctuation. A capital at the start of a sentence is read both as a word and as a name. Windows of N
canonical words of documents and items are joined by hash. A window counts only where at least half of its words are not
placeholders; an item without such a window is sought by its words as they are, and one of fewer than N words by a window
of its own length. Windows of a document and an item at one distance form an alignment; in it every slot value of the item must stand for one value throughout (a name for one name, a number for one
number), or the alignment is dropped. A document is contaminated by an item if consistent alignments cover at least
`share` of the item's windows.

A bit table of fixed size, built from the items' hashes, keeps the windows that cannot join from being shuffled. What
passes it is joined, so results are exact for benchmarks of any size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, as_bytes, release, shingles

N = 8
SHARE = 0.5
BIT_WORDS = 1 << 20

# Units of measure that follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l dl cl s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent % dollar dollars euro euros cent cents usd eur gbp hz khz mhz ghz kb mb gb tb w kw v a".split())
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
HOLDERS = ("", "\x00number", "\x00unit", "\x00name")
HOLDER = np.array([0, *(xxhash.xxh64_intdigest(h) for h in HOLDERS[1:])], np.uint64)
NUMERIC = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:%|st|nd|rd|th)?|[$€£]\d+(?:[.,]\d+)*")
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%$") + "“”‘’«»…–—"
OUTER_BYTES, UNIT_BYTES = OUTER.encode("ascii", "ignore"), frozenset(u.encode() for u in UNITS)


class Canon(dict):
    """Value of each word: its hash, with its kind and the flags in the low bits; remembered up to a bound on entries."""

    LIMIT = 400_000
    KIND, ENDS, EMPTY, FLAGS = np.uint64(3), np.uint64(4), np.uint64(8), np.uint64(15)

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        # Words of ASCII, most of them, are looked at as bytes.
        word, outer, units, closing, stops = (raw, OUTER_BYTES, UNIT_BYTES, b"\"')]", b".!?:") if raw.isascii() else (raw.decode("utf-8", "replace"), OUTER, UNITS, "\"')]”’»", ".!?:")
        flags, core = LITERAL, word.strip(outer)
        low = core.lower()
        if low in units:
            flags = UNIT
        elif core[:1].isupper():
            flags = NAME if core[1:].islower() else LITERAL
        elif core and not core.isalpha() and NUMERIC.fullmatch(core if word is not raw else core.decode()):
            flags = NUMBER
        # Whether a sentence ends with the word, and whether it has neither letters nor digits.
        if not word[-1:].isalnum() and word.rstrip(closing)[-1:] in stops:
            flags |= 4
        low = low or word
        v = self[raw] = xxhash.xxh64_intdigest(low if word is raw else low.encode("utf-8", "replace")) & ~15 | flags | (0 if core else 8)
        return v

    def of(self, text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words that have letters or digits, canonical hashes, kinds, hashes of the words, and which open a sentence like a name."""
        words = text.split()
        t = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        word_hash, kind = t & ~self.FLAGS, (t & self.KIND).astype(np.int8)
        # A capital is a name only inside a sentence; a unit only after a number.
        opens = np.zeros(len(words), bool)
        if len(words):
            starts = np.concatenate([[True], (t[:-1] & self.ENDS) > 0])
            opens = (kind == NAME) & starts
            kind[opens] = LITERAL
            after = np.concatenate([[False], kind[:-1] == NUMBER])
            kind[(kind == UNIT) & ~after] = LITERAL
        h = np.where(kind == LITERAL, word_hash, HOLDER[kind])
        on = (t & self.EMPTY) == 0
        if not on.all():
            h, kind, word_hash, opens, words = h[on], kind[on], word_hash[on], opens[on], [w for w, k in zip(words, on) if k]
        return words, h, kind, word_hash, opens


def core_of(word: bytes) -> str:
    return word.decode("utf-8", "replace").strip(OUTER).lower()


def windows(h: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of n words, and whether half of its words or more are literal. Fewer words make one window."""
    w = shingles(h, n)
    m = min(n, len(h))
    seen = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    return w, 2 * (seen[m:] - seen[: len(seen) - m]) >= m if len(w) else np.zeros(0, bool)


WINDOW = "id long, at long, hash long, kinds array<int>, slots array<string>, named boolean, exact boolean, size int"
#: Sets hashes of exact windows apart.
EXACT = np.uint64(0x5851F42D4C957F2D)


def readings(canon: Canon, text: bytes, sizes: list[int], exact: list[int], last: bool = False):
    """(words, n, window hashes, good, kinds, named, exact) of a text for windows of each of `sizes` words.

    A capital at the start of a sentence is read as a literal and, in windows that have one, as a name (named). `exact`
    has the sizes of windows of the words as they are; last: these are wanted only if no other window is good.
    """
    words, h, kind, raw, opens = canon.of(text)
    some = False
    for n in sizes:
        if n > len(h) and not last:
            continue
        n = min(n, len(h))
        w, good = windows(h, kind, n)
        some |= bool(good.any())
        yield words, n, w, good, kind, False, False
        if opens.any():
            seen = np.concatenate([[0], np.cumsum(opens)])
            k = np.where(opens, NAME, kind).astype(np.int8)
            w, good = windows(np.where(opens, HOLDER[NAME], h), k, n)
            good &= seen[n:] > seen[: len(seen) - n]
            some |= bool(good.any())
            yield words, n, w, good, k, True, False
    for n in sizes if last and not some and len(h) else exact:
        if n <= len(h) or last:
            n = min(n, len(h))
            w = shingles(raw, n) ^ EXACT
            yield words, n, w, np.ones(len(w), bool), np.zeros(len(h), np.int8), False, True


def canonical_windows(rows: DataFrame, n: int, bits=None, sizes: tuple[int, ...] = (), exact: tuple[int, ...] = ()) -> DataFrame:
    """Windows of rows (id, text) with the values of their slots, in places counted from the window's first word.

    bits: a broadcast bit table; windows that aren't in it are left out. Without it the rows are items, which have
    exact windows if no other is good, and one window if they are shorter than n. sizes, exact: those of the items.
    """

    def run(batches):
        release()
        canon = Canon()
        table = np.frombuffer(bits.value, np.uint64) if bits else None
        for b in batches:
            out = []
            for i, t in zip(b.column(0), b.column(1)):
                i = i.as_py()
                for words, size, w, good, kind, named, whole in readings(canon, t.as_py(), list(sizes) or [n], list(exact), not bits):
                    if table is not None and len(w):
                        low = w & np.uint64(64 * BIT_WORDS - 1)
                        good = good & ((table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0)
                    for at in np.flatnonzero(good):
                        k = kind[at : at + size]
                        on = np.flatnonzero(k)
                        out.append((i, int(at), int(w[at].astype(np.int64)), [int(k[x]) for x in on], [core_of(words[at + x]) for x in on], named, whole, size))
            if out:
                c = list(zip(*out))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(c, types)], names=["id", "at", "hash", "kinds", "slots", "named", "exact", "size"])

    return rows.mapInArrow(run, WINDOW)


def bit_table(spark: SparkSession, items: DataFrame) -> bytes:
    word = F.shiftright(F.col("hash").bitwiseAND(F.lit(64 * BIT_WORDS - 1)), 6).alias("w")
    bit = F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")
    bits = np.zeros(BIT_WORDS, np.int64)
    found = items.select(word, bit).groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits[found["w"].to_numpy()] = found["bit"].to_numpy()
    return bits.tobytes()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE) -> DataFrame:
    """A row for each document and item that contaminates it: doc_id, item_id, n_windows, matched, coverage, changed_slots.

    changed_slots: the document has other slot values than the item. Null, empty or wordless texts and items match
    nothing; an item of fewer than n words is one window, sought at any place of a document, and one without a window that
    is half literal is sought by its words as they are. Documents or items that repeat an id count as one, whatever the length of a text. Empty tables
    give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "decontamination")
    items = canonical_windows(benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), as_bytes()), n)
    items = tables.write(items.toDF("item_id", "item_at", "hash", "item_kinds", "item_slots", "item_named", "item_exact", "item_size"), "items")
    bits = spark.sparkContext.broadcast(bit_table(spark, items))
    lengths = [(r.item_size, r.item_exact) for r in items.select("item_size", "item_exact").distinct().collect()]
    sizes, exact = (tuple(sorted(k for k, e in lengths if e == x)) for x in (False, True))
    found = canonical_windows(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), as_bytes()), n, bits, sizes or (n,), exact)
    found = tables.write(found.withColumnsRenamed({"id": "doc_id"}), "windows")
    # A document that covers `share` of an item's windows has one at least of any set of more than the rest. The items'
    # rarest windows name the pairs, so a window that many items and many documents have makes no pair by itself.
    common = items.groupBy("hash").agg(F.count_distinct("item_id").alias("common"))
    rare = items.join(common, "hash").groupBy("item_id", "item_at").agg(F.max("common").alias("common"))
    rare = rare.withColumn("i", F.row_number().over(Window.partitionBy("item_id").orderBy("common", "item_at"))).withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    rare = rare.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("item_id", "item_at")
    leads = items.join(rare, ["item_id", "item_at"]).select("hash", "item_id").distinct()
    pairs = tables.write(found.join(leads, "hash").select("doc_id", "item_id").distinct(), "pairs")
    hits = pairs.join(items, "item_id").join(found, ["doc_id", "hash"]).where((F.col("kinds") == F.col("item_kinds")) & (F.col("exact") == F.col("item_exact")) & (F.col("size") == F.col("item_size")))
    hits = hits.withColumn("gap", F.col("at") - F.col("item_at"))
    # Windows without a name at a sentence's start are held for consistency alone and together with those that have one.
    hits = hits.withColumn("line", F.explode(F.when(F.col("named") | F.col("item_named"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    # The sets are bounded by the item's length, whatever the number of matches.
    pairs = F.arrays_zip("item_slots", "slots")
    lines = hits.groupBy("doc_id", "item_id", "gap", "line").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    one_way = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"])))
    lines = lines.where(one_way).withColumn("changed", F.exists("pairs", lambda p: p["item_slots"] != p["slots"]))
    lines = lines.groupBy("doc_id", "item_id", "gap").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.bool_or("changed").alias("changed"))
    # Repeats of one passage in a document repeat its places only.
    places = lines.select("doc_id", "item_id", "changed", F.explode("places").alias("place"))
    got = places.groupBy("doc_id", "item_id").agg(F.count_distinct("place").alias("matched"), F.bool_and("changed").alias("changed_slots"))
    sizes = items.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_windows"))
    out = got.join(sizes, "item_id").withColumn("coverage", F.col("matched") / F.col("n_windows"))
    return out.where(F.col("coverage") >= share).select("doc_id", "item_id", "n_windows", "matched", "coverage", "changed_slots")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
