"""Quality rules with thresholds that adapt to each language and source.

Each text gives counts; four of them become scores. Per (lang, source) a quantile sketch of each score over the texts
that pass the base rules is a histogram of whole numbers: counts of equal bins add, so sketches of parts merge exactly,
in any order, and reruns agree. The fences of a group are its quartiles less or plus `slope` times their distance. No
cutoff is fixed: what is much punctuation, or a long word, is what lies far from the middle half of its own group.

A group of fewer than `least` texts, or one whose middle half is a single value, takes the fence of its language's
sketch, then that of the whole corpus, both merged from those of the groups. A score that varies nowhere sets no fence.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX1, SPACES, Tables, mix, release

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_marks long, n_capitals long"
SYMBOLS = "#*$%&|<>"
#: Score: (numerator, denominator, unit, whether a fence below holds too).
SCORES = {
    "marks": ("n_marks", "word_chars", 10_000, False),
    "capitals": ("n_capitals", "word_chars", 10_000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False),
    "word_length": ("word_chars", "n_words", 100, True),
}
#: Highest bin of a sketch; bounds its size.
BINS = 10_000
#: Quartile distances beyond a quartile; at 4 one labelled good text in 400 is lost, at 6 one in 1,500.
SLOPE = 6
LEAST = 30
WINDOW = 8


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words in windows of `window` words that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(window):
            h = mix(h * MIX1 + a[i : i + n].astype(np.uint64) + np.uint64(1))
    if len(np.unique(h)) == n:
        return 0
    # Windows are renamed by doubling: equal names exactly where the words are equal.
    name, length = a, 1
    while length < window:
        step = min(length, window - length)
        m = len(a) - (length + step) + 1
        pair = name[:m] * (int(name.max()) + 1) + name[step : step + m]
        name = np.unique(pair, return_inverse=True)[1]
        length += step
    twice = np.bincount(name)[name] > 1
    if not twice.any():
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks)[: len(words)] > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in raw.split(b"\n") if x.split()]
    marks, capitals = (len(raw) - len(raw.translate(None, x.encode())) for x in (string.punctuation, string.ascii_uppercase))
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), marks, capitals


def score(name: str):
    top, bottom, unit, _ = SCORES[name]
    return F.when(F.col(bottom) > 0, F.expr(f"least({BINS}, {top} * {unit} div {bottom})")).otherwise(F.lit(0)).cast("int")


def sketches(scored: DataFrame) -> DataFrame:
    """Histogram rows (lang, source, score, bin, n). Those of any two parts of a corpus merge by adding n."""
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("score"), F.col(f"s_{k}").alias("bin")) for k in SCORES))).alias("x")
    return scored.select("lang", "source", bins).groupBy("lang", "source", "x.score", "x.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, slope: int = SLOPE, least: int = LEAST) -> DataFrame:
    """(lang, source, x_<score>: struct of low, high, level); level 0 is the group's own sketch, 1 its language's, 2 all."""

    def quartiles(level: int, *by: str) -> DataFrame:
        merged = sketch.groupBy(*by, "score", "bin").agg(F.sum("n").alias("n"))
        # A sketch has at most BINS + 1 rows, whatever the number of documents.
        g = merged.groupBy(*by, "score").agg(F.expr("sort_array(collect_list(struct(bin, n)))").alias("h"), F.sum("n").alias("total"))
        rank = lambda q: F.expr(f"aggregate(h, named_struct('seen', 0L, 'at', -1), (a, x) -> named_struct('seen', a.seen + x.n, 'at', if(a.at < 0 and (a.seen + x.n) * 4 >= total * {q}, x.bin, a.at))).at")
        g = g.select(*by, "score", "total", rank(1).alias("q1"), rank(3).alias("q3"))
        fence = F.struct((F.col("q1") - slope * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + slope * (F.col("q3") - F.col("q1"))).alias("high"), F.lit(level).alias("level"))
        return g.select(*by, "score", F.when((F.col("total") >= least) & (F.col("q3") > F.col("q1")), fence).alias(f"x{level}"))

    own, lang, whole = quartiles(0, "lang", "source"), quartiles(1, "lang").withColumnsRenamed({"lang": "l", "score": "k"}), quartiles(2)
    g = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("score") == F.col("k")), "left").join(whole, "score", "left")
    return g.groupBy("lang", "source").agg(*(F.max(F.when(F.col("score") == k, F.coalesce("x0", "x1", "x2"))).alias(f"x_{k}") for k in SCORES))


def quality_rules(docs: DataFrame, slope: int = SLOPE, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: counts, base_failed, scores s_*, fences x_*, kept, and `row`, a struct of the carried columns.

    A share of few characters or lines is uncertain, so one above its fence is rejected only if it is by more than twice
    the square root of the number that the fence allows. A null text counts as empty and fails the base rule (no words).
    Null lang or source form groups of their own. Rows that repeat are judged one by one alike. An empty table gives no
    rows. Other columns are not looked at.
    """
    names = [x.split()[0] for x in COUNTS.split(", ")]
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    rows = docs.select(*cols, *(F.col(c).alias(f"_{c}") for c in carry))
    schema = COUNTS + ", lang string, source string" + "".join(f", _{c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        release()
        for b in batches:
            got = [counts(t.as_py()) for t in b.column(1)]
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * 8)), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "lang", "source", *(f"_{c}" for c in carry)])

    got = rows.mapInArrow(run, schema)
    if carry:
        got = got.withColumn("row", F.struct(*(F.col(f"_{c}").alias(c) for c in carry))).drop(*(f"_{c}" for c in carry))
    got = got.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    got = got.withColumns({f"s_{k}": score(k) for k in SCORES})
    tables = Tables(docs.sparkSession, "quality")
    got = tables.write(got, "counts")
    limits = tables.write(fences(sketches(got.where("not base_failed")), slope, least).withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), "fences")
    out = got.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    bad = F.lit(False)
    for k, (top, bottom, unit, both) in SCORES.items():
        if both:
            bad = bad | F.expr(f"s_{k} > x_{k}.high or s_{k} < x_{k}.low")
        else:
            over, room = f"double({top}) * {unit} - double(x_{k}.high) * {bottom}", f"4D * {unit} * x_{k}.high * {bottom}"
            bad = bad | F.expr(f"s_{k} > x_{k}.high and ({over}) * ({over}) > {room}")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).drop("g_lang", "g_source")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
