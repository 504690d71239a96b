"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins at quantiles of the training rows. Boosting goes round the features in turn;
each step fits a shallow tree to the gradient over one feature's bins and adds it to that feature's lookup table. Then the
pairs of features with the largest remaining gain get tables of two dimensions the same way. A score is the logistic of
the intercept and one table entry for each feature and pair, added up for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, as_bytes

FEATURES = ("log_words", "word_length", "length_spread", "symbols", "equal_lines", "distinct", "top_word", "upper", "shouts", "bars", "digits", "stops", "line_words", "neighbours", "non_ascii", "marked_ends", "capitals")
#: Labelled rows that the fit takes at most, the first in the order of a hash of their ids.
SAMPLE = 20_000
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"


def features(text: bytes) -> tuple[float, ...]:
    """Counts of a text, as shares where that makes them independent of its length. No words: all zero."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper = capitals = ends = 0
    for w, c in seen.items():
        if w[-1] in SYMBOLS:
            ends += c
        s = w.decode("utf-8", "replace")
        if s[0].isupper():
            capitals += c
            if len(s) > 1 and s.isupper():
                upper += c
    chars = lengths.sum()
    same = sum(map(bytes.__eq__, words, words[1:]))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    ascii_only = len(text) if text.isascii() else len(text.decode("utf-8", "ignore").encode("ascii", "ignore"))
    return (
        float(np.log1p(n)), chars / n, float(lengths.std()), symbols / chars, 1 - len(set(lines)) / len(lines), len(seen) / n, max(seen.values()) / n,
        upper / n, text.count(b"!!") / n, text.count(b" | ") / n, digits / chars, (text.count(b".") + text.count(b",")) / n, float(np.log1p(n / len(lines))),
        same / n, 1 - ascii_only / len(text), ends / n, capitals / n,
    )


def feature_table(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, x array<double>"

    def run(batches):
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes()).mapInArrow(run, schema)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float = 1.0) -> np.ndarray:
    """Values of a tree over the bins of one feature: best-first splits of the bins' sums of gradients and curvatures."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            more = gain(a, k) + gain(k, b) - gain(a, b)
            j = int(more.argmax())
            if more[j] > best[0]:
                best = (more[j], (i, int(k[j])))
        if best[1] is None:
            break
        i, k = best[1]
        a, b = parts.pop(i)
        parts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


class Model:
    """Edges of bins, lookup tables of features and of pairs, intercept."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, rounds: int = 60, pairs: int = 5, pair_rounds: int = 30, rate: float = 0.2, leaves: int = 3):
        self.bins, self.pair_bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.leaves = bins, pair_bins, rounds, pairs, pair_rounds, rate, leaves

    @staticmethod
    def cut(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        y = np.asarray(y, float)
        x = np.asarray(x, float).reshape(len(y), -1) if len(y) else np.zeros((0, 0))
        quantiles = lambda n: [np.unique(np.quantile(c, np.arange(1, n) / n)) for c in x.T] if len(y) else []
        self.edges, self.pair_edges, self.pairs, self.pair_tables = quantiles(self.bins), quantiles(self.pair_bins), [], []
        base = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(base / (1 - base)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not len(y) or y.min() == y.max():
            return self
        b, f = self.cut(x, self.edges), np.full(len(y), self.intercept)

        def slopes():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                g, h = (np.bincount(b[:, j], v, len(table)) for v in slopes())
                step = self.rate * shallow_tree(g, h, self.leaves)
                table += step
                f += step[b[:, j]]
        q = self.cut(x, self.pair_edges)
        g, h = slopes()
        rank = []
        for i, j in combinations(range(x.shape[1]), 2):
            w = len(self.pair_edges[j]) + 1
            key, size = q[:, i] * w + q[:, j], (len(self.pair_edges[i]) + 1) * w
            rank.append((float((np.bincount(key, g, size) ** 2 / (np.bincount(key, h, size) + 5)).sum()), i, j))
        self.pairs = [(i, j) for _, i, j in sorted(rank, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1)) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                g, h = (np.bincount(q[:, i] * table.shape[1] + q[:, j], v, table.size).reshape(table.shape) for v in slopes())
                # The first split goes along one feature, each side is split along the other.
                first = shallow_tree(g.sum(1), h.sum(1), 2)
                step = np.zeros_like(table)
                for value in np.unique(first):
                    on = first == value
                    step[on] = shallow_tree(g[on].sum(0), h[on].sum(0), 2)
                step *= self.rate
                table += step
                f += step[q[:, i], q[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        b = self.cut(x, self.edges)
        for j, table in enumerate(self.tables):
            f += table[b[:, j]]
        if self.pairs:
            q = self.cut(x, self.pair_edges)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                f += table[q[:, i], q[:, j]]
        return 1 / (1 + np.exp(-f))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled documents that aren't held out, `sample` of them at most. Null texts are empty and get a score
    too. Null labels, labels without a document and documents without an id teach nothing; without labels of both kinds
    every score is the same. Rows that repeat an id are scored one by one. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = Tables(spark, "classifier").write(feature_table(docs), "features")
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))
    known = known.where(~held_out()).withColumn("h", F.xxhash64("doc_id"))

    def first(most: int) -> list:
        return rows.join(known.where(F.col("h") <= most), "doc_id").orderBy("h", "doc_id").limit(sample).select("x", "y").collect()

    # The labels with the lowest hashes, one and a half times what is wanted, so that no task sends more than its share of
    # these; all of them only if too many have no document.
    n = known.count()
    share = min(1.0, 1.5 * sample / n) if n else 1.0
    train = first(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))
    if len(train) < sample and share < 1:
        train = first((1 << 63) - 1)
    model = Model().fit(np.array([r.x for r in train]), np.array([r.y for r in train]))
    shipped = spark.sparkContext.broadcast(vars(model))

    def run(batches):
        model = Model()
        vars(model).update(shipped.value)
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
