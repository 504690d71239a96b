import random

import pytest
from pyspark.sql import functions as F

from sparkforge.llm.common import Tables, components
from sparkforge.llm.op10_minhash_dedup import near_duplicates, tiles

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "ri", "po") for b in ("n", "r", "s", "l", "m", "t", "x", "z", "ra", "ko")]
CLASHING = "doc_id long, text string, lang string, source string, key string, sig int, bands string, root long, chain long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "k", 1, "b", 2, 3) for i, t in rows], CLASHING)


def shingle_set(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    group = {i: i for i, _ in rows}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                x, y = top(sets[a][0]), top(sets[b][0])
                group[max(x, y)] = min(x, y)
    return {(i, len(s), top(i), i == top(i)) for i, s in sets}


def got(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def families(seed, count, copies, edits):
    rng, rows, k = random.Random(seed), [], 0
    for _ in range(count):
        base = [rng.choice(WORDS) for _ in range(rng.randint(25, 80))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_same_as_brute_force(spark, n):
    rows = families(n, 20, 5, 5)
    assert got(near_duplicates(frame(spark, rows), n, 80)) == brute(rows, n, 80)


def test_one_large_group_of_copies_with_edits(spark):
    """Very many pairs lie just below and just above the similarity."""
    rows = families(7, 1, 220, 9)
    assert got(near_duplicates(frame(spark, rows), 2, 80)) == brute(rows, 2, 80)


@pytest.mark.parametrize("n", [2, 5])
def test_documents_same_as_brute_force(spark, sf, n):
    """All pairs of the documents that share a shingle, by exact Jaccard: no link is lost and none is made up."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_duplicates(docs, n, 80)) == brute(rows, n, 80)


def test_tiles_hold_every_pair_once(spark):
    few = [(k, p, [k, p]) for k, f in ((1, 30), (2, 1), (3, 2)) for p in range(f)]
    whole = [(k, p, [k, p]) for k, w in ((1, 50), (2, 9), (4, 5)) for p in range(w)]
    out = tiles(spark.createDataFrame(few, "k long, part long, few array<long>"), spark.createDataFrame(whole, "k long, part long, whole array<long>"), ["k"])
    pairs = [(*r.few, r.whole[1]) for r in out.collect()]
    assert sorted(pairs) == sorted((k, p, q) for k, p, _ in few for j, q, _ in whole if j == k)
    assert max(r["count"] for r in out.groupBy("few").count().collect()) == 50


def test_edges(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Word"), (5, "word"), (6, "a b"), (7, "A  B"), (8, long), (9, long + " x"), (10, long), (10, long)]
    out = near_duplicates(frame(spark, rows), 2, 80).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[5] == (1, 4, False) and by[7] == (1, 6, False) and by[9][1] == 8 and by[10][1] == 8 and not by[10][2]


def test_null_ids_and_empty_table(spark):
    out = near_duplicates(frame(spark, [(None, "a b c"), (1, "a b c"), (None, None)]), 2, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id) == [(1, 1, True)] and len(out) == 3
    assert near_duplicates(frame(spark, []), 2, 80).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(edges, "u long, v long")
    out = {r.node: r.component for r in components(df, Tables(spark, "test")).collect()}
    assert {out[i] for i in range(41)} == {0} and {out[i] for i in range(100, 140)} == {100} and {out[i] for i in (200, 201, 202)} == {200}
    assert components(df.where(F.lit(False)), Tables(spark, "test")).count() == 0
