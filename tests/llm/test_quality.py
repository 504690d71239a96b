import random

import numpy as np
import pytest

from sparkforge.llm.op05_quality_classifier import Model, features, quality_scores, shallow_tree
from sparkforge.llm.op06_quality_rules import counts, fences, quality_rules, repeated_words, sketches

SCHEMA = "doc_id long, text string, lang string, source string, n_words int, kept string, fence int, row string, x int, y string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, "r", 3, "y", "s") for r in rows], SCHEMA)


def repeated_brute(words, n=8):
    wins = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    on = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            on |= set(range(i, i + n))
    return len(on)


def test_repeated_words():
    rng = random.Random(2)
    for k in range(40):
        w = [rng.choice("abc"[: 1 + k % 3]) for _ in range(rng.randint(0, 60))]
        assert repeated_words(w) == repeated_brute(w)


def test_counts():
    assert counts("Ab é#*\n\nAb é#*\nx y\x0bz !!") == (7, 16, 4, 1, 0, 3, 6, 2)
    assert counts(None) == counts("") == (0,) * 8 and counts(" \t\n")[:2] == (0, 0)


CLEAN = "the cat sat on a mat and then it ran to the old house near town where people talk of many things every day".split()


def text(rng, n=60):
    return " ".join(rng.choice(CLEAN) + str(rng.randint(0, 99)) for _ in range(n)) + "."


def test_clean_stays_and_junk_goes(spark):
    rng = random.Random(4)
    rows = [(i, text(rng), "en" if i % 2 else None, "a" if i % 3 else None) for i in range(120)]
    junk = {200: "x### y*** " * 40, 201: " ".join(w.upper() + "!!" for w in text(rng).split()), 202: " | ".join(text(rng).split()), 203: "same line of words\n" * 30, 204: "go " * 90, 205: "short text", 206: None, 207: ""}
    out = {r.doc_id: r for r in quality_rules(frame(spark, rows + [(i, t, "en", "a") for i, t in junk.items()])).collect()}
    assert len(out) == 128 and all(out[i].kept for i in range(120)) and not any(out[i].kept for i in junk)
    assert out[206].base_failed and out[206].n_words == 0


def test_sketches_of_parts_merge(spark):
    rows = [(i, text(random.Random(i)), "en", "a") for i in range(50)]
    from sparkforge.llm.op06_quality_rules import SCORES, score

    def sketch(part):
        scored = quality_rules(frame(spark, part))
        return sketches(scored.select("lang", "source", *(score(k).alias(f"s_{k}") for k in SCORES)))

    a, b = sketch(rows[:20]), sketch(rows[20:])
    both = a.union(b).groupBy("lang", "source", "score", "bin").sum("n").withColumnRenamed("sum(n)", "n")
    assert fences(both).collect() == fences(sketch(rows)).collect()


def test_fences_differ_between_groups_and_decide(spark):
    rng = random.Random(6)
    plain = [(i, "".join(w + rng.choice((" ", " ", ", ")) for w in text(rng).split()), "en", "prose") for i in range(60)]
    code = [(100 + i, " ".join(w + rng.choice(("();", "{}", "=[]")) for w in text(rng).split()), "en", "code") for i in range(60)]
    same = " ".join(w + "();" for w in text(rng).split())
    rows = quality_rules(frame(spark, [*plain, *code, (200, same, "en", "prose"), (201, same, "en", "code")])).collect()
    out = {r.doc_id: r for r in rows}
    assert not out[200].kept and out[201].kept and out[200].x_marks.high * 2 < out[201].x_marks.high
    assert all(out[r[0]].kept for r in plain + code) and {r.x_word_length.level for r in rows} == {0}


def test_small_groups_take_the_fence_of_their_language(spark):
    rng = random.Random(7)
    rows = [(i, text(rng), "en", "big") for i in range(60)] + [(100 + i, text(rng), "en", f"s{i}") for i in range(5)] + [(200, text(rng), "xx", "s0"), (201, "a!!! " * 3 + " ".join(w + "###" for w in text(rng).split()), "xx", "s0")]
    out = {r.doc_id: r for r in quality_rules(frame(spark, rows)).collect()}
    assert [out[i].x_word_length.level for i in (0, 100, 200)] == [0, 1, 2]
    assert out[100].x_word_length.high == out[104].x_word_length.high and not out[201].kept and out[200].kept


def test_fences_of_the_corpus_come_from_its_groups(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    fence = quality_rules(docs).where("x_marks is not null").select("lang", "source", "x_marks", "x_word_length").distinct().collect()
    assert sum(r.x_marks.level == 0 for r in fence) * 10 > 9 * len(fence)
    assert len({(r.x_marks.high, r.x_word_length.low, r.x_word_length.high) for r in fence}) * 2 > len(fence)


def test_rules_edges(spark):
    assert quality_rules(frame(spark, [])).collect() == []
    rows = [(None, "a b", None, None), (1, "a " * 200_000, "en", "s"), (1, "a " * 200_000, "en", "s")]
    assert [r.kept for r in quality_rules(frame(spark, rows)).collect()] == [False] * 3
    carried = quality_rules(frame(spark, rows), carry=("doc_id", "kept")).select("row.*").collect()
    assert [r.kept for r in carried] == ["k"] * 3


def test_shallow_tree_finds_the_step():
    g, h = np.array([1.0, 1, 1, -1, -1, -1]), np.ones(6)
    out = shallow_tree(g, h, 2, 0.0)
    assert np.allclose(out, [1, 1, 1, -1, -1, -1])


def test_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (2000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    model = Model().fit(x[:1500], y[:1500])
    assert (0, 1) in model.pairs and ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.85
    by_hand = model.intercept + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, x[0])) + sum(t[np.searchsorted(model.pair_edges[i], x[0, i], "right"), np.searchsorted(model.pair_edges[j], x[0, j], "right")] for (i, j), t in zip(model.pairs, model.pair_tables))
    assert abs(model.score(x[:1])[0] - 1 / (1 + np.exp(-by_hand))) < 1e-12


def test_features_of_odd_texts():
    for t in (b"", b" \n", b"\xff\xfe bad bytes", "é ñ".encode(), b"a" * 100_000):
        f = features(t)
        assert len(f) == 17 and np.isfinite(f).all()


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    out = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 40 and sum(r.predicted == r.quality for r in out) / len(out) > 0.95


def test_sample_is_the_first_by_hash(spark, monkeypatch):
    """Whatever share of the labels is looked at first, also if most of them have no document."""
    import sparkforge.llm.op05_quality_classifier as m

    docs = frame(spark, [(i, f"word{i} " * (i % 7 + 1), "en", "a") for i in range(400)])
    seen = []
    fit = Model.fit
    monkeypatch.setattr(m.Model, "fit", lambda self, x, y: seen.append(sorted(map(tuple, np.round(x, 9)))) or fit(self, x, y))
    for ids in (range(400), [*range(30), *range(10_000, 14_000)]):
        labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
        quality_scores(docs, labels, sample=20)
        seen_small = seen.pop()
        order = docs.join(labels, "doc_id").where(~m.held_out()).selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").limit(20)
        want = m.feature_table(docs).join(order, "doc_id").select("x").collect()
        assert seen_small == sorted(map(tuple, np.round([r.x for r in want], 9)))


def test_scores_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = quality_scores(frame(spark, [(1, None, None, None), (2, "", "en", "a"), (None, "x", "en", "a"), (2, "", "en", "a")]), labels).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_scores(frame(spark, []), labels).collect() == []
    same = quality_scores(frame(spark, [(1, "a", "en", "a"), (2, "b c", "en", "a")]), labels.where("quality = 5")).collect()
    assert same[0].score == same[1].score == pytest.approx(0.5)
