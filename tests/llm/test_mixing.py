from collections import defaultdict

import numpy as np

from sparkforge.llm.op01_mixing import mix, plan, splitting_tree, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, target string, copies int, bounds int, shard string, turn int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "r", "t", 7, 8, "s", 9) for i, t, s in rows], SCHEMA)


def test_targets_by_repeated_resharing():
    sizes = [100, 1, 50, 0, 1000, 3]
    out = targets(sizes)
    weights, left, want = [1, 2, 3, 1, 2, 3], float(sum(sizes)), [None] * 6
    while True:
        free = [i for i in range(6) if want[i] is None]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 3 * sizes[i]]
        if not over:
            break
        for i in over:
            want[i] = 3.0 * sizes[i]
            left -= want[i]
    want = [share[i] if w is None else w for i, w in enumerate(want)]
    assert np.allclose(out, want) and abs(sum(out) - sum(sizes)) < 1e-6


def test_tree_keeps_quotas():
    q = splitting_tree([100, 0, 7, 33], 5)
    assert q.sum(0).tolist() == [100, 0, 7, 33] and q.sum(1).max() - q.sum(1).min() <= 1
    assert (q == splitting_tree([100, 0, 7, 33], 5)).all()


def rows_of(n=600):
    sources = ["b", "a", "é", None, "c"]
    return [(i, "w " * (i % 40 + 1), sources[0] if i % 3 == 0 else sources[i % 5]) for i in range(n)]


def test_plan_comes_near_its_targets(spark):
    out = plan(frame(spark, rows_of())).collect()
    assert len(out) == 600 and {(r.doc_id, r.size) for r in out} == {(i, i % 40 + 1) for i in range(600)}
    taken, target, size = defaultdict(int), {}, {}
    for r in out:
        assert r.taken == r.size * r.copies <= 3 * r.size and len(r.shards) == r.copies
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    want = dict(zip(["a", "b", "c", "é", None], targets([size[s] for s in ["a", "b", "c", "é", None]])))
    assert all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 40 for s in want)
    assert sorted(map(tuple, ((r.doc_id, r.taken, *r.shards) for r in out))) == sorted(map(tuple, ((r.doc_id, r.taken, *r.shards) for r in plan(frame(spark, rows_of())).collect())))


def test_mix_draws_what_the_plan_says(spark):
    docs = frame(spark, rows_of())
    want = sorted((r.doc_id, s) for r in plan(docs, shards=8).collect() for s in r.shards)
    out = mix(docs.drop("shard"), shards=8)
    assert sorted((r.doc_id, r.shard) for r in out.collect()) == want and out.columns[:3] == ["doc_id", "text", "lang"]


def test_edges(spark):
    out = plan(frame(spark, [(1, None, "a"), (2, "", "a"), (3, "x y", None), (None, "q", "b"), (3, "x y", None)])).collect()
    assert sorted((r.doc_id or 0, r.size) for r in out) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert plan(frame(spark, [])).collect() == [] and mix(frame(spark, []).drop("shard")).collect() == []
    assert all(r.taken == 0 for r in plan(frame(spark, [(1, None, "a")])).collect())
