import corpus_pipeline as p
from pyspark.sql import functions as F

from sparkforge.llm.op01_mixing import targets
from sparkforge.llm.op06_quality_rules import counts

from .test_near_duplicates import brute


def test_stages_one_by_one(spark, sf, tmp_path):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        assert name == "token_planes" or out.columns == list(p.COLUMNS)
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
    first = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    clean = kept["quality_rules"].collect()
    assert all(first[r.doc_id] == r for r in clean)
    for r in clean:
        n, *_, repeated, _, _, _ = counts(r.text)
        assert n >= 20 and 100 * repeated <= 30 * n
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = set(first) - {r.doc_id for r in clean}
    assert all(labels[i] == 0 for i in gone if i in labels and len(first[i].text.split()) >= 20)
    one = {i for i, _, _, stays in brute([(r.doc_id, r.text) for r in clean], 5, 80) if stays}
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == one
    items = [" ".join(b.text.split()[1:-1]) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in kept["decontamination"].collect()}
    leaked = {i for i in one if any(f" {x} " in " " + " ".join(first[i].text.split()) + " " for x in items)}
    assert leaked and not leaked & left and len(left) > 0.8 * len(one)
    mixed = kept["mixing"].withColumn("w", F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')")).collect()
    size, taken = {}, {}
    for i in left:
        size[first[i].source] = size.get(first[i].source, 0) + len(first[i].text.encode().split())
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + r.w
    names = sorted(size)
    most = max(len(first[i].text.encode().split()) for i in left)
    assert all(abs(taken.get(s, 0) - t) <= most for s, t in zip(names, targets([size[s] for s in names])))
    tokens = sorted(kept["token_planes"].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in tokens] == sorted(r.doc_id for r in mixed)
    assert [r.start for r in tokens] == [sum(x.n_tokens for x in tokens[:k]) for k in range(len(tokens))]


def test_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone long, row string, shard int"
    good = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, good, "en", None, 1), (3, good, "en", None, 1), (4, good, None, "a", 1), (None, good, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 1, "r", 2) for r in rows], schema)
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        ids = sorted(r.doc_id or 0 for r in docs.collect())
        assert ids == {"quality_rules": [0, 3, 3, 4], "near_duplicates": [0, 3], "decontamination": [0, 3]}.get(name, ids)
    for name, stage in p.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0
