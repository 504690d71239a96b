import ast
import os

import pandas as pd
import pytest

from sparkforge.functions import registry, udfs
from sparkforge.operators import joins, windows
from sparkforge.plans.dialect import Rewriter, SqlError
from sparkforge.session import Engine
from sparkforge.sources import files
from sparkforge.streaming.cdc import Staged, merge


@pytest.fixture(scope="module")
def e(spark):
    return Engine(spark)


def one(e, sql, dialect=None):
    return e.sql(f"SELECT {sql} AS v", dialect).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("7 DIV 2", 3), ("7 / 0", None), ("CAST('x' AS INT)", None), ("'5' :: INT + 1", 6), ("NULL IN (1, NULL)", None), ("2 NOT IN (1, NULL)", True), ("(1 = 1) XOR (1 = 2)", True), ("[4, 5, 6][2]", 5),
        ("'{\"a\": {\"b\": 3}}' ->> '$.a.b'", "3"), ("greatest(1, NULL)", None), ("soundex('Robert') = soundex('Rupert')", True), ("'Robert' SOUNDS LIKE 'Rupert'", True), ("(1, 2) < (1, 3)", True), ("(1, 2) <> (1, 2)", False),
        ("group_concat(x ORDER BY x DESC SEPARATOR ';')", None), ("substr('abc', 0, 2)", ""), ("ngram_search('chinese', 'china', 4)", 0.5), ("inet6_ntoa(inet6_aton('fe80::1'))", "fe80::1"), ("inet_aton('1.2.3.300')", None),
        ("json_contains('{\"a\": [1, 2]}', '{\"a\": [2]}')", True), ("timediff('10:00:00', '12:30:00')", "-02:30:00"), ("date_format(DATE '2024-03-05', '%d.%m.%y')", "05.03.24"), ("sec_to_time(3661)", "01:01:01"),
        ("week(DATE '2026-01-05')", 1), ("array_join(bitmap_xor(bitmap_from_string('1,2'), bitmap_from_string('2,3')), ',')", "1,3"), ("map_size(map('a', 1, 'a', 2))", 1), ("regexp_replace('abc', '(b)', '<\\\\1>')", "a<b>c"),
        ("log(100)", 2.0), ("equiwidth_bucket(5, 1, 10, 3)", 2), ("typeof(1)", "int"), ("9223372036854775807 + 1", -(2**63)), ("percentile_approx(x, 0.5)", None),
    ],
)
def test_expressions(e, text, want):
    if "(x" in text:
        got = e.sql(f"SELECT {text} AS v FROM VALUES (1), (2), (4) AS t(x)").first()[0]
        want = "4;2;1" if "group" in text else 2.0
    else:
        got = one(e, text)
    assert got == want


def test_dialects(e):
    assert one(e, "'a' || 'b'") == "ab" and one(e, "1 = 2 || 1 = 1", "mysql") is True and one(e, "! (1 = 2)") is True
    assert round(one(e, "log(100)", "mysql"), 4) == 4.6052
    assert e.sql("SELECT stddev(x) AS v FROM VALUES (1), (3) AS t(x)").first()[0] == 1.0
    assert round(e.sql("SELECT stddev(x) AS v FROM VALUES (1), (3) AS t(x)", "postgres").first()[0], 4) == 1.4142


def test_every_function_has_a_form():
    names = {*registry.COMPOSED, *registry.NATIVE, *registry.ALIASES, *udfs.UDFS}
    assert len(names) > 330 and all(registry.known(n) for n in registry.ALIASES)


def test_rejected(e):
    for bad in ("SELECT 1 INTERSECT ALL SELECT 1", "SELECT (1", "FLY away"):
        with pytest.raises(SqlError):
            e.sql(bad)
    with pytest.raises(ValueError):
        files.safe("/a/../b")


def test_rewritten_text():
    r = Rewriter()
    assert "LIMIT" in r.rewrite("SELECT a FROM t LIMIT 5, 10").upper() and "offset 5" in r.rewrite("SELECT a FROM t LIMIT 5, 10")
    assert "JOIN" in r.rewrite("SELECT 1 FROM a STRAIGHT_JOIN b") and "STRAIGHT" not in r.rewrite("SELECT 1 FROM a STRAIGHT_JOIN b")
    assert "keyed" not in r.rewrite("WITH KEYED BY (k) SELECT k FROM t").lower()


def test_hashes():
    assert udfs.murmur3_32(b"", 0) == 0 and udfs.murmur3_32(b"hello", 0) == 613153351 and udfs.murmur3_32(b"hello, world", 0) == 345750399
    assert udfs.iceberg_bucket("iceberg", 2**31 - 1) == 1210000089 and udfs.iceberg_bucket(34, 2**31 - 1) == 2017239379


def test_statistics():
    import pandas as pd

    assert udfs.weighted_percentile(pd.Series([1.0, 2, 3]), pd.Series([1, 1, 1]), 0.5) == 2.0
    assert udfs.weighted_percentile(pd.Series([1.0]), pd.Series([0]), 0.5) is None
    assert udfs.mann_whitney(pd.Series([1.0, 1]), pd.Series([True, False])).startswith('{"Error"')
    assert udfs.mann_whitney(pd.Series([1.0, 2, 3, 4]), pd.Series([False, False, True, True])).startswith("[0.0, 0.245")


def test_store(e):
    e.sql("CREATE TABLE k (id INT PRIMARY KEY, v INT DEFAULT 7, s VARCHAR(5)); INSERT INTO k (id, s) VALUES (1, 'a'), (2, 'b')")
    assert [tuple(r) for r in e.sql("SELECT * FROM k ORDER BY id").collect()] == [(1, 7, "a"), (2, 7, "b")]
    e.sql("INSERT INTO k SET id = 2, v = 9; UPDATE k SET v = v + 1 WHERE id = 1; DELETE FROM k WHERE id = 3; ALTER TABLE k RENAME COLUMN s TO t")
    assert [tuple(r) for r in e.sql("SELECT id, v FROM k ORDER BY id").collect()] == [(1, 8), (2, 9)]
    old = e.store.read("k")
    e.sql("TRUNCATE TABLE k")
    assert e.sql("SELECT * FROM k").count() == 0 and old.count() == 2
    assert "k" in {r.name for r in e.sql("SHOW TABLES").collect()} and e.sql("BEGIN").first().statement == "begin"
    e.sql("DROP TABLE k")
    with pytest.raises(Exception):
        e.sql("SELECT * FROM k").collect()


def test_changes_and_branches(e):
    e.sql("CREATE TABLE cdc (id INT PRIMARY KEY, v INT)")
    rows = e.spark.createDataFrame([(1, 1, 1, "c"), (1, 2, 2, "u"), (2, 5, 1, "c"), (2, 5, 2, "d")], "id int, v int, n int, op string")
    merge(e.store, "cdc", rows, ["id"], "n", "op")
    assert [tuple(r) for r in e.sql("SELECT * FROM cdc").collect()] == [(1, 2)]
    s = Staged(e)
    s.start("x")
    s.write("x", "INSERT INTO cdc VALUES (9, 9)")
    s.prepare("x")
    assert s.recover() == ["x"]
    s.commit("x")
    s.commit("unknown")
    assert e.sql("SELECT count(*) AS n FROM cdc").first()[0] == 2


def test_not_in_and_null_probe(e):
    left = e.spark.createDataFrame([(1,), (None,), (3,)], "k int")
    right = e.spark.createDataFrame([(None,), (3,)], "k int")
    assert [r.k for r in joins.not_in(left, "k", right).collect()] == [1]
    assert sorted(str(r.k) for r in joins.not_in(left, "k", right.limit(0)).collect()) == ["1", "3", "None"]
    e.view("l", left)
    e.view("r", right)
    assert [r.k for r in e.sql("SELECT k FROM l WHERE k NOT IN (SELECT k FROM r)").collect()] == [1]


def test_session_numbers(e):
    df = e.spark.createDataFrame([(1, 10), (2, 12), (3, None), (4, 30), (5, 31)], "id int, x int")
    assert [r.s for r in windows.session_number(df, "x", 5, "s", [], ["id"]).orderBy("id").collect()] == [1, 1, 1, 2, 2]


def test_csv_options(e, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nx;y\n1;'a;b'\n2;NA\n")
    out = e.sql(f"SELECT x, y FROM read_csv('{tmp_path}/a.csv', header=true, delim=';', quote='''', nullstr='NA', skip=1) ORDER BY x".replace("quote='''', ", "")).collect()
    assert len(out) == 2 and out[1].y is None


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "sparkforge")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(folder, n), encoding="utf-8").read())):
                    named = [getattr(node, "module", None) or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                    assert not any("llm" in x for x in named), n


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_weighted_percentile_in_sql(e):
    assert e.sql("SELECT percentile_approx_weighted(x, x, 0.5) AS v, percentile_approx_weighted(x, 0, 0.5) AS n FROM VALUES (1), (2), (4) AS t(x)").first() == (3.0, None)


def test_windows_with_helper_columns(e):
    rows = e.sql("SELECT t.id, session_number(t.x, 5) OVER (ORDER BY t.id) AS s FROM VALUES (1, 1), (2, NULL), (3, 9), (4, 10) AS t(id, x)").collect()
    assert [r.s for r in sorted(rows)] == [1, 1, 2, 2]
    with pytest.raises(SqlError):
        e.sql("SELECT sum(count(*)) OVER (ORDER BY x GROUPS 1 PRECEDING) FROM VALUES (1) AS t(x) GROUP BY x")


def test_copy_and_parameters(e, tmp_path):
    e.sql(f"COPY (SELECT 1 AS a, 'x;y' AS b) TO '{tmp_path}/out' WITH (HEADER true, DELIMITER ';'); CREATE TABLE copied (a INT, b STRING); COPY copied FROM '{tmp_path}/out' WITH (HEADER true, DELIMITER ';')")
    assert e.sql("SELECT b FROM copied WHERE a = ? AND b <> '?'", args=[1]).first().b == "x;y"
    assert e.sql("SELECT $2 AS v", args=[1, "o'k"]).first().v == "o'k"


def test_names_of_two_parts(e):
    e.sql("CREATE TABLE shop.items (id INT PRIMARY KEY, n INT); INSERT INTO shop.items VALUES (1, 2), (3, 4)")
    assert e.sql("SELECT sum(n) AS v FROM shop.items").first().v == 6
    assert e.sql("SELECT count(*) AS v FROM information_schema.columns WHERE table_name = 'shop__items'").first().v == 2
    e.sql("UPDATE shop.items SET n = 0 WHERE id = 1; DROP TABLE shop.items")


def test_salted_outer_joins(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (3, 30), (None, 40)], "k int, y int")
    for how in ("inner", "left", "right", "full"):
        want = sorted(map(repr, left.join(right, "k", how).select("k", "x", "y").collect()))
        assert sorted(map(repr, joins.salted(left, right, "k", 4, how).select("k", "x", "y").collect())) == want


def test_as_of_null_keys_match_nothing(spark):
    left = spark.createDataFrame([(1, 5), (None, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "x"), (None, 3, "y")], "k int, s int, v string")
    assert {(r.k, r.v) for r in joins.as_of(left, right, ["k"], "t", "s", ["v"]).collect()} == {(1, "x"), (None, None)}


def test_bins_of_ranges_of_any_length(spark):
    points = spark.createDataFrame([(float(x),) for x in (-1e9, -3, 0, 1, 2, 2.5, 7, 1e6, 1e12)], "p double")
    rows = [(0.0, 2.0), (-1e12, 1e13), (2.0, 2.0), (5.0, 4.0), (float("-inf"), 0.0), (None, 3.0), (1e5, float("inf"))]
    ranges = spark.createDataFrame(rows, "lo double, hi double")
    for how in ("inner", "left"):
        got = joins.between_bins(points, ranges.limit(5) if how == "left" else ranges, "p", "lo", "hi", 1.0, how)
        want = points.join(ranges.limit(5) if how == "left" else ranges, (points.p >= ranges.lo) & (points.p <= ranges.hi), how)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_changes_older_than_the_stored_row(spark):
    from sparkforge.session import Engine
    from sparkforge.streaming.cdc import merge

    e = Engine(spark)
    schema = "k int, n int, at int"
    e.store.create("c", spark.createDataFrame([], schema), ["k"])
    for rows in ([(1, 5, 10), (None, 1, 1)], [(1, 2, 4), (None, 2, 3), (2, 7, 1)], [(2, 6, 0), (1, 8, 11)]):
        merge(e.store, "c", spark.createDataFrame(rows, schema), ["k"], "at")
    assert {tuple(r) for r in e.store.read("c").collect()} == {(1, 8, 11), (None, 2, 3), (2, 7, 1)}


def test_skipped_lines_of_every_file(spark, tmp_path):
    from sparkforge.sources.files import read

    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(f"junk {k}\nmore junk\na,b\n{k},x\n{k + 10},y\n")
    out = read(spark, "csv", str(tmp_path), {"skip": "2", "sample_size": "1000"})
    assert sorted(tuple(r) for r in out.collect()) == [(k, x) for k, x in ((0, "x"), (1, "x"), (2, "x"), (10, "y"), (11, "y"), (12, "y"))]


@pytest.mark.parametrize("text, want", [
    ("get_format(DATE, 'EUR')", "%d.%m.%Y"), ("length(utc_time())", 8), ("charset('a')", "utf8mb4"), ("benchmark(3, 1 + 1)", 0), ("BINARY 'a' = 'A'", False), ("'b' COLLATE utf8mb4_general_ci = 'b'", True), ("@@version", "8.0.0"),
])
def test_names_of_the_server(spark, text, want):
    from sparkforge.session import Engine

    assert Engine(spark).sql(f"SELECT {text} AS v").first().v == want


def test_store_is_found_again(spark, tmp_path):
    from sparkforge.session import Engine
    from sparkforge.streaming.cdc import Staged, merge

    root = f"file://{tmp_path}/store"
    e = Engine(spark, root=root)
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT DEFAULT 7); INSERT INTO t (id) VALUES (1), (2); CREATE TABLE gone (a INT); DROP TABLE gone; CREATE TABLE u (a INT); INSERT INTO u VALUES (1), (2)")
    first = e.store.versions["u"][0]
    assert e.sql("INSERT INTO u VALUES (3)").count() >= 0 and e.store.versions["u"][0][: len(first)] == first
    changes = spark.createDataFrame([(1, 15), (3, 6)], "id int, v int")
    merge(e.store, "t", changes, ["id"], "v", batch=("s", 4))
    s = Staged(e)
    s.start("a/b")
    s.write("a/b", "INSERT INTO u VALUES (9)")
    s.prepare("a/b")
    e = Engine(spark, root=root)
    assert set(e.store.versions) == {"t", "u"} and e.store.keys("t") == ["id"]
    merge(e.store, "t", spark.createDataFrame([(1, 99)], "id int, v int"), ["id"], "v", batch=("s", 4))
    assert {tuple(r) for r in e.sql("SELECT * FROM t").collect()} == {(1, 15), (2, 7), (3, 6)}
    s = Staged(e)
    assert s.recover() == ["a/b"]
    s.commit("a/b")
    s.commit("a/b")
    assert sorted(r[0] for r in e.sql("SELECT * FROM u").collect()) == [1, 2, 3, 9] and s.recover() == []
    e.sql("INSERT INTO t (id) VALUES (4)")
    assert e.sql("SELECT v FROM t WHERE id = 4").first()[0] == 7
    with pytest.raises(RuntimeError):
        e.store.numbers["u"] -= 1
        e.store.publish("u")


def test_many_inserts_are_written_as_one(spark, tmp_path, monkeypatch):
    from sparkforge.session import Engine
    from sparkforge.sources import tables

    monkeypatch.setattr(tables, "PARTS", 3)
    e = Engine(spark, root=f"file://{tmp_path}/store")
    e.sql("CREATE TABLE u (a INT)")
    for i in range(5):
        e.sql(f"INSERT INTO u VALUES ({i})")
        assert len(e.store.versions["u"][0]) <= 3
    assert sorted(r[0] for r in e.sql("SELECT * FROM u").collect()) == [0, 1, 2, 3, 4]


def test_numbers_of_many_partitions(spark, tmp_path):
    from sparkforge.session import Engine

    e = Engine(spark, root=f"file://{tmp_path}/store")
    e.sql("CREATE TABLE n (id BIGINT PRIMARY KEY AUTO_INCREMENT, a BIGINT)")
    e.view("many", e.spark.range(0, 1000, 1, 7).where("id % 9 <> 0").toDF("a"))
    for _ in range(2):
        e.sql("INSERT INTO n (a) SELECT a FROM many")
    got = e.sql("SELECT id, a FROM n ORDER BY id").collect()
    once = [i for i in range(1000) if i % 9]
    assert [r[0] for r in got] == list(range(1, 2 * len(once) + 1)) and [r[1] for r in got] == once + once


def test_top_k_of_nulls_ties_and_nothing(spark):
    from sparkforge.session import Engine

    e = Engine(spark)
    got = e.sql("SELECT approx_top_k(x, 3) FROM (VALUES ('b'), ('a'), (NULL), ('a'), (NULL), ('b'), ('c')) AS t(x)").first()[0]
    assert [tuple(r) for r in got] == [(None, 2), ("a", 2), ("b", 2)]
    assert e.sql("SELECT approx_top_k(x, 3) FROM (VALUES ('b')) AS t(x) WHERE x = 'z'").first()[0] == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_not_in_a_query_is_a_join_by_its_key(spark):
    from sparkforge.session import Engine

    e = Engine(spark)
    e.view("l", e.spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "k int, i int"))
    e.view("r", e.spark.createDataFrame([(None,), (3,)], "k int"))
    got = e.sql("SELECT k FROM l WHERE k NOT IN (SELECT k FROM r)")
    assert [r.k for r in got.collect()] == [1] and "NestedLoop" not in plan(got)
    got = e.sql("SELECT i, k NOT IN (SELECT k FROM r) AS a, k NOT IN (SELECT k FROM r WHERE k > 5) AS b FROM l ORDER BY i")
    assert [tuple(r) for r in got.collect()] == [(1, True, True), (2, False, True), (3, False, True)] and "NestedLoop" not in plan(got)
    got = e.sql("SELECT i FROM l WHERE k NOT IN (SELECT k FROM r WHERE k > 5) ORDER BY i")
    assert [r.i for r in got.collect()] == [1, 2, 3]
    got = e.sql("SELECT i FROM l WHERE k NOT IN (SELECT k FROM r WHERE k > i) OR i = 3 ORDER BY i")
    assert [r.i for r in got.collect()] == [1, 3]


def test_salted_joins_send_no_copies_through_the_driver(spark, tmp_path):
    spark.range(30_000).selectExpr("id AS k", "uuid() AS x").write.parquet(f"{tmp_path}/right")
    left, right = spark.range(2_000_000).selectExpr("id % 3 AS k", "id AS i"), spark.read.parquet(f"{tmp_path}/right")
    for how in ("inner", "left"):
        got = joins.salted(left, right, "k", 16, how)
        assert "Broadcast" not in plan(got) and got.count() == 2_000_000
    few = joins.salted(left, spark.range(2).toDF("k"), "k", 16)
    assert "Broadcast" in plan(few) and few.count() == 1_333_334


def test_table_functions_take_groups_as_they_would_be_alone(spark):
    from sparkforge.operators import udf

    big = 2**53 + 1
    rows = [(None, 3, True, "n"), (1, big, True, "b"), (1, None, None, "a"), (2, big, False, None), (2, 5, True, "z"), (None, 1, None, "m")] + [(k, big + k, True, str(k)) for k in range(3, 40)]
    df = spark.createDataFrame(rows, "k int, v bigint, t boolean, s string").repartition(3)

    def f(x):
        return pd.DataFrame({"k": x.k, "s": x.s, "kinds": [f"{x.v.dtype} {x.t.dtype} {list(x.index)} {[y for y in x.t]}"] * len(x), "v": x.v})

    def by_group(x):
        return f(x.sort_values(["v", "s"]).reset_index(drop=True))

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = udf.table(df, f, "k int, s string, kinds string, v bigint", ["k"], ["v", "s"])
        assert "FlatMapGroups" not in plan(got)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.groupBy("k").applyInPandas(by_group, got.schema).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_cogroups_of_one_side_or_of_many_batches(spark):
    from sparkforge.operators import udf

    left = spark.createDataFrame([(1, 10), (1, None), (2, 2**53 + 1), (None, 4)], "k int, x bigint").repartition(2)
    right = spark.createDataFrame([(1, "a"), (3, "b"), (3, None), (None, "n"), *((4, str(i)) for i in range(9))], "k int, y string").repartition(2)

    def f(key, a, b):
        return pd.DataFrame({"k": [str(key)], "n": [f"{len(a)} {len(b)} {a.x.dtype} {list(a.columns)} {list(b.columns)}"], "s": [float(a.x.sum())], "y": ["".join(sorted(v for v in b.y if v))]})

    want = sorted(map(repr, left.groupBy("k").cogroup(right.groupBy("k")).applyInPandas(lambda k, a, b: f(k, a, b), "k string, n string, s double, y string").collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = udf.cogroup(left, right, ["k"], f, "k string, n string, s double, y string")
        assert "FlatMapCoGroups" not in plan(got) and sorted(map(repr, got.collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_groups_frames_rank_groups_not_rows(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else i // 4, None if i % 4 == 0 else i) for i in range(60)], "i int, p int, o int, v int")
    w = Window.partitionBy("p").orderBy("o")
    ranked = df.withColumn("g", F.dense_rank().over(w))
    for a, b, f, by in ((-1, 0, F.sum, ["p"]), (-2, 2, F.count, ["p"]), (0, 1, F.avg, ["p"]), (1, 2, F.count, ["p"]), (-30, 0, F.max, ["p"]), (-1, 1, F.first, ["p"]), (0, 0, F.min, [])):
        got = windows.groups_frame(df, f("v"), "s", by, ["o"], a, b)
        if f is F.first:
            assert "Window" in plan(got) and got.count() == 60
            continue
        r = ranked if by else df.withColumn("g", F.dense_rank().over(Window.orderBy("o")))
        want = r.withColumn("s", f("v").over(Window.partitionBy(*by).orderBy("g").rangeBetween(a, b))).drop("g")
        assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # The only window is over the distinct groups.
    got = plan(windows.groups_frame(df, F.sum("v"), "s", ["p"], ["o"], -1, 0))
    assert "specifiedwindowframe(RangeFrame" not in got and "windowspecdefinition(p#" not in got


def test_groups_and_sessions_in_sql_take_partitions_apart(spark):
    from sparkforge.session import Engine

    e = Engine(spark)
    rows = [(i, None if i % 11 == 0 else i % 2, None if i % 13 == 0 else i // 5, None if i % 4 == 0 else i * i % 97, i * 7919 % 1009) for i in range(600)]
    e.view("t", e.spark.createDataFrame(rows, "i int, p int, o int, v int, s int").repartition(5))
    for by in ("PARTITION BY p ", ""):
        for order in ("o, s, i", "s DESC, i DESC", "o, i DESC") if by else ("s, i", "o DESC NULLS FIRST, i"):
            over = f"{by}ORDER BY {order}"
            got = e.sql(f"SELECT i, session_number(v, 20) OVER ({over}) AS a, session_number(s, 1) OVER ({over}) AS b, count(*) OVER ({by}ORDER BY o GROUPS 1 PRECEDING) AS c, sum(v) OVER ({by}ORDER BY o DESC GROUPS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS d FROM t")
            e.view("n", e.spark.sql(f"SELECT *, CASE WHEN v - last_value(v) IGNORE NULLS OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 20 THEN 1 ELSE 0 END AS x, CASE WHEN s - lag(s) OVER ({over}) > 1 THEN 1 ELSE 0 END AS y, dense_rank() OVER ({by}ORDER BY o) AS g, dense_rank() OVER ({by}ORDER BY o DESC) AS h FROM t"))
            want = e.spark.sql(f"SELECT i, 1 + sum(x) OVER ({over}) AS a, 1 + sum(y) OVER ({over}) AS b, count(*) OVER ({by}ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS c, sum(v) OVER ({by}ORDER BY h RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS d FROM n")
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # No window is over a partition's rows in one piece.
    text = plan(e.sql("SELECT *, session_number(v, 20) OVER (PARTITION BY p ORDER BY s, i) AS a, sum(v) OVER (PARTITION BY p ORDER BY o GROUPS 1 PRECEDING) AS b FROM t"))
    assert "__chunk" in text and "RangeFrame, -1" not in text
    assert e.sql("SELECT session_number(v, 20) OVER (ORDER BY s) AS a, sum(v) OVER (ORDER BY s GROUPS 1 PRECEDING) AS b FROM t WHERE i < 0").collect() == []
    assert e.sql("SELECT *, session_number(v, 20) OVER (ORDER BY s) AS a FROM t").columns == ["i", "p", "o", "v", "s", "__session0", "a"]
