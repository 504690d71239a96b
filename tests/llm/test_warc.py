import base64
import hashlib
import random

from sparkforge.llm.common import Tables, new_path
from sparkforge.llm.op03_warc import merge_runs, merged_index, read_archives, record, records, url_key, warc, write_archives

SCHEMA = "page_id long, url string, html string, payload string, sha int, winner string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1, "w", 2) for i, u, h in rows], SCHEMA)


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert merge_runs(runs) == sorted(x for r in runs for x in r)


def test_records_are_read_as_written():
    parts = [record(1, "http://a/ b", b"x\r\n\r\nWARC/1.1\r\n", None), record(None, None, b"", None), record(3, "", "é".encode(), 1)]
    data = b"".join(p + b"\n" for p in parts)
    got = list(records(memoryview(data)))
    assert [h["WARC-Type"] for _, _, h, _ in got] == ["response", "response", "revisit"] and got[0][3].endswith(b"x\r\n\r\nWARC/1.1\r\n")
    assert sum(n for _, n, _, _ in got) == len(data)


def test_keys():
    assert url_key("https://WWW.Example.com:80/A/b/?z=1&a=2#f") == "com,example)/a/b?a=2&z=1" and url_key(None) == "" and url_key("http://[bad") == "http://[bad"


def test_round_trip_and_order(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(4)}.example/{rng.randrange(9)}", rng.choice([None, "", "same", f"<p>{i}\r\n\r\né</p>", "x" * 3000])) for i in range(300)]
    out = warc(frame(spark, rows).repartition(5)).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), i)
    want = set()
    for i, _, h in rows:
        b = (h or "").encode()
        want.add((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]))
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out} == want and len(out) == 300
    ordered = sorted(out, key=lambda r: r.capture_seq)
    assert [r.capture_seq for r in ordered] == list(range(300))
    assert [(r.url_key, r.timestamp) for r in ordered] == sorted((r.url_key, r.timestamp) for r in out)


def test_least_size(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "longer text"), (4, "u", "longer text")]
    assert sorted((r.page_id, r.record_type) for r in warc(frame(spark, rows), least=5).collect()) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


def test_merge_over_many_ranges(spark):
    rows = [(i, "http://hot.example/" if i % 3 else f"http://c.example/{i}", f"<p>{i}</p>") for i in range(400)]
    path = new_path(spark, "test")
    write_archives(frame(spark, rows).repartition(4), path, file_bytes=20_000)
    out = merged_index(read_archives(spark, path), Tables(spark, "test"), range_rows=20).collect()
    ordered = [(r.url_key, r.timestamp) for r in sorted(out, key=lambda r: r.capture_seq)]
    assert len(out) == 400 and ordered == sorted(ordered) and sorted(r.capture_seq for r in out) == list(range(400))


def test_any_ids_stay_as_they_are(spark):
    """Ids beyond the whole numbers of a double, negative ones and nulls, all in one task."""
    ids = [9007199254740993, 9007199254740983, None, -5, 0, -1, -70_000_000_000, -(1 << 63), (1 << 63) - 1, -62_000_000_000, 3]
    rows = [(i, "http://h.example/", h) for i in ids for h in ("same", f"own {i}")]
    out = warc(frame(spark, rows).coalesce(1)).collect()
    want = {(i, "response" if h != "same" or i == (1 << 63) - 1 else "revisit", (1 << 63) - 1 if h == "same" and i != (1 << 63) - 1 else None) for i, _, h in rows}
    assert len(out) == len(rows) and {(r.page_id, r.record_type, r.refers_to) for r in out} == want
    ordered = sorted(out, key=lambda r: r.capture_seq)
    assert [r.timestamp for r in ordered] == sorted(r.timestamp for r in out) and all(len(r.timestamp) == 14 for r in out)


def test_one_page_longer_than_an_archive(spark):
    rows = [(i, f"http://h.example/{i}", "x" * 3_000_000 if i == 7 else f"<p>{i}</p>") for i in range(40)]
    path = new_path(spark, "test")
    write_archives(frame(spark, rows).repartition(2), path, file_bytes=50_000)
    out = {r.page_id: r.payload_bytes for r in read_archives(spark, path).collect()}
    assert len(out) == 40 and out[7] == 3_000_000


def test_edges(spark):
    rows = [(None, None, None), (None, "u", "x"), (5, "u", "x"), (5, "u", "x"), (7, "a b\nc", "y")]
    out = warc(frame(spark, rows)).collect()
    assert len(out) == 5 and sorted(r.record_type for r in out if r.page_id == 5) == ["response", "response"]
    assert [(r.record_type, r.refers_to) for r in out if r.page_id is None and r.payload_bytes == 1] == [("revisit", 5)]
    assert warc(frame(spark, [])).collect() == []
