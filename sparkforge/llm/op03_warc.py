"""WARC archives and a globally ordered index of their captures.

Writing: of the pages with equal payloads the one with the largest page_id is the response, the others are revisits that
refer to it. Each task sorts its own records by (URL key, time, page) and writes archives of bounded size with Spark's
committer, so an archive is a locally sorted run of captures.

Index: the archives are read back. A shuffle by ranges of keys cuts every run into slices; the slices of one range meet in
one task, where a loser tree merges them. Ranges follow one another, so their captures are the global order by URL key and
time. Keys end in the page and the record's place, so even a URL with very many captures spreads over ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, new_path

EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
FILE_BYTES = 64 << 20
#: Captures for each range of the merge.
RANGE_ROWS = 100_000
RECORD_URN = "urn:sparkforge:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels from the right, then path and query, lower case; no scheme, port, www or fragment."""
    if not url:
        return ""
    try:
        s = urlsplit(url.strip())
        host = (s.hostname or "").lower()
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if labels and re.fullmatch(r"www\d*", labels[0]) and len(labels) > 1:
        labels = labels[1:]
    path = (s.path.rstrip("/") or "/").lower()
    return ",".join(reversed(labels)) + ")" + path + ("?" + "&".join(sorted(s.query.lower().split("&"))) if s.query else "")


def captured(page_id: int | None) -> str:
    """The table has no capture time; page_id counts seconds."""
    seconds = max(-60_000_000_000, min(250_000_000_000, page_id or 0))
    return (EPOCH + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(s: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record without its last byte, a newline."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URN}{'none' if page_id is None else page_id}>", f"WARC-Date: {captured(page_id)}"]
    head += [f"WARC-Target-URI: {one_line(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    head += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r"


def records(data: memoryview):
    """(offset, length, headers, block) of every record of an archive."""
    at = 0
    whole = bytes(data)
    while at < len(whole):
        end = whole.index(b"\r\n\r\n", at) + 4
        lines = whole[at : end - 4].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + int(headers["Content-Length"])
        yield at, stop + 4 - at, headers, whole[end:stop]
        at = stop + 4


def duplicates(pages: DataFrame, least: int, tables: Tables) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    same = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1")
    same = tables.write(same.select(F.col("sha").alias("same"), "winner"), "equal")
    out = rows.join(same, F.col("sha") == F.col("same"), "left")
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """One record for each row. Equal payloads of at least `least` bytes have one response, the largest page_id.

    Rows that repeat a page_id and its payload are responses each if theirs is the largest id. A row without page_id is a
    revisit if another has the same payload and an id. A null html is an empty payload, a null url has no target line.
    """
    rows = duplicates(pages, least, Tables(pages.sparkSession, "warc"))
    total, n = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 600), F.count("*")).first()
    most = max(1, file_bytes * n // total) if n else 1

    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda u: url_key(one_line(u if isinstance(u, str) else None)))

    def run(batches):
        for b in batches:
            got = [record(*x) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["record"])

    key = F.pandas_udf(keys, "string")
    # In the order of capture times: a row without an id has that of id 0.
    rows = rows.withColumn("key", key("url")).sortWithinPartitions("key", F.coalesce("page_id", F.lit(0)), "page_id").drop("key")
    out = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\n").option("maxRecordsPerFile", most).text(path)


CAPTURE = "url_key string, timestamp string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record; a response's digest and length are those of its stored payload, checked against its headers."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def page(s: str | None):
        return None if s is None or s.endswith("none>") else int(s[len(RECORD_URN) + 1 : -1])

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = []
                for at, length, h, block in records(memoryview(content.as_py())):
                    head, payload = block.split(b"\r\n\r\n", 1)
                    n, digest = int(re.search(rb"Content-Length: (\d+)", head)[1]), h["WARC-Payload-Digest"][5:]
                    if h["WARC-Type"] == "response":
                        if len(payload) != n or sha1_base32(payload) != digest:
                            raise ValueError(f"{name}: the payload at {at} differs from its header")
                    url = h.get("WARC-Target-URI")
                    rows.append((url_key(url), re.sub(r"\D", "", h["WARC-Date"]), page(h["WARC-Record-ID"]), url, h["WARC-Type"], n, digest, page(h.get("WARC-Refers-To")), name.as_py().rsplit("/", 1)[1], at, length))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CAPTURE.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURE)


def merge_runs(runs: list) -> list:
    """K-way merge of sorted lists by a loser tree: each inner node keeps the loser of its match, the winner moves up."""
    k = len(runs)
    if k < 2:
        return list(runs[0]) if runs else []
    iters = [iter(r) for r in runs]
    heads = [next(i, None) for i in iters]

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return heads[a] < heads[b] or heads[a] == heads[b] and a < b

    # Leaves are the nodes from k on; matches are played from the last inner node up.
    tree, won = [0] * k, [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    winner, out = won[1], []
    while heads[winner] is not None:
        out.append(heads[winner])
        heads[winner] = next(iters[winner], None)
        node = (winner + k) // 2
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
    return out


def merged_index(captures: DataFrame, tables: Tables, range_rows: int = RANGE_ROWS) -> DataFrame:
    """captures in global order: their columns and capture_seq, the place in that order (from 0)."""
    least = -(1 << 63)
    names = captures.columns
    order = [F.coalesce("url_key", F.lit("")), F.coalesce("timestamp", F.lit("")), F.coalesce("page_id", F.lit(least)), F.col("archive"), F.col("offset")]

    def merge(batches):
        """Merges the slices of one range; a slice is what it holds of an archive, in the order of the archive."""
        table = pa.Table.from_batches(batches, schema=arrow).sort_by([("archive", "ascending"), ("offset", "ascending")])
        if not len(table):
            return
        columns = [table.column(c).to_pylist() for c in ("url_key", "timestamp", "page_id", "archive", "offset")]
        keys = [(u or "", t or "", least if p is None else p, a, o, i) for i, (u, t, p, a, o) in enumerate(zip(*columns))]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i][3] != keys[i - 1][3]), len(keys)]
        runs = [keys[a:b] for a, b in zip(cuts, cuts[1:])]
        if any(x > y for run in runs for x, y in zip(run, run[1:])):
            raise ValueError("a run is not in order")
        out = table.take(pa.array([x[5] for x in merge_runs(runs)], pa.int64()))
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(out), pa.int32()))
        yield from out.append_column("rank", pa.array(range(len(out)), pa.int64())).combine_chunks().to_batches(10_000)

    kinds = {"string": pa.string(), "bigint": pa.int64()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in captures.schema])
    parts = max(1, -(-captures.count() // range_rows))
    whole = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in captures.schema) + ", part int, rank long"
    out = tables.write(captures.select(*names).repartitionByRange(parts, *order).mapInArrow(merge, whole), "merged")
    tables.only(out)
    # One row for each range.
    ends = out.groupBy("part").agg(F.count("*").alias("n"))
    ends = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return out.join(ends, "part").withColumn("capture_seq", F.col("before") + F.col("rank")).drop("part", "rank", "before")


def warc(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives of pages, read back and indexed: one row per page in CAPTURE's columns, plus capture_seq."""
    spark = pages.sparkSession
    path, tables = new_path(spark, "archives"), Tables(spark, "warc")
    write_archives(pages, path, least)
    return merged_index(tables.write(read_archives(spark, path), "captures"), tables)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
