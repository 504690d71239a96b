"""Token ids in files of shuffled planes.

A file is a sequence of records and a newline after each, written by Spark's committer to any store it can write:

    chunk   "BPC1", header, lengths of its planes, document index, planes
    index   "BPX1", one entry per chunk (offset, first id, number of ids), last "BPX1" and the offset of this record

A chunk holds BLOCK ids (the last one fewer). Its ids are transposed into planes, of bytes or of bits: plane k has byte
(bit) k of every id. Each plane is compressed with zstandard by itself; high planes of small ids almost vanish. The
document index has doc_id and number of ids of the documents that end in the chunk. Documents may span chunks.

Documents are dealt out by ranges of doc_id and sorted inside, one file for each range, so file order is id order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, new_path, trim

BLOCK = 1 << 16
#: Bytes of text for each file.
FILE_BYTES = 16 << 20
#: Files that an estimate may lead to without a look at the texts.
MANY_FILES = 4096
HEAD, ENTRY = "<4sQIBBI", "<QQI"
END_ID = 2
#: In place of a null doc_id.
NO_ID = -(1 << 63)


#: White space next to a space: there a cut before the space could split one pre-token. And white space beyond ASCII.
PAIRS = [" " + c for c in " \t\n\x0b\x0c\r"] + [c + " " for c in "\t\n\x0b\x0c\r"]
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Encoder:
    """Ids of texts as little-endian 32-bit integers. Each different word is encoded by the library once and remembered.

    Byte-level BPE never merges across pre-tokens, and a pre-token has a space at its start only, so a text may be cut
    before its single spaces and the ids of the cuts joined. A text with other white space beside a space is cut into
    pre-tokens, and one with the string of an added token goes to the library whole.

    Half of `limit` new words make those before the old ones, of which only those that come again are kept further.
    """

    LIMIT = 1_000_000

    def __init__(self, spec: str, pattern: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.find = regex.compile(pattern).findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.space[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True

    @classmethod
    def shared(cls, spec: str, pattern: str, limit: int = LIMIT) -> Encoder:
        """One for all tasks of a worker process: kept at the library, which is a module of the process."""
        import tokenizers

        kept = vars(tokenizers).setdefault("_sparkforge", {})
        name = (hash(spec), pattern, limit)
        if name not in kept:
            kept.clear()
            trim()
            kept[name] = cls(spec, pattern, limit)
        return kept[name]

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cuts(self, text: str, pairs: list[str]) -> list[str]:
        """pairs: those of PAIRS that the text may have."""
        if "\0" in text or any(p in text for p in pairs) or not text.isascii() and ODD.search(text):
            return self.find(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, new: set[str]) -> None:
        """Stores the ids of new cuts. Most are a word, or a word with one mark after it; others are cut into pre-tokens."""
        known, words, alone, rest, marked = self.known, set(), [], {}, []
        for c in new:
            if c[1:].isalpha() and c[0] == " ":
                words.add(c)
            elif c[1:-1].isalpha() and c[0] == " " and c[-1] in ",.;:?":
                marked.append(c)
            elif c.isalpha():
                alone.append(c)
            else:
                rest[c] = self.find(c)
        words.update(w for c in marked if (w := c[:-1]) not in known)
        more = {p for ps in rest.values() for p in ps if p not in known}
        words.update(p for p in more if p[0] == " " and p[1:].isalpha())
        pieces = list(words)
        # Words that start with their only space can be told apart in the ids of a text of many.
        groups = [pieces[i : i + 100] for i in range(0, len(pieces), 100)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, at = ids.tobytes(), [*(4 * np.flatnonzero(self.space[ids])).tolist(), 4 * len(ids)]
            if len(at) == len(some) + 1:
                known.update(zip(some, [raw[x:y] for x, y in zip(at, at[1:])]))
            else:
                known.update((p, self.library(p)) for p in some)
        others = list(more.union(alone, (c[-1] for c in marked)).difference(known))
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            known[p] = np.array(e.ids, "<u4").tobytes()
        for c in marked:
            known[c] = known[c[:-1]] + known[c[-1]]
        for c, ps in rest.items():
            known[c] = b"".join(map(known.__getitem__, ps))

    def encode(self, texts: list[str]) -> list[bytes]:
        # What no text has is looked for once.
        every = "\0".join(texts)
        added, pairs = [t for t in self.added if t in every], [p for p in PAIRS if p.strip(" ") in every and p in every]
        whole = [any(t in text for t in added) for text in texts]
        cut = [[] if w else self.cuts(t, pairs) for t, w in zip(texts, whole)]
        if 2 * len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        if new := set().union(*cut).difference(self.known):
            # By the new words: an intersection of the set with the old ones would go through all of those.
            again = {c: self.old[c] for c in new if c in self.old}
            self.known.update(again)
            self.learn(new.difference(again) if again else new)
        get = self.known.__getitem__
        return [self.library(t) if w else b"".join(map(get, c)) for t, w, c in zip(texts, whole, cut)]


def to_planes(ids: np.ndarray, unit: str = "byte") -> list[bytes]:
    """Planes of an array of uint32, low one first, as many as the largest id has bytes (bits)."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if unit == "byte":
        return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range((top + 7) // 8)]
    return [np.packbits(((ids >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, unit: str = "byte") -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        if unit == "byte":
            out |= np.frombuffer(p, np.uint8).astype(np.uint32) << np.uint32(8 * k)
        else:
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return out


def chunk(ids: np.ndarray, start: int, docs: list[tuple[int, int]], unit: str = "byte", level: int = 3) -> bytes:
    z = zstandard.ZstdCompressor(level=level)
    planes = [z.compress(p) for p in to_planes(ids, unit)]
    index = z.compress(np.array(docs, "<i8").tobytes())
    lengths = struct.pack(f"<{len(planes) + 1}I", len(index), *map(len, planes))
    return b"".join([struct.pack(HEAD, b"BPC1", start, len(ids), len(planes), unit == "bit", len(docs)), lengths, index, *planes])


def read_chunk(data: memoryview, at: int) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """Ids, documents that end in it, and the place after it."""
    magic, _, n, planes, bit, docs = struct.unpack_from(HEAD, data, at)
    if magic != b"BPC1":
        raise ValueError(f"no chunk at {at}")
    at += struct.calcsize(HEAD)
    lengths = struct.unpack_from(f"<{planes + 1}I", data, at)
    at += 4 * (planes + 1)
    z, parts = zstandard.ZstdDecompressor(), []
    for k in lengths:
        parts.append(z.decompress(data[at : at + k]))
        at += k
    ids = from_planes(parts[1:], n, "bit" if bit else "byte")
    return ids, [tuple(x) for x in np.frombuffer(parts[0], "<i8").reshape(docs, 2).tolist()], at


def file_records(documents, unit: str = "byte", block: int = BLOCK):
    """Records of one file from (doc_id, ids as bytes)."""
    waiting, size, start, offset, docs, entries = [], 0, 0, 0, [], []

    def out(raw: bytes, ended: list):
        nonlocal start, offset
        record = chunk(np.frombuffer(raw, "<u4"), start, ended, unit)
        entries.append((offset, start, len(raw) // 4))
        start += len(raw) // 4
        offset += len(record) + 1
        return record

    for doc_id, raw in documents:
        count, at = len(raw) // 4, 0
        while size + (len(raw) - at) // 4 >= block:
            cut = at + 4 * (block - size)
            waiting.append(raw[at:cut])
            at = cut
            if at == len(raw):
                docs.append((doc_id, count))
            yield out(b"".join(waiting), docs)
            waiting, size, docs = [], 0, []
        if at < len(raw) or not count:
            waiting.append(raw[at:])
            size += (len(raw) - at) // 4
            docs.append((doc_id, count))
    if docs:
        yield out(b"".join(waiting), docs)
    yield b"".join([b"BPX1", struct.pack("<I", len(entries)), *(struct.pack(ENTRY, *e) for e in entries), struct.pack("<Q4s", offset, b"BPX1")])


def read_index(data: memoryview) -> list[tuple[int, int, int]]:
    """(offset, first id, number of ids) of every chunk of a file; the newline after the last record is there."""
    at, magic = struct.unpack_from("<Q4s", data, len(data) - 13)
    if magic != b"BPX1" or bytes(data[at : at + 4]) != magic:
        raise ValueError("no index at the end")
    (n,) = struct.unpack_from("<I", data, at + 4)
    return [struct.unpack_from(ENTRY, data, at + 8 + i * struct.calcsize(ENTRY)) for i in range(n)]


def read_documents(data: memoryview):
    """(doc_id, ids as bytes) of every document of a file, through its index."""
    parts, size = [], 0
    for at, _, _ in read_index(data):
        ids, docs, _ = read_chunk(data, at)
        raw, p = ids.astype("<u4").tobytes(), 0
        for doc_id, n in docs:
            take = 4 * n - size
            yield doc_id, b"".join([*parts, raw[p : p + take]])
            p += take
            parts, size = [], 0
        if p < len(raw):
            parts.append(raw[p:])
            size += len(raw) - p


def tokenizer_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def write_tokens(docs: DataFrame, path: str, tokenizer: tuple[str, str] | None = None, end_id: int = END_ID, unit: str = "byte", file_bytes: int = FILE_BYTES, words: int = Encoder.LIMIT) -> None:
    """Encodes every text (null: empty), appends end_id, and writes the files in ascending order of doc_id, null first.

    words: how many words a worker process remembers, about 200 bytes each; with fewer, more are encoded again.
    Rows with equal ids follow each other in the order of a hash of their texts. No rows make one file without chunks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The number of files follows Catalyst's estimate of the input, in which text is compressed; where that says there
    # are many, as it does for joins whatever their size, the texts are measured.
    total = 2 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if total > MANY_FILES * file_bytes:
        total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    file, pattern = tokenizer or tokenizer_file()
    with open(file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = struct.pack("<I", end_id)

    def run(batches):
        encoder = Encoder.shared(spec.value, pattern, words)

        def documents():
            for b in batches:
                ids, texts, at = b.column(0).to_pylist(), b.column(1), 0
                while at < len(ids):
                    some, size = [], 0
                    while at + len(some) < len(ids) and size < 1 << 19:
                        some.append(texts[at + len(some)].as_py())
                        size += len(some[-1])
                    for doc_id, raw in zip(ids[at:], encoder.encode(some)):
                        yield NO_ID if doc_id is None else doc_id, raw + end
                    at += len(some)

        for record in file_records(documents(), unit):
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

    order = ["doc_id", F.xxhash64("text")]
    parts = max(1, -(-total // file_bytes))
    ranges = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    out = ranges.sortWithinPartitions(*order).mapInArrow(run, "record binary")
    out.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: file (its number), at (ids before the document in its file), doc_id, n_tokens, ids_crc32."""
    schema = "file long, at long, doc_id long, n_tokens long, ids_crc32 long"

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                number, at, rows = int(re.search(r"part-(\d+)", name.as_py())[1]), 0, []
                for doc_id, raw in read_documents(memoryview(content.as_py())):
                    rows.append((number, at, None if doc_id == NO_ID else doc_id, len(raw) // 4, zlib.crc32(raw)))
                    at += len(raw) // 4
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["file", "at", "doc_id", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def token_planes(docs: DataFrame, **options) -> DataFrame:
    """Writes docs and reads the files back: doc_id, start, n_tokens (with the end id), ids_crc32 of every document."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, **options)
    rows = Tables(spark, "planes").write(read_tokens(spark, path), "documents")
    # One row for each file.
    ends = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    ends = ends.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(ends, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
