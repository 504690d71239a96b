import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkforge.llm.op07_token_planes import END_ID, Encoder, chunk, file_records, from_planes, read_chunk, read_documents, read_index, to_planes, token_planes, tokenizer_file
from sparkforge.llm.op09_token_counts import MARK, UNKNOWN, Trie, pieces_file, token_counts, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, file int, start string, record string, n_tokens string, value int"
ODD = ["", "a", "  a  b", "x \n y\n\n z ", "tab\t t", " a b　c", "<|endoftext|> hi", "don't we'll 12 3.5 ½ x²", "a\x00b c", " lead", "trail ", "\n", "日本 語", "é é", "a   b    c", "word " * 400, "\r\n \r\n"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "st", "r", "n", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file()[0])


def test_encoder_is_the_library(library):
    file, pattern = tokenizer_file()
    e = Encoder(open(file, encoding="utf-8").read(), pattern)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab c\n.'s1 é\t ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for got, t in zip(e.encode(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_remembers_no_more_than_its_limit(library):
    """Words that come again stay, others go after two turns, and the ids are those of the library."""
    file, pattern = tokenizer_file()
    e = Encoder(open(file, encoding="utf-8").read(), pattern, limit=200)
    rng, learnt = random.Random(2), []
    learn = e.learn
    e.learn = lambda new: (learnt.extend(new), learn(new))
    for _ in range(60):
        texts = ["the same words, always " + " ".join("".join(rng.choice("abcdeé.\n") for _ in range(9)) for _ in range(20)) for _ in range(3)]
        for got, t in zip(e.encode(texts), texts):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert len(e.known) + len(e.old) < 200 + 2 * 400
    assert learnt.count(" same") == learnt.count(" words,") == 1 and len(learnt) > 2000


def test_encoder_looks_up_old_words(library):
    """The words that were known before are not gone through for each batch."""

    class Old(dict):
        def __iter__(self):
            raise AssertionError("all old words were read")

        keys = values = items = __iter__

    file, pattern = tokenizer_file()
    e = Encoder(open(file, encoding="utf-8").read(), pattern)
    e.encode(["some words that are old now, and come again"])
    e.known, e.old = {}, Old(e.known)
    for t in ("some words that are new", "a  pair of spaces\n and a line", "<|endoftext|> words"):
        assert np.frombuffer(e.encode([t, "words"])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert " that" in e.known and e.known[" words"] is e.old[" words"]


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_and_files(unit):
    rng = np.random.default_rng(0)
    for top in (0, 1, 255, 256, 50_257, 2**32 - 1):
        ids = rng.integers(0, top, 1001, dtype=np.uint32, endpoint=True)
        assert (from_planes(to_planes(ids, unit), len(ids), unit) == ids).all()
    got, docs, _ = read_chunk(memoryview(chunk(np.arange(70, dtype=np.uint32), 5, [(9, 30), (-2, 40)], unit)), 0)
    assert got.tolist() == list(range(70)) and docs == [(9, 30), (-2, 40)]
    want = [(i, rng.integers(0, 60_000, n, dtype=np.uint32).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 63, 64, 65, 500, 0, 3])]
    data = b"".join(r + b"\n" for r in file_records(want, unit, block=64))
    assert list(read_documents(memoryview(data))) == want
    index = read_index(memoryview(data))
    assert sum(n for *_, n in index) == sum(len(r) // 4 for _, r in want) and all(n == 64 for *_, n in index[:-1])


def test_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD * 5)] + [(-7, "x y"), (10**12, None)]
    random.Random(2).shuffle(rows)
    out = token_planes(frame(spark, rows).repartition(3), file_bytes=2000).collect()
    start, want = 0, []
    for i, t in sorted(rows):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out)) == sorted(want)


def test_token_files_edges(spark):
    assert token_planes(frame(spark, [])).collect() == []
    out = token_planes(frame(spark, [(None, "a"), (3, None), (3, None), (3, "b c")])).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in out) == [(-1, 2), (3, 1), (3, 1), (3, 3)]
    assert [r.start for r in out if r.doc_id is None] == [0]


def best(word, pieces):
    """(score, -count) of the best segmentation, without sharing anything."""
    at = [(0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        found = [(at[end - 1][0] + UNKNOWN, at[end - 1][1] - 1)]
        for start in range(end):
            if word[start:end] in pieces:
                found.append((at[start][0] + pieces[word[start:end]], at[start][1] - 1))
        at[end] = max(found)
    return -at[-1][1]


def test_trie_is_brute_force():
    pieces = vocabulary(pieces_file())
    rng = random.Random(3)
    words = {MARK + "".join(rng.choice("abcdehinorstué日") for _ in range(rng.randint(1, 12))) for _ in range(600)}
    trie = Trie(pieces)
    trie.insert(list(words))
    assert all(trie.known[w] == best(w, pieces) for w in words)
    prefixes = {w[:i] for w in words for i in range(1, len(w) + 1)}
    assert trie.nodes == len(prefixes) < sum(map(len, words))


def test_counts_of_documents(spark):
    pieces = vocabulary(pieces_file())
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (1, "a"), (1, "a")]
    out = token_counts(frame(spark, rows)).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode().split()), sum(best(MARK + w.decode("utf-8", "replace"), pieces) for w in (t or "").encode().split())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_tokens) for r in out) == want
    assert token_counts(frame(spark, [])).collect() == []
