"""Token counts under a unigram model, from a trie of distinct pre-tokens.

A pre-token is a word with the word mark before it. Its best segmentation has the highest sum of piece scores; the
forward recursion over its prefixes needs, at each prefix, only the scores of shorter prefixes. Pre-tokens that share a
prefix share them: the distinct pre-tokens of a batch are sorted, which visits their trie depth first, and each node is
scored once. The counts at the ends of pre-tokens are stored, and a text's count is the sum over its words.

Nothing is shuffled: each task has a trie of its own words, and remembers counts up to a bound on entries.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes

MARK = "▁"
#: Scores are whole millionths, so that sums don't depend on order. A character without a piece costs this much.
SCALE, UNKNOWN = 1_000_000, -20_000_000


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece file with scores: the log of Zipf's law for their rank. Control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    total = sum(1 / (i + 1) for i in range(n))
    return {sp.id_to_piece(i): round(SCALE * -math.log((i + 1) * total)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


def pieces_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Trie:
    """Counts of pre-tokens. `nodes` is the number of prefixes that were scored."""

    LIMIT = 300_000

    def __init__(self, pieces: dict[str, int]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.known: dict[str, int] = {}
        self.nodes = 0

    def insert(self, words: list[str]) -> None:
        """Scores the trie of the words depth first; best[i] and count[i] belong to the prefix of i characters of the path."""
        best, count, path, get, longest = [0], [0], "", self.pieces.get, self.longest
        for word in sorted(words):
            same = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                # The smallest count among segmentations of the best score.
                top, few = best[end - 1] + UNKNOWN, count[end - 1] + 1
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and count[start] < few:
                            top, few = s, count[start] + 1
                best.append(top)
                count.append(few)
                self.nodes += 1
            self.known[word] = count[len(word)]
            path = word

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text. Words are cut at the six white-space characters and start with the word mark."""
        split = [t.split() for t in texts]
        every = Counter()
        for words in split:
            every.update(words)
        known = self.known
        if len(known) + len(every) > self.LIMIT:
            known.clear()
        name = {w: MARK + w.decode("utf-8", "replace") for w in every}
        if new := {x for x in name.values() if x not in known}:
            self.insert(list(new))
        size = {w: known[x] for w, x in name.items()}
        return [(len(words), sum(map(size.__getitem__, words))) for words in split]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens.

    A null, empty or blank text has none of either. Text of any length is cut into words first, so only a word without
    any white space makes one long path. Repeated rows give equal rows, an empty table none; other columns are not read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path or pieces_file()))

    def run(batches):
        trie = None
        for b in batches:
            trie = trie or Trie(pieces.value)
            rows, at, texts = [], 0, b.column(1)
            while at < len(b):  # some documents at a time: words of one batch are held together
                part, size = [], 0
                while at < len(b) and size < 1 << 22:
                    part.append(texts[at].as_py())
                    size += len(part[-1])
                    at += 1
                rows += trie.counts(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes()).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
