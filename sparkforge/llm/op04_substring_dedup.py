"""Passages of 50 words or more that repeat across documents.

A paragraph here is a window of words at any place of a text, so a passage is found wherever it was put in. Two stretches
of `least` words or more whose shingles have a Jaccard similarity of `percent` differ in so few words that some run of G
words, 25 for 50 words and 80 %, is the same in both: the bands are tuned to that run, which makes their recall certain.

1. Band keys. The hash minimum over the shingles of every window of G words, with as many words before it, or after it, as
   still lie in the window whatever its place. A text has about one minimum for every 11 words, with two keys each.
2. Places that collide are held against the first place with their key. Both texts are aligned at the collisions: exact
   runs are extended as far as they go and chained over short edits, and a chain counts if it has `least` words and the
   exact Jaccard similarity of its two sides is `percent` or more.
3. What lies in no stretch that this removes goes on: the windows of G words at such places, and at the places they collide
   with, are joined by the hash of all their words, so lines that are shared but shorter make no more candidates. A window
   is held against the first places of its hash, more of them each turn, until it lies in a stretch that is removed or
   has met every place of a document with a smaller doc_id. Windows that always follow each other are one place, and only
   the parts of chains with such a place in them are matches.

Overlapping stretches of a document are one node, matches are edges, and connected components are the clusters. A stretch
is removed only where a document with a smaller doc_id has it too, so one copy of everything stays. Clusters hang together
by the matches that were needed: of stretches that are removed already not all pairs are held against each other.

One word many times in a row is settled without texts: two such stretches of `least` words have the same only shingle, so
each goes where a document with a smaller doc_id has one of the word. Windows of one word have no keys, for any other chain
they are part of needs its shingles from elsewhere, from a run with keys of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX1, Tables, WordHashes, as_bytes, components, mix, shingles
from .op10_minhash_dedup import bloom, needed

SHINGLE, LEAST, PERCENT = 5, 50, 80
#: Words on either side that a chain may step over.
STEP = 6


def certain_run(least: int, percent: int) -> int:
    """Words of the longest equal run that any two stretches of `least` words or more have if their similarity is `percent`.

    A changed word costs SHINGLE shingles on each side; e changes cut the equal words in e + 1 runs.
    """
    best = least
    for n in range(least, 40 * least):
        e = int((100 - percent) * (n - SHINGLE + 1) // ((100 + percent) * SHINGLE))
        best = min(best, -(-(n - e) // (e + 1)))
    return max(best, 2 * SHINGLE)


def alike(w: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each place on are the same word."""
    changes = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])])[: len(w)]
    return changes[n - 1 :] == changes[: max(0, len(w) - n + 1)]


def stretches_of_one_word(w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all longest stretches of one word that have `least` words."""
    ends = np.flatnonzero(np.append(w[1:] != w[:-1], True)[: len(w)]) + 1
    starts = np.concatenate([[0], ends])[: len(ends)]
    long = ends - starts >= least
    return starts[long], ends[long]


def beyond(w: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before, and after, each window of `run` words that is one word and a last (first) other one must be removed with it.

    Those are of the windows of one word next to it, which have no keys, as far as `least` words around the window go.
    """
    n = max(0, len(w) - run + 1)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change, at = np.append(w[1:] != w[:-1], True), np.arange(len(w))
    ends = np.minimum.accumulate(np.where(change, at, len(w))[::-1])[::-1] + 1
    starts = np.maximum.accumulate(np.where(np.append(True, change[:-1]), at, 0))
    same, at = alike(w, run - 1), at[:n]
    left = np.where(same[:n], np.minimum(at - starts[:n], least - run), 0)
    right = np.where(same[1 : n + 1], np.minimum(ends[run - 1 :] - run - at, least - run), 0)
    return left, right


def minima_of_windows(h: np.ndarray, width: int, last: np.ndarray | None = None) -> np.ndarray:
    """The place of the minimum of every window of `width` shingles, the first if equal ones are in it.

    last: shingles that are the minimum only where a window has no others.
    """
    if len(h) < width:
        return np.zeros(0, np.int64)
    low20 = np.uint64((1 << 20) - 1)
    at = np.arange(len(h), dtype=np.uint64)
    v = mix(h + MIX1)
    if last is not None:
        v[last] = ~np.uint64(0)
    v = (v & ~low20) | (at & low20)
    # Minimum of every window from minima of blocks from the left and from the right.
    pad = -len(v) % width
    full = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(full, 1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(right[: len(v) - width + 1], left[width - 1 : len(v)]) & low20
    start = at[: len(low)]
    place = (start & ~low20) | low
    return np.where(place < start, place + low20 + np.uint64(1), place).astype(np.int64)


class Bands:
    """Places and keys of the band minima of a text for runs of `run` words."""

    def __init__(self, run: int):
        self.run, self.width = run, run - SHINGLE + 1
        #: Words of a key: with the minimum in either half of a window, as many lie in it on that side.
        self.context = SHINGLE + (self.width - 1) // 2

    def windows(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window: the place of its minimum, and whether its key is that of the words up to the minimum.

        Shingles of one word come last: they would be the keys of all windows that reach into a stretch of it.
        """
        place = minima_of_windows(shingles(w, SHINGLE), self.width, alike(w, SHINGLE) if len(w) >= self.run else None)
        return place, place - np.arange(len(place)) >= self.context - SHINGLE

    def keys(self, w: np.ndarray, inside: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, whether before, keys) of a text's word hashes, each once; windows of one word, or not inside, have none."""
        place, before = self.windows(w)
        mixed = ~alike(w, self.run) & inside
        place, before = place[mixed], before[mixed]
        if not len(place):
            return place, before, np.zeros(0, np.int64)
        code = np.unique(place * 2 + before)
        place, before = code >> 1, code & 1 > 0
        around = shingles(w, self.context)
        return place, before, np.where(before, around[place - np.where(before, self.context - SHINGLE, 0)], ~around[np.minimum(place, len(around) - 1)]).view(np.int64)


def fingerprints(docs: DataFrame, least: int, run: int) -> DataFrame:
    """doc_id, at (twice the place of a minimum, plus one for the words before it), print (the key), until (0), needs.

    needs: the words before the place, and 256 times those from it on, that must be removed for all its windows to be.

    And the stretches of one word: doc_id, at (the first place), print (the word), until (the place after the last), 0.
    """

    def rows(ids: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
        # Texts in a row, each with a word behind it that is nowhere else.
        lengths = np.array([len(t) + 1 for t in texts])
        gaps = np.cumsum(lengths) - 1
        w = np.concatenate([x for t, g in zip(texts, mix(np.arange(1, len(texts) + 1, dtype=np.uint64))) for x in (t, g[None])])
        inside = np.ones(max(0, len(w) - run + 1), bool)
        for k in range(run):
            inside[(x := gaps - k)[(x >= 0) & (x < len(inside))]] = False
        place, before, key = bands.keys(w, inside)
        start, end = stretches_of_one_word(w, least)
        # The minimum of one word and another at the end is the last shingle, of one that begins with another the first.
        left, right = beyond(w, run, least)
        back = run - SHINGLE
        left = np.where(place >= back, left[np.clip(place - back, 0, len(left) - 1)], 0)
        right = np.where(place < len(right), right[np.minimum(place, len(right) - 1)], 0)
        at = np.concatenate([place, start])
        text = np.searchsorted(gaps, at)
        first = (gaps + 1 - lengths)[text]
        n, m = len(place), len(start)
        places = np.concatenate([(place - first[:n]) * 2 + before, start - first[n:]])
        until, needs = np.concatenate([np.zeros(n, np.int64), end - first[n:]]), np.concatenate([back + left + 256 * (run + right), np.zeros(m, np.int64)])
        found = np.concatenate([key, w[start].view(np.int64)])
        columns = (np.array(ids, np.int64)[text], np.int64), (places, np.int32), (found, np.int64), (until, np.int32), (needs, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(kind)) for c, kind in columns], names=["doc_id", "at", "print", "until", "needs"])

    def keys(batches):
        hashes = WordHashes()
        for b in batches:
            ids, texts, n = [], [], 0
            for i, t in zip(b.column(0), b.column(1)):
                words = t.as_py().lower().split()
                if len(words) < least:
                    continue
                if ids and n + len(words) > 30_000:
                    yield rows(ids, texts)
                    ids, texts, n = [], [], 0
                ids.append(i.as_py())
                texts.append(hashes.of(words))
                n += len(words)
            if ids:
                yield rows(ids, texts)

    bands = Bands(run)
    return docs.where("doc_id is not null").select("doc_id", as_bytes()).mapInArrow(keys, "doc_id long, at int, print long, until int, needs int")


def matches_of_one_word(found: DataFrame, tables: Tables) -> DataFrame:
    """Matches of stretches (doc_id, at, until) of one word (print), in as many rows as there are stretches, twice at most.

    Each is held against the first one of the smallest document, whose others are linked by the next document.
    """
    longest = tables.write(found.select("print", "doc_id", F.col("at").cast("long").alias("start_word"), F.col("until").cast("long").alias("end_word")).distinct(), "one-word")
    least = lambda rows: rows.groupBy("print").agg(F.min(F.struct("doc_id", "start_word", "end_word")).alias("x"))
    kept = least(longest).select("print", *(F.col(f"x.{a}").alias(b) for a, b in (("doc_id", "kept_doc_id"), ("start_word", "kept_start"), ("end_word", "kept_end"))))
    both = tables.write(longest.join(kept, "print"), "one-word-pairs")
    tables.drop(longest)
    names = ["doc_id", "start_word", "end_word", "kept_doc_id", "kept_start", "kept_end"]
    others = both.where("doc_id > kept_doc_id")
    second = least(others).select("print", "x.*")
    links = both.where("doc_id = kept_doc_id").select("print", "kept_doc_id", F.col("start_word").alias("kept_start"), F.col("end_word").alias("kept_end")).join(second, "print")
    out = tables.write(others.select(*names).union(links.select(*names)).distinct(), "spans")
    tables.drop(both)
    return out


def colliding_windows(words: DataFrame, members: DataFrame, run: int, least: int) -> DataFrame:
    """doc_id, at, print, needs: the windows of `run` words with their band minimum at a member, by the hash of all their words.

    Windows of one word are left out.
    """
    places = members.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("at").alias("places"))

    def keys(batches):
        bands = Bands(run)
        for b in batches:
            ids, starts, found, needs = [], [], [], []
            for i, w, p in zip(b.column(0), b.column(1), b.column(2)):
                w = np.frombuffer(w.as_buffer(), np.uint64)
                place, before = bands.windows(w)
                at = np.flatnonzero(np.isin(place * 2 + before, p.values.to_numpy()) & ~alike(w, run))
                ids.append(np.full(len(at), i.as_py(), np.int64))
                starts.append(at)
                found.append(shingles(w, run)[at])
                left, right = beyond(w, run, least)
                needs.append((left + 256 * (run + right))[at])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(needs).astype(np.int32))], names=["doc_id", "at", "print", "needs"])

    return words.join(places, F.col("id") == F.col("of")).select("id", "words", "places").mapInArrow(keys, "doc_id long, at int, print long, needs int")


class Words:
    """A text's word hashes, and the hashes of its shingles as plain numbers."""

    def __init__(self, hashes: np.ndarray):
        self.words = hashes
        self.hashes = shingles(hashes, SHINGLE) if len(hashes) >= SHINGLE else np.zeros(0, np.uint64)
        self.shingles = self.hashes.tolist()
        self.repeats: np.ndarray | None = None

    def differ(self, start: int, end: int) -> bool:
        """Whether all shingles of the words from start to end are different."""
        if self.repeats is None:
            # From each place on, the first shingle that stands there before.
            order = np.argsort(self.hashes, kind="stable")
            again = self.hashes[order[1:]] == self.hashes[order[:-1]]
            self.repeats = np.full(len(order) + 1, len(order))
            self.repeats[order[:-1][again]] = order[1:][again]
            self.repeats = np.minimum.accumulate(self.repeats[::-1])[::-1]
        return end - SHINGLE < self.repeats[start]


def equal_ahead(p: np.ndarray, q: np.ndarray, i: int, j: int, step: int = 1) -> int:
    """How many words from p[i] and q[j] on are equal, forwards or (step -1) backwards."""
    done, size = 0, 64
    most = min(len(p) - i, len(q) - j) if step > 0 else min(i, j) + 1
    while done < most:
        n = min(size, most - done)
        a, b = (p[i + done : i + done + n], q[j + done : j + done + n]) if step > 0 else (p[i - done - n + 1 : i - done + 1][::-1], q[j - done - n + 1 : j - done + 1][::-1])
        differ = a != b
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + n, size * 4
    return done


def runs(p: Words, q: Words, seeds: list[tuple[int, int]]) -> list[list[int]]:
    """Longest exact runs [p start, p end, q start, q end] around the seeds, sorted."""
    found: dict[int, list[tuple[int, int]]] = {}
    for i, j in sorted(seeds):
        known = found.setdefault(i - j, [])
        # Seeds come in order, so only the last run of their distance can hold one.
        if known and i < known[-1][1]:
            continue
        end = i + equal_ahead(p.words, q.words, i, j)
        start = i - equal_ahead(p.words, q.words, i - 1, j - 1, -1)
        if end - start >= SHINGLE:
            known.append((start, end))
    return sorted([a, b, a - g, b - g] for g, x in found.items() for a, b in x)


#: Words left out of either side of a chain where it goes on, the shortest edits first.
EDITS = [(x, y) for x in range(1, STEP + 1) for y in sorted(range(1, STEP + 1), key=lambda y: abs(x - y))]


def grown(p: Words, q: Words, chain: list[list[int]]) -> tuple[list[list[int]], int]:
    """The chain's runs and those beyond an edit that agree again, on both ends, as far as such stretches go; how many are before it."""
    s, t, n, m = p.shingles, q.shingles, len(p.shingles), len(q.shingles)
    before, (a, _, c, _) = [], chain[0]
    more = True
    while more:
        more = False
        for x, y in EDITS:
            i, j = a - x - SHINGLE, c - y - SHINGLE
            if i >= 0 and j >= 0 and s[i] == t[j]:
                ahead = equal_ahead(p.words, q.words, i + SHINGLE - 1, j + SHINGLE - 1, -1)
                before.append([i + SHINGLE - ahead, i + SHINGLE, j + SHINGLE - ahead, j + SHINGLE])
                a, c, more = before[-1][0], before[-1][2], ahead > 0
                break
    out, (_, b, _, d) = before[::-1] + chain, chain[-1]
    more = True
    while more:
        more = False
        for x, y in EDITS:
            i, j = b + x, d + y
            if i < n and j < m and s[i] == t[j]:
                ahead = equal_ahead(p.words, q.words, i, j)
                out.append([i, i + ahead, j, j + ahead])
                b, d, more = i + ahead, j + ahead, ahead > 0
                break
    return out, len(before)


def matches(p: Words, q: Words, seeds: list[tuple[int, int]], least: int, percent: int, seeded: bool = False) -> list[list[int]]:
    """Stretches [p start, p end, q start, q end] of `least` words on each side that have the similarity.

    A chain is a sequence of equal runs, with a few other words between them. Where the whole chain is not alike enough,
    the longest of its parts are taken that are, from run to run; seeded: of those only the ones with a seed in them.
    """
    chains: list[list[list[int]]] = []
    ends: dict[int, list[list[list[int]]]] = {}
    for a, b, c, d in runs(p, q, seeds):
        near = (x for e in range(a - STEP, a + STEP + 1) for x in ends.get(e, ()))
        x = next((x for x in near if -STEP <= c - x[-1][3] <= STEP and b > x[-1][1] and d > x[-1][3]), None)
        if x:
            ends[x[-1][1]].remove(x)
            x.append([a, b, c, d])
        else:
            x = [[a, b, c, d]]
            chains.append(x)
        ends.setdefault(b, []).append(x)
    out: list[list[int]] = []
    for x in chains:
        if any(y[0] <= x[0][0] and x[-1][1] <= y[1] and y[2] <= x[0][2] and x[-1][3] <= y[3] for y in out[-1:]):
            continue
        own = len(x)
        x, before = grown(p, q, x)
        x = np.array(x)
        # Shingles of equal runs up to each run, where runs overlap each word once; a bound on what the sides share.
        same = np.concatenate([[0], np.cumsum(np.maximum(0, x[:, 1] - x[:, 0] - SHINGLE + 1))])
        # A part from run i to run j has the similarity by that bound where reach[j] >= need[i]: (100 + percent) * shared >= percent * all.
        reach = (100 + percent) * same[1:] - percent * (x[:, 1] + x[:, 3])
        need = (100 + percent) * same[:-1] - percent * (x[:, 0] + x[:, 2] + 2 * (SHINGLE - 1))
        done = -1
        for i in np.flatnonzero(np.maximum.accumulate(reach[::-1])[::-1] >= need).tolist():
            first = max(i, before, done + 1) if seeded else max(i, done + 1)
            if seeded and i >= before + own:
                break
            fits = first + np.flatnonzero((reach[first:] >= need[i]) & (np.minimum(x[first:, 1] - x[i, 0], x[first:, 3] - x[i, 2]) >= least))
            for j in fits[::-1].tolist():
                a, b, c, d = x[i, 0], x[j, 1], x[i, 2], x[j, 3]
                # Where no shingle of a side repeats, the bound is what the sets share at least.
                if not (p.differ(a, b) and q.differ(c, d)):
                    s, t = (np.unique(v) for v in (p.hashes[a : b - SHINGLE + 1], q.hashes[c : d - SHINGLE + 1]))
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * shared < percent * (len(s) + len(t) - shared):
                        continue
                out.append([int(a), int(b), int(c), int(d)])
                done = j
                break
            if done == len(x) - 1:
                break
    return out


class Side:
    """The word hashes of one side of many pairs in a row, words that are nowhere else between them."""

    #: Words around a text, more than a look beyond the ends of a run goes.
    GAP = STEP + SHINGLE + 1
    POWERS = np.ones(1, np.uint64)

    def __init__(self, texts: list[np.ndarray], odd: int):
        self.at = np.cumsum([self.GAP, *(len(t) + self.GAP for t in texts)])[:-1]
        gaps = mix(np.arange(self.GAP * (len(texts) + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(odd)).reshape(-1, self.GAP)
        self.words = np.concatenate([gaps[0], *(x for t, g in zip(texts, gaps[1:]) for x in (t, g))])
        self.shingles = shingles(self.words, SHINGLE)
        if len(Side.POWERS) <= len(self.words):
            Side.POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * len(self.words), MIX1)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.words * Side.POWERS[: len(self.words)], dtype=np.uint64)])


def equal_lengths(p: Side, q: Side, i: np.ndarray, j: np.ndarray, step: int = 1) -> np.ndarray:
    """How many words from each i and j on are equal, forwards or (step -1) those before them, by hashes of their sums."""
    done, on, size = np.zeros(len(i), np.int64), np.arange(len(i)), 64
    while len(on):
        # Up to 2 * size - 1 words more; what is equal as far as that goes on.
        before = done[on]
        top = size
        while size:
            a, b = i[on] + step * done[on] - (size if step < 0 else 0), j[on] + step * done[on] - (size if step < 0 else 0)
            inside = (np.minimum(a, b) >= 0) & (a + size < len(p.sums)) & (b + size < len(q.sums))
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            stop = inside * size
            same = (p.sums[a + stop] - p.sums[a]) * Side.POWERS[b] == (q.sums[b + stop] - q.sums[b]) * Side.POWERS[a]
            done[on] += size * (same & inside)
            size >>= 1
        on, size = on[done[on] - before == 2 * top - 1], top * 16
    return done


def thinned(row: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which runs to keep of those with one side in common whose other sides overlap: the same words hang together by them."""
    on = np.arange(len(n))
    for same, other in ((a, c), (c, a)):
        x = on[np.lexsort((other[on], n[on], same[on], row[on]))]
        part = other[x] // width
        first = np.ones(len(x), bool)
        first[1:] = (row[x[1:]] != row[x[:-1]]) | (same[x[1:]] != same[x[:-1]]) | (n[x[1:]] != n[x[:-1]]) | (part[1:] != part[:-1])
        on = x[first | np.append(first[1:], True)]
    return np.sort(on)


def sorted_runs(p: Side, q: Side, row: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The equal runs at the seeds (i, j) of each row, as columns: (row, i, j) where chains may begin, (row, i, j, n) of matches.

    A run at whose ends nothing agrees again, and no other run begins, is a chain by itself: it is a match if it has `least`
    words, and nothing if it has fewer.
    """
    i, j = p.at[row] + i, q.at[row] + j
    back = equal_lengths(p, q, i, j, -1)
    code = np.unique(np.stack([row, i - back, j - back]), axis=1) if len(i) else np.zeros((3, 0), np.int64)
    row, a, c = code
    n = equal_lengths(p, q, a, c)
    b, d = a + n, c + n
    beyond = np.arange(1, STEP + 1)
    can = np.zeros(len(n), bool)
    for some in np.array_split(np.arange(len(n)), len(n) // 50_000 + 1):
        x, y = p.shingles[b[some, None] + beyond], q.shingles[d[some, None] + beyond]
        u, v = p.shingles[a[some, None] - SHINGLE - beyond], q.shingles[c[some, None] - SHINGLE - beyond]
        can[some] = ((x[:, :, None] == y[:, None]) | (u[:, :, None] == v[:, None])).any((1, 2))
    # Runs that begin within STEP of the end of another one, found by cells of more words than that is wide.
    cell = lambda a, c: mix(mix(row.astype(np.uint64) << np.uint64(32) | (a >> 4).astype(np.uint64)) + (c >> 4).astype(np.uint64))
    starts = cell(a, c)
    for x in (-STEP, STEP):
        for y in (-STEP, STEP):
            ends = cell(b + x, d + y)
            can |= np.isin(ends, starts) | np.isin(starts, ends)
    found = np.stack([row, a - p.at[row], c - q.at[row], n])
    alone = found[:, ~can & (n >= least)]
    return found[:3, can], alone[:, thinned(*alone, least // 2)]


def merged(stretches: DataFrame) -> DataFrame:
    """Stretches (doc_id, start_word, end_word) that overlap or touch as one."""
    ordered = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = stretches.distinct().withColumn("new", F.coalesce(before < F.col("start_word"), F.lit(True)).cast("int"))
    return fresh.withColumn("part", F.sum("new").over(ordered)).groupBy("doc_id", "part").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("part")


def blocks(places: DataFrame, tables: Tables) -> DataFrame:
    """Places (print, doc_id, at, needs, matched) whose print stands after the same other one, and that before no other, as one.

    Any two places of a later print of a block are in the same equal run as two of its first, so the first finds all pairs
    and their runs. The block's needs are those of all its places: they overlap, so it is removed where all of them are.
    """
    ordered = Window.partitionBy("doc_id").orderBy("at")
    last = F.lag(F.struct("at", "print")).over(ordered)
    rows = tables.write(places.withColumn("last", F.when(last["at"] == F.col("at") - 1, last["print"])), "rows")
    sizes = tables.write(rows.groupBy("print").agg(F.count("*").alias("n"), F.count("last").alias("n_last"), F.min("last").alias("last"), F.max("last").alias("other")), "sizes")
    before = sizes.select(F.col("print").alias("last"), F.col("n").alias("n_before"))
    later = sizes.where("n = n_last and last = other").join(before, "last").where("n = n_before").select("print", F.lit(False).alias("first"))
    # A row whose print is later has the place before it in its block.
    marked = rows.join(later, "print", "left").withColumn("first", F.coalesce("first", F.lit(True)))
    part = F.sum(F.col("first").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ends = marked.withColumn("part", part).withColumn("start", F.col("at") - F.col("needs").bitwiseAND(255)).withColumn("end", F.col("at") + F.shiftright("needs", 8))
    one = ends.groupBy("doc_id", "part").agg(F.min(F.struct("at", "print")).alias("x"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("matched").alias("matched"))
    out = one.select("x.print", "doc_id", "x.at", (F.col("x.at") - F.col("start") + 256 * (F.col("end") - F.col("x.at"))).cast("int").alias("needs"), "matched")
    out = tables.write(out, "blocks")
    tables.drop(rows, sizes)
    return out


def repeated_passages(docs: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """The stretches to remove: doc_id, start_word, end_word (exclusive), n_words, kept_doc_id, cluster_id.

    kept_doc_id is a document with a smaller id that has the stretch as well, cluster_id the smallest doc_id of the
    stretches that hang together. Words are compared with A-Z in lower case. Null, empty and short texts have none;
    rows without doc_id, or that repeat one, are not held against each other. Empty tables give no rows, other columns
    are not looked at.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    length = certain_run(least, percent)
    every = tables.write(fingerprints(docs, least, length), "prints")
    settled = matches_of_one_word(every.where("until > 0"), tables)
    found = every.where("until = 0").drop("until")
    shared = found.groupBy("print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("print")
    members = tables.write(found.join(tables.write(shared, "shared"), "print").select("print", "doc_id", "at", "needs", F.lit(False).alias("matched")), "members")
    tables.drop(every)
    bits = spark.sparkContext.broadcast(bloom(spark, members.select(F.col("doc_id").alias("id"))))

    def hashing():
        hashes = WordHashes()
        return lambda t: hashes.of(t.lower().split()).tobytes()

    # Word hashes of the texts that have candidates, each once; rows that repeat a doc_id count as one.
    words = tables.write(needed(docs, bits, hashing, "id long, words binary").dropDuplicates(["id"]), "words")
    n_words = words.count()

    def run(batches, seeded):
        kept: dict[int, Words] = {}

        def get(i, w):
            if i not in kept:
                if len(kept) >= 32:
                    kept.clear()
                kept[i] = Words(np.frombuffer(w.as_buffer(), np.uint64))
            return kept[i]

        names = ["doc_id", "start_word", "end_word", "kept_doc_id", "kept_start", "kept_end"]
        for b in batches:
            rows, seeds = [], b.column(2).flatten()
            sides = (Side([np.frombuffer(w.as_buffer(), np.uint64) for w in b.column(n)], n % 2) for n in (3, 4))
            at, kept_at = (seeds.field(n).to_numpy().astype(np.int64) for n in (0, 1))
            (row, at, kept_at), alone = sorted_runs(*sides, np.repeat(np.arange(len(b)), b.column(2).value_lengths().to_numpy()), at, kept_at, least)
            ids, kept_ids = (b.column(n).to_numpy()[alone[0]] for n in (0, 1))
            rows += zip(*(c.tolist() for c in (ids, alone[1], alone[1] + alone[3], kept_ids, alone[2], alone[2] + alone[3])))
            ends = np.flatnonzero(np.diff(row, append=-1)) + 1
            for x, y in zip([0, *ends.tolist()], ends.tolist()):
                (i, k), (p, q) = (b.column(n)[row[x]].as_py() for n in (0, 1)), (b.column(n)[row[x]] for n in (3, 4))
                found = matches(get(i, p), get(k, q), list(zip(at[x:y].tolist(), kept_at[x:y].tolist())), least, percent, seeded)
                rows += [(i, m[0], m[1], k, m[2], m[3]) for m in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    def against(hits: DataFrame, seeded: bool = False) -> DataFrame:
        """Matches of documents that collide at (at, kept_at); seeded: only those with a collision in them."""
        # Collisions at one distance whose windows share words are one seed.
        gap = (F.col("at") - F.col("kept_at")).alias("gap")
        seeds = hits.groupBy("doc_id", "kept_doc_id", gap, F.floor(F.col("at") / SHINGLE).alias("part")).agg(F.min("at").alias("at"))
        pairs = seeds.groupBy("doc_id", "kept_doc_id").agg(F.collect_list(F.struct("at", (F.col("at") - F.col("gap")).alias("kept_at"))).alias("seeds"))
        # Written, so that the collisions' shuffles are gone before the texts are shuffled, and only texts that are needed.
        pairs = tables.write(pairs, "pairs")
        ids, texts = pairs.select("doc_id").union(pairs.select("kept_doc_id")).distinct(), words
        if 2 * ids.count() < n_words:
            on = spark.sparkContext.broadcast(bloom(spark, ids.toDF("id")))
            texts = tables.write(needed(words.toDF("doc_id", "text"), on, schema="id long, words binary"), "texts")
        both = pairs.join(texts.toDF("doc_id", "words"), "doc_id").join(texts.toDF("kept_doc_id", "kept_words"), "kept_doc_id")
        new = both.select("doc_id", "kept_doc_id", "seeds", "words", "kept_words").mapInArrow(lambda batches: run(batches, seeded), "doc_id long, start_word long, end_word long, kept_doc_id long, kept_start long, kept_end long")
        out = tables.write(new.distinct(), "spans")
        tables.drop(pairs, *([texts] if texts is not words else []))
        return out

    def covered(places: DataFrame) -> DataFrame:
        """matched: whether the words before a place, and from it on, that its needs name are removed."""
        cover = merged(spans.select("doc_id", "start_word", "end_word")).toDF("d", "s", "e")
        # As far before the start of the text as there are no words.
        start = F.greatest(F.col("at") - F.col("needs").bitwiseAND(255), F.lit(0))
        inside = (F.col("doc_id") == F.col("d")) & (start >= F.col("s")) & (F.col("at") + F.shiftright("needs", 8) <= F.col("e"))
        return tables.write(places.join(cover, inside, "left").select("print", "doc_id", "at", "needs", (F.col("matched") | F.col("d").isNotNull()).alias("matched")), "places")

    def open_prints(places: DataFrame) -> DataFrame:
        """Prints that a document other than the first has outside all that is removed."""
        ends = places.groupBy("print").agg(F.min("doc_id").alias("low"), F.max(F.when(~F.col("matched"), F.col("doc_id"))).alias("high"))
        return ends.where("low < high").select("print")

    # A place is twice that of a band minimum, plus one for the key before it.
    places = members.withColumn("at", F.shiftright("at", 1))
    first = places.groupBy("print").agg(F.min(F.struct("doc_id", "at")).alias("x")).select("print", F.col("x.doc_id").alias("kept_doc_id"), F.col("x.at").alias("kept_at"))
    spans = settled.union(against(places.join(first, "print").where("doc_id > kept_doc_id")))
    rest = covered(places)
    both_keys = members.join(open_prints(rest), "print").select("doc_id", "at").distinct()
    windows = tables.write(colliding_windows(words, tables.write(both_keys, "open"), length, least), "windows")
    tables.drop(members, rest)
    members = covered(windows.withColumn("matched", F.lit(False)))
    members = blocks(members.join(open_prints(members), "print"), tables)
    tables.drop(windows)
    turn = 0
    while not members.isEmpty():
        # The places of the next documents, more of them each turn, are held against all of larger ones not removed yet.
        rank = F.dense_rank().over(Window.partitionBy("print").orderBy("doc_id"))
        ranked = tables.write(members.withColumn("pivot", rank <= 16**turn), "ranked")
        pivots = ranked.where("pivot").select("print", F.col("doc_id").alias("kept_doc_id"), F.col("at").alias("kept_at"))
        hits = ranked.where("not matched").join(pivots, "print").where("doc_id > kept_doc_id")
        # Other parts of two documents that are alike have places of their own where these are still open.
        spans = spans.union(against(hits, seeded=True))
        # Places that have been pivots have met all others.
        rest = covered(ranked.where("not pivot"))
        tables.drop(members)
        members = tables.write(rest.join(open_prints(rest), "print"), "members")
        tables.drop(ranked, rest)
        turn += 1
    spans = tables.write(spans.distinct(), "all-spans")

    # Stretches of a document that overlap are one region.
    every = spans.select("doc_id", "start_word", "end_word").union(spans.select("kept_doc_id", "kept_start", "kept_end")).distinct()
    ordered = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = every.withColumn("new", F.coalesce(before <= F.col("start_word"), F.lit(True)).cast("int"))
    region = fresh.withColumn("start", F.max(F.when(F.col("new") == 1, F.col("start_word"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    region = tables.write(region.select("doc_id", "start_word", "end_word", F.xxhash64("doc_id", "start").alias("node")), "regions")
    one = region.toDF("doc_id", "start_word", "end_word", "u")
    two = region.toDF("kept_doc_id", "kept_start", "kept_end", "v")
    linked = tables.write(spans.join(one, ["doc_id", "start_word", "end_word"]).join(two, ["kept_doc_id", "kept_start", "kept_end"]), "linked")
    parts = tables.write(components(linked.select("u", "v"), tables), "components")
    names = tables.write(region.select("node", "doc_id").distinct().join(parts, "node").groupBy("component").agg(F.min("doc_id").alias("cluster_id")), "names")
    tables.only(linked, parts, names)
    labels = parts.join(names, "component").select(F.col("node").alias("u"), "cluster_id")
    out = linked.groupBy("doc_id", "u", "start_word").agg(F.max(F.struct("end_word", -F.col("kept_doc_id"))).alias("x")).join(labels, "u")
    out = out.select("doc_id", "cluster_id", "start_word", F.col("x.end_word").alias("end_word"), (-F.col("x.col2")).alias("kept_doc_id"))
    # What is inside another stretch of the document goes with it.
    before = F.max("end_word").over(Window.partitionBy("doc_id").orderBy("start_word").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("start_word", F.greatest("start_word", F.coalesce(before, F.lit(0)))).where("start_word < end_word")
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "kept_doc_id", "cluster_id")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the stretches cut out of their texts; all other characters stay."""
    cut = passages.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_spans"))
    rows = docs.join(cut, docs["doc_id"] == cut["_id"], "left").drop("_id")

    @F.pandas_udf("string")
    def shorten(texts, spans):
        import re

        import pandas as pd

        out = []
        for t, s in zip(texts, spans):
            if t is not None and s is not None and len(s):
                places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                parts, at = [], 0
                for x in s:
                    parts.append(t[at : places[x["start_word"]][0]])
                    at = places[x["end_word"] - 1][1]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out)

    return rows.withColumn("text", shorten("text", "_spans")).drop("_spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
