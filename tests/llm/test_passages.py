import random
import time

import numpy as np

from sparkforge.llm.common import Tables, WordHashes, shingles
from sparkforge.llm.op04_substring_dedup import Bands, Side, Words, certain_run, fingerprints, matches, repeated_passages, sorted_runs, without_passages
from sparkforge.llm.op08_decontamination import NUMERIC, OUTER, UNITS, decontaminate

SCHEMA = "doc_id long, text string, lang string, source string, at int, print string, seeds int, hash string, id int, gap string, item_id int, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "p", 2, "h", 3, "g", 4, "n") for i, t in rows], SCHEMA)


def words(rng, n):
    return ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_passages_anywhere_in_a_text(spark):
    rng = random.Random(1)
    passage, other = words(rng, 60), words(rng, 90)
    docs = {i: words(rng, 200) for i in range(40)}
    for i in (3, 11, 25):
        docs[i][50:50] = passage
    edited = list(passage)
    edited[30] = "changed"
    docs[30][100:100] = edited
    docs[5] = other + docs[5]
    docs[6] += other
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    out = repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in out} == {11, 25, 30, 6} and {r.kept_doc_id for r in out} == {3, 5}
    by = {r.doc_id: r for r in out}
    for i in (11, 25, 30):
        assert by[i].cluster_id == 3 and by[i].n_words >= 60 and by[i].start_word <= (100 if i == 30 else 50)
    assert by[6].cluster_id == 5
    cut = {r.doc_id: r.text for r in without_passages(frame(spark, rows), repeated_passages(frame(spark, rows))).collect()}
    assert " ".join(passage) in cut[3] and not any(" ".join(passage[:40]) in cut[i] for i in (11, 25, 30)) and cut[0] == rows[0][1]


def test_short_repeats_stay(spark):
    rng = random.Random(2)
    line = " ".join(words(rng, 30))
    rows = [(i, line + "\n" + " ".join(words(rng, 120))) for i in range(12)]
    assert repeated_passages(frame(spark, rows)).collect() == []


def test_copies_keep_one(spark):
    rng = random.Random(3)
    text = " ".join(words(rng, 150))
    out = repeated_passages(frame(spark, [(i, text.upper() if i == 4 else text) for i in range(2, 9)])).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.kept_doc_id) for r in out} == {(i, 0, 150, 2) for i in range(3, 9)}


def test_copies_behind_a_first_place_that_does_not_match(spark):
    rng = random.Random(6)
    rows, fill = [], lambda w: (i := len(rows), " ".join(words(rng, 70) + w + words(rng, 70)))
    for _ in range(8):
        passage = words(rng, 60)
        for part in (passage[:45], passage[15:], passage, passage):
            rows.append(fill(part))
    out = repeated_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in out} == {(4 * g + 3, 4 * g + 2) for g in range(8)} and all(r.n_words == 60 for r in out)


def test_certain_run():
    assert certain_run(50, 80) == 25 and certain_run(50, 100) == 50 and certain_run(100, 80) == 33


def test_equal_runs_share_a_key():
    """Two texts with an equal run of G words, wherever it lies and whatever is around it, have a band key in common."""
    rng = np.random.default_rng(2)
    bands = Bands(25)
    for k in range(300):
        run = rng.integers(0, 2 if k % 3 == 0 else 1 << 40, 25).astype(np.uint64)
        sides = [rng.integers(1 << 41, 1 << 62, n).astype(np.uint64) for n in rng.integers(0, 40, 4)]
        one, two = (np.concatenate([a, run, b]) for a, b in (sides[:2], sides[2:]))
        assert set(bands.keys(one)[2].tolist()) & set(bands.keys(two)[2].tolist())


def test_alignment_like_brute_force():
    """Every pair of stretches of 50 words that begin and end alike, with a similarity of 80 %, lies in a match of the texts."""
    rng = random.Random(11)
    for _ in range(30):
        passage = words(rng, rng.randint(50, 140))
        edited = list(passage)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = words(rng, rng.randint(0, 1))
        one, two = words(rng, 30) + passage + words(rng, 30), words(rng, 45) + edited + words(rng, 5)
        ids: dict = {}
        p, q = (np.array([ids.setdefault(w, len(ids) + 1) for w in t], np.uint64) for t in (one, two))
        sets = [[{tuple(t[i + k : i + k + 5]) for k in range(46)} for i in range(len(t) - 49)] for t in (one, two)]
        runs = [{tuple(t[i : i + 25]): i for i in range(len(t) - 24)} for t in (one, two)]
        found = matches(Words(p), Words(q), [(i, runs[1][w]) for w, i in runs[0].items() if w in runs[1]], 50, 80)
        for i, a in enumerate(sets[0]):
            for j, b in enumerate(sets[1]):
                ends = one[i : i + 5] == two[j : j + 5] and one[i + 45 : i + 50] == two[j + 45 : j + 50]
                if ends and 100 * len(a & b) >= 80 * len(a | b):
                    assert any(x[0] <= i and i + 50 <= x[1] and x[2] <= j and j + 50 <= x[3] for x in found)


def regions(found):
    """Stretches of either side that overlap as one, and which of them are linked."""
    sides = []
    for lo, hi in ((0, 1), (2, 3)):
        side: list = []
        for a, b in sorted((m[lo], m[hi]) for m in found):
            if side and a < side[-1][1]:
                side[-1][1] = max(side[-1][1], b)
            else:
                side.append([a, b])
        sides.append(side)
    number = lambda side, at: next(i for i, (a, b) in enumerate(side) if a <= at < b)
    return sides, {(number(sides[0], m[0]), number(sides[1], m[2])) for m in found}


def test_runs_by_themselves_change_no_match():
    """Texts with words that repeat many times: what many pairs at once leave to the alignment, and what they settle."""
    rng = random.Random(13)
    seeds_before = seeds_after = 0
    for _ in range(120):
        texts, others, seeds = [], [], []
        for r in range(rng.randint(1, 4)):
            known = [rng.getrandbits(63) for _ in range(rng.choice([2, 3, 50, 1000]))]
            text = [w for _ in range(rng.randint(0, 10)) for w in ([rng.choice(known)] * rng.randint(1, 45) if rng.random() < 0.5 else rng.choices(known, k=rng.randint(1, 40)))]
            other = list(text)
            for _ in range(rng.randint(0, 8) if text else 0):
                at = rng.randrange(len(other))
                other[at : at + rng.randint(0, 2)] = rng.choices(known, k=rng.randint(1, 8))
            texts.append(np.array(text, np.uint64))
            others.append(np.array(other, np.uint64))
            if min(len(text), len(other)) >= 25:
                there = shingles(others[r], 25)
                seeds += [(r, i, int(j)) for i, h in enumerate(shingles(texts[r], 25)) for j in np.flatnonzero(there == h)]
        row, at, kept_at = np.array(seeds, np.int64).reshape(-1, 3).T
        open_runs, alone = sorted_runs(Side(texts, 1), Side(others, 0), row, at, kept_at, 50)
        seeds_before, seeds_after = seeds_before + len(seeds), seeds_after + open_runs.shape[1]
        for r, (p, q) in enumerate(zip(texts, others)):
            want = matches(Words(p), Words(q), [(i, j) for k, i, j in seeds if k == r], 50, 80)
            got = matches(Words(p), Words(q), [(int(i), int(j)) for k, i, j in open_runs.T if k == r], 50, 80)
            assert regions(got + [[i, i + n, j, j + n] for k, i, j, n in alone.T.tolist() if k == r]) == regions(want)
    assert seeds_after < seeds_before / 10


def test_written_tables_leave_no_shuffles(spark):
    blocks = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    known = set(blocks().split())
    Tables(spark, "test").write(spark.range(1000).repartition(7, "id"), "rows")
    for _ in range(100):
        left = [x for x in set(blocks().split()) - known if x.startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_one_word_many_times(spark):
    """Stretches of one word go where a smaller document has one too, without a row for each pair of their places."""
    rng = random.Random(14)
    rows, want = [], set()
    for i in range(40):
        w, word = [], "la" if i % 2 else "of"
        for n in (rng.randint(50, 400), rng.randint(50, 90), 49, rng.randint(20, 49)):
            w += [f"{i}-{len(w) + k}" for k in range(30)] + [word] * n
            if n >= 50 and i > 1:
                want.add((i, len(w) - n, len(w)))
        rows.append((i, " ".join([*w, f"end{i}"])))
    seen, write = [], Tables.write
    Tables.write = lambda self, df, name, *more: (out := write(self, df, name, *more), seen.append((name, out.count())))[0]
    try:
        out = repeated_passages(frame(spark, rows)).collect()
    finally:
        Tables.write = write
    assert {(r.doc_id, r.start_word, r.end_word) for r in out} == want
    assert {(r.doc_id % 2, r.kept_doc_id, r.cluster_id) for r in out} == {(0, 0, 0), (1, 1, 1)}
    assert max(n for name, n in seen if name == "spans") <= 2 * len(want)


def test_windows_with_one_word_many_times(spark):
    """No window of 50 words that repeats is left out where one word many times in a row is a part of it."""
    rng = random.Random(15)
    tails = [words(rng, n) for n in (3, 8, 20, 30)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(3):
            w += [rng.choice(["of", "la"])] * rng.choice([10, 24, 25, 30, 38, 44, 49, 50, 60]) + rng.choice([*tails, [f"only{i}"]])
        rows.append((i, w))
    removed: dict = {}
    for r in repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        removed.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    first: dict = {}
    left_out = [(i, at) for i, w in rows for at in range(len(w) - 49) if first.setdefault(tuple(w[at : at + 50]), i) < i and not set(range(at, at + 50)) <= removed.get(i, set())]
    assert not left_out


def test_recall_against_all_windows_of_the_documents(spark):
    """Exact passages, passages with an edit anywhere, halves of them in smaller documents, and families of copies."""
    rng = random.Random(12)
    rows, near = [], set()
    put = lambda w: rows.append((len(rows), words(rng, rng.randint(0, 60)) + w + words(rng, rng.randint(0, 60))))
    for k in range(60):
        passage = words(rng, rng.randint(50, 70))
        edited = list(passage)
        if k % 2:
            edited[rng.randrange(len(edited))] = "changed"
        if k % 3 == 0:
            put(passage[:36])
            put(passage[-36:])
        put(passage)
        put(edited)
        near.add((len(rows) - 1, len(rows) - 2))
    base = words(rng, 200)
    for _ in range(15):
        copy = list(base)
        for _ in range(7):
            copy[rng.randrange(200)] = words(rng, 1)[0]
        put(copy)
    out = repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    removed: dict = {}
    for r in out:
        removed.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert len(near & {(r.doc_id, r.kept_doc_id) for r in out}) >= 0.95 * len(near)
    first: dict = {}
    total = lost = 0
    for i, w in rows:
        for at in range(len(w) - 49):
            if first.setdefault(tuple(w[at : at + 50]), i) < i:
                total += 1
                lost += not set(range(at, at + 50)) <= removed.get(i, set())
    assert total > 500 and lost == 0


def test_lines_of_many_documents_are_one_place_each(spark):
    """All windows of a line that is too short for a passage are held against the others by their first one only."""
    rng = random.Random(16)
    line, passage = words(rng, 40), words(rng, 55)
    rows = [(i, " ".join(words(rng, 30) + line + words(rng, 30) + (passage if i in (7, 20) else []))) for i in range(30)]
    seen, write = [], Tables.write
    Tables.write = lambda self, df, name, *more: (out := write(self, df, name, *more), seen.append((name, out.count())))[0]
    try:
        out = repeated_passages(frame(spark, rows)).collect()
    finally:
        Tables.write = write
    assert {(r.doc_id, r.start_word, r.end_word, r.kept_doc_id) for r in out} == {(20, 100, 155, 7)}
    # A next word that two documents share by chance begins a place of its own.
    assert 0 < max(n for name, n in seen if name == "ranked") < 2 * len(rows)


def test_parts_without_a_seed_are_left_to_their_own():
    """Two long equal runs with unlike words between them: where only one has a seed, the other is no match."""
    rng = random.Random(17)
    for k in range(20):
        one, two, other = ([rng.getrandbits(63) for _ in range(n)] for n in (60, 70, 200))
        between = [[x for i in range(12) for x in (*other[6 * i : 6 * i + 5], rng.getrandbits(63), rng.getrandbits(63))] for _ in range(2)]
        p, q = (Words(np.array(one + b + two, np.uint64)) for b in between)
        full, last = [[0, 60], [len(p.words) - 70, len(p.words)]], len(p.words) - 30
        ends = lambda found: [m[:2] for m in found]
        assert [a[0] <= b[0] and b[1] <= a[1] for a, b in zip(ends(matches(p, q, [(20, 20)], 50, 80)), full)] == [True, True]
        for seed, want in ((20, full[0]), (last, full[1])):
            (got,) = ends(matches(p, q, [(seed, seed)], 50, 80, seeded=True))
            assert got[0] <= want[0] and want[1] <= got[1] and got in ends(matches(p, q, [(seed, seed)], 50, 80))


def test_texts_in_a_row_have_the_keys_of_each(spark):
    rng = random.Random(18)
    texts = [" ".join(rng.choices(["a", "b"], [30, 1], k=rng.randint(40, 300)) if i % 2 else words(rng, rng.randint(40, 300))) for i in range(60)]
    got = {(r.doc_id, r.at, r.print) for r in fingerprints(frame(spark, list(enumerate(texts))).coalesce(1), 50, 25).where("until = 0").collect()}
    want = set()
    for i, t in enumerate(texts):
        w = WordHashes().of(t.encode().split())
        place, before, key = Bands(25).keys(w)
        want |= {(i, 2 * a + b, k) for a, b, k in zip(place.tolist(), before.tolist(), key.tolist()) if len(w) >= 50}
    assert got == want


def test_passages_edges(spark):
    long = " ".join(words(random.Random(4), 40_000))
    rows = [(1, None), (2, ""), (None, long), (3, long), (4, long + " tail"), (4, long + " tail"), (5, "a " * 500), (6, "a " * 500)]
    out = repeated_passages(frame(spark, rows)).collect()
    assert (4, 3) in {(r.doc_id, r.kept_doc_id) for r in out} and not {1, 2, None} & {r.doc_id for r in out}
    assert repeated_passages(frame(spark, [])).collect() == []


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, hash string, id int")


QUESTION = "Anna walked 12 km to the market and bought 3 apples for every friend she met . When Anna came home she counted 3 apples less than Peter had , who walked 12 km too ."


def test_leaks_and_new_parameters(spark):
    rng = random.Random(5)
    fill = lambda: " ".join(words(rng, 60))
    other = QUESTION.replace("Anna", "Maria").replace("12", "57").replace("apples", "apples").replace("Peter", "Oskar")
    mixed = QUESTION.replace("12", "57", 1).replace("Anna", "Maria", 1)
    rows = [(1, fill() + " " + QUESTION + " " + fill()), (2, fill() + " " + other + " " + fill()), (3, fill()), (4, fill() + " " + " ".join(QUESTION.split()[:9])), (5, "intro " + mixed), (6, QUESTION.lower() + " " + QUESTION)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate(frame(spark, rows), benchmark(spark, [(7, QUESTION), (8, fill()), (9, None), (10, "")])).collect()}
    assert {k for k in got if k[0] != 6} == {(1, 7), (2, 7)} and (6, 7) in got
    assert not got[1, 7].changed_slots and got[2, 7].changed_slots and got[1, 7].matched >= got[1, 7].n_windows - 2


def test_leaks_like_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    out = {(r.doc_id, r.item_id) for r in decontaminate(docs, items).collect()}
    want = set()
    texts = [(d.doc_id, " " + " ".join(d.text.split()) + " ") for d in docs.collect()]
    for b in items.collect():
        inner = " ".join(b.text.split()[1:-1])
        want |= {(i, b.item_id) for i, t in texts if f" {inner} " in t}
    assert want and want <= out


def plain_canon(text):
    """(word, kind, whether it opens a sentence like a name) of every word with a letter or digit."""
    out, start, before = [], True, None
    for raw in (text or "").split():
        core = raw.strip(OUTER)
        if NUMERIC.fullmatch(core):
            kind = "number"
        elif core.lower() in UNITS:
            kind = "unit"
        else:
            kind = "name" if core[:1].isupper() and core[1:].islower() else ""
        opens = kind == "name" and start
        if kind == "unit" and before != "number":
            kind = ""
        before, start = kind, raw.rstrip("\"')]”’»")[-1:] in ".!?:"
        if core:
            out.append((core.lower(), "" if opens else kind, opens))
    return out


def plain_windows(words, n, item):
    """(at, form, slots, named) of all windows of n words in both readings; of an item without a good one, the words."""
    out = []
    for named in (False, True):
        for at in range(len(words) - n + 1):
            win = [(w, "name" if named and o else k) for w, k, o in words[at : at + n]]
            if (not named or any(o for *_, o in words[at : at + n])) and 2 * sum(not k for _, k in win) >= n:
                out.append((at, tuple((k or "=" + w) for w, k in win), tuple(w for w, k in win if k), named))
    if item and out:
        return out
    exact = [(at, ("exact", *(w for w, *_ in words[at : at + n])), (), False) for at in range(len(words) - n + 1)]
    return exact if item else out + exact


def plain_leaks(docs, items, share=0.5):
    found = set()
    for j, b in items:
        item = plain_canon(b)
        n = min(8, len(item))
        windows = plain_windows(item, n, True) if item else []
        places = {w[0] for w in windows}
        for i, t in docs:
            lines = {}
            for at, form, slots, named in plain_windows(plain_canon(t), n, False) if windows else []:
                for at2, form2, slots2, named2 in windows:
                    if form == form2:
                        for line in (True,) if named or named2 else (False, True):
                            lines.setdefault((at - at2, line), []).append((at2, set(zip(slots2, slots))))
            held = set()
            for got in lines.values():
                pairs = set().union(*(p for _, p in got))
                if len(pairs) == len({a for a, _ in pairs}):
                    held |= {at for at, _ in got}
            if places and len(held) >= share * len(places):
                found.add((i, j))
    return found


def test_leaks_are_those_of_brute_force_and_no_others(spark):
    """Exact, re-parameterised, inconsistent and partial copies of items with few and many literals, numbers alone too."""
    rng = random.Random(8)
    names, units = ["Anna", "Maria", "Peter", "Oskar", "Paris", "Rome"], ["km", "kg", "miles", "euros"]

    def question(n):
        out = []
        for _ in range(n):
            kind = rng.random()
            out += [rng.choice(names)] if kind < 0.2 else [str(rng.randint(1, 99)), *([rng.choice(units)] if rng.random() < 0.5 else [])] if kind < 0.4 else [rng.choice("if then walks to buys some gives had more how many".split()) + rng.choice(["", "", ".", "?"])]
        return " ".join(out)

    def other(text, one_way):
        known = {}
        swap = lambda w: rng.choice(names) if w in names else str(rng.randint(100, 999)) if w.isdigit() else rng.choice(units) if w in units else w
        return " ".join((known.setdefault(w, swap(w)) if one_way else swap(w)) for w in text.split())

    items = [(j, question(rng.choice([3, 6, 9, 14, 25]))) for j in range(25)]
    items += [(90, "In 1990 Paris 12 km 1991 Rome 14 km 1992 Anna 16 km 1993"), (91, "12 7 19 4 33 8 15 2 60 1"), (92, None), (93, "... !"), (94, items[3][1] + " and more"), (95, items[3][1])]
    docs = []
    for k in range(160):
        text = rng.choice([t for _, t in items if t])
        form = rng.randrange(5)
        text = [text, other(text, True), other(text, False), " ".join(text.split()[: max(1, len(text.split()) * rng.randint(3, 9) // 10)]), question(30)][form]
        docs.append((k, f"{question(rng.randint(0, 30))}{rng.choice(['', '.'])} {text} {question(rng.randint(0, 30))}"))
    got = {(r.doc_id, r.item_id) for r in decontaminate(frame(spark, docs), benchmark(spark, items)).collect()}
    want = plain_leaks(docs, items)
    assert got == want and len(want) > 60


def test_leaks_in_a_very_long_text(spark):
    rng = random.Random(9)
    text = words(rng, 120_000)
    text[60_000:60_000] = QUESTION.split()
    got = decontaminate(frame(spark, [(1, " ".join(text))]), benchmark(spark, [(1, QUESTION), (2, " ".join(words(rng, 20)))])).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_leaks_edges(spark):
    items = benchmark(spark, [(1, "only five words are here"), (1, "only five words are here"), (None, QUESTION)])
    rows = [(1, None), (2, "only five words are here"), (None, QUESTION), (3, "... !!! ???")]
    assert {(r.doc_id, r.item_id) for r in decontaminate(frame(spark, rows), items).collect()} == {(2, 1)}
    assert decontaminate(frame(spark, []), items).collect() == [] and decontaminate(frame(spark, rows), benchmark(spark, [])).collect() == []


def test_leaks_of_names_at_sentence_starts(spark):
    item = "Anna has 12 apples. Anna gives 3 to Ben. How many apples does Anna have left?"
    other = item.replace("Anna", "Maria").replace("12", "57").replace("3", "8").replace("Ben", "Oskar")
    rows = [(1, other), (2, "Some words before: " + other), (3, item), (4, "we say Bright kettles hum softly under old wooden shelves today")]
    items = benchmark(spark, [(1, item), (2, "Bright kettles hum softly under old wooden shelves")])
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontaminate(frame(spark, rows), items).collect()}
    assert got == {(1, 1): True, (2, 1): True, (3, 1): False, (4, 2): False}


def test_leaks_of_short_items_and_of_items_of_numbers(spark):
    rng = random.Random(7)
    fill = lambda: " ".join(words(rng, 40))
    short, numbers = "What is the capital of France?", "12 7 19 4 33 8 15 2 60 1"
    rows = [(1, f"{fill()}. {short} {fill()}"), (2, f"{fill()} {numbers} {fill()}"), (3, f"{fill()} 13 7 19 4 33 8 15 2 61 1 {fill()}"), (4, fill())]
    got = {(r.doc_id, r.item_id) for r in decontaminate(frame(spark, rows), benchmark(spark, [(1, short), (2, numbers)])).collect()}
    assert got == {(1, 1), (2, 2)}
