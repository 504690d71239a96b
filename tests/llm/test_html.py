import random
from functools import lru_cache

import numpy as np

from sparkforge.llm.op02_html_wrappers import ARTICLE, TEMPLATE, Part, align, decide, dump, extract, fold, lattice, load, main_text, merge, parse, preorder, regular_expression, rule, shape


def alone(page):
    return extract(page, None)[0]


def by_host(pages):
    """Texts of the pages of one host, with whether its expression found each."""
    w = shape(parse(pages[0]))
    for p in pages[1:]:
        merge(w, shape(parse(p)))
    w = load(rule(w))
    return [extract(p, w) for p in pages]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy &amp; save</div>
{main}<aside class="sidebar">Other posts</aside><footer>&copy; x</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, host string, paths int, of string"


def test_article_only():
    text = alone(PAGE.format(main='<article><h1>Head  line</h1><p>One <b>bold</b>&nbsp;&lt;x&gt;<br>two.<p>Three<ul><li>a</li><li>b</li></ul><div class="comments"><p>First!</p></div><form><input name=q></form></article>'))
    assert text == "Head line\n\nOne bold <x> two.\n\nThree\n\na\n\nb"


def test_without_article_element(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.format(main=f'<div id="wrap"><div class="post-body"><h2>Title {i}</h2>' + "".join(f"<p>Story {i} part {k} is long enough to weigh.</p>" for k in range(3 + i % 3)) + '</div><div class="links"><a href="/x">More like this</a></div></div>'), "h", 1, "o") for i in range(9)]
    out = {r.page_id: r.text for r in main_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    for i in range(9):
        assert out[i] == "\n\n".join([f"Title {i}", *(f"Story {i} part {k} is long enough to weigh." for k in range(3 + i % 3))])


def test_broken_markup():
    assert alone("<article><p>a<p>b &am") == "a\n\nb &am"
    assert alone("<article><p>open <a href='x") == "open"
    assert alone("plain text &eacute; only") == "plain text é only"
    assert alone("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert alone("<article><p>x<!-- no --> y<script>bad()</script> z</p><style>.a{}") == "x y z"
    assert alone("") == "" and alone("   ") == ""


def test_header_inside_article_stays_and_page_header_goes():
    assert alone("<body><header><p>Site</p></header><article><header><h1>T</h1></header><p>b</p></article></body>") == "T\n\nb"


def test_deep_pages():
    for depth in (20, 120, 3000):
        assert alone("<div>" * depth + "<p>x</p><nav>MENU</nav><p>after</p>" + "</div>" * depth) == "x\n\nafter"
        assert alone("<div>" * depth + "<article><p>x</p><nav>MENU</nav></article>" + "</div>" * depth + "y") == "x"
    pages = ["<div>" * 2000 + f"<p>story {i} of a deep page</p><p>same</p>" + "</div>" * 2000 for i in range(4)]
    assert by_host(pages)[1] == ("story 1 of a deep page\n\nsame", True)
    assert alone("<div>" * 200_000 + "</p>" * 200_000 + "deep") == "deep"


def part(label):
    return Part(label, label, False, c=1)


def test_wrappers_fold_and_align():
    groups = fold([part(x) for x in ("dt", "dd", "dt", "dd", "p", "p", "h2")])
    assert [(g.repeated, [w.label for w in g.parts]) for g in groups] == [(True, ["dt", "dd"]), (True, ["p"]), (False, ["h2"])]
    a, b = fold([part("h1"), part("p")]), fold([part("h1"), part("ul"), part("p"), part("p")])
    assert align(a, b) == [(0, 0), (None, 1), (1, 2)]
    a, b = (shape(parse(f"<body><article><h1>{t}</h1><p>x</p></article></body>")) for t in ("one", "two"))
    w = merge(a, b)
    assert regular_expression(w) == "<>(<body>(<article>(<h1>#TEXT</h1>)(<p></p>)</article>)</body>)</>"
    assert dump(load(dump(w))) == dump(w)
    assert decide(w) and [x.label for x in preorder(w) if x.mark == ARTICLE] == ["article"]


MENUS = "<div><ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Home", "News", "Sport")) + "</ul></div>"


def test_pages_without_telling_names():
    """Menu, notice, story, and foot are plain elements: only the host's pages together say which is which."""
    rng = random.Random(1)
    stories = [[" ".join(rng.choice(("sun", "sea", "rain", "wind", "hill")) for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 5))] for _ in range(8)]
    pages = [f"<html><body>{MENUS}<div>We use small files to run this site well.</div><div><h1>Story {i}</h1>" + "".join(f"<p>{x}</p>" for x in s) + "</div><div>Printed by the same people every day</div></body></html>" for i, s in enumerate(stories)]
    found = by_host(pages)
    assert found == [("\n\n".join([f"Story {i}", *s]), True) for i, s in enumerate(stories)]
    assert sum("small files" in alone(page) and alone(page) != got for page, (got, _) in zip(pages, found)) >= 3


def test_constant_parts_inside_the_article_are_template():
    pages = [f"<article><h1>T{i}</h1><h2>Introduction</h2><p>Story {i}.</p><div>Tell your friends about us.</div><ul>{MENUS}</ul></article>" for i in range(5)]
    assert by_host(pages)[2] == ("T2\n\nIntroduction\n\nStory 2.", True)
    # Two pages, or copies of one page, say nothing about what is constant.
    assert "Tell your friends" in by_host(pages[:2])[0][0]
    w = shape(parse(pages[0]))
    merge(w, shape(parse(pages[0])))
    assert rule(w) is None and "Story 0." in alone(pages[0])


def test_alignment_prefers_like_content():
    """A page without the menu: its story meets the story, not the menu's place."""
    pages = [f"<body>{MENUS if i else ''}<div><p>Story {i} with some words</p><p>and more {i}</p></div><div>Foot of all the pages</div></body>" for i in (1, 2, 3, 0)]
    assert by_host(pages)[3] == ("Story 0 with some words\n\nand more 0", True)


def test_lattice_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in ((0, 3), (1, 1), (7, 9), (30, 25)):
        weight = np.maximum(0, rng.integers(-4, 6, (5, 5))).astype(np.int32)
        x, y = rng.integers(0, 5, n).tolist(), rng.integers(0, 5, m).tolist()

        @lru_cache(None)
        def best(i, j):
            return 0 if i == n or j == m else max(best(i + 1, j), best(i, j + 1), best(i + 1, j + 1) + int(weight[x[i], y[j]]))

        got = lattice(x, y, weight)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
        assert sum(int(weight[x[i], y[j]]) for i, j in got) == best(0, 0)
    # Beyond what fits at once, halves are solved apart: the score stays that of the whole.
    x, y = rng.integers(0, 40, 4000).tolist(), rng.integers(0, 40, 3000).tolist()
    got = lattice(x, y, np.eye(40, dtype=np.int32))
    row = np.zeros(3001, np.int64)
    for a in x:
        new = row.copy()
        new[1:] = np.maximum(new[1:], row[:-1] + (np.asarray(y) == a))
        row = np.maximum.accumulate(new)
    assert len(got) == row[-1] and all(x[i] == y[j] for i, j in got)


def test_by_host(spark, sf):
    """Pages of hosts with several pages are cut by their host's expression; the same as in one process."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = main_text(pages).collect()
    many = {r.host for r in pages.selectExpr("parse_url(url, 'HOST') AS host").groupBy("host").count().where("count > 1").collect()}
    assert len(out) == pages.count() and sum(r.by_host for r in out) * 2 > len(out) and many


def test_edges(spark):
    rows = [(1, None, None, "h", 1, "o"), (2, "http://a/", "", "h", 1, "o"), (None, "http://a/", "<p>x</p>", "h", 1, "o"), (3, "::bad", "<p>y</p>", "h", 1, "o"), (3, "::bad", "<p>y</p>", "h", 1, "o")]
    out = sorted(((r.page_id or 0), r.url or "", r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(0, "http://a/", "x", 1), (1, "", "", 0), (2, "http://a/", "", 0), (3, "::bad", "y", 1), (3, "::bad", "y", 1)]
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_sequences_are_aligned_too():
    a, b = fold([part(f"x{i}") for i in range(700)]), fold([part(f"x{i}") for i in range(0, 1400, 2)])
    both = align(a, b)
    assert len(both) == 1050 and sum(i is not None and j is not None for i, j in both) == 350


def test_texts_with_one_beginning_are_variable():
    lead = "The same long lead of every page of this host. " * 6
    w = merge(*(shape(parse(f"<body><div class='story'>{lead} Story {i} goes on in its own way.</div><div class='box'>Box {i}</div></body>")) for i in (1, 2)))
    assert decide(w) and [x.label for x in preorder(w) if x.mark == ARTICLE] == ["div.story"]
    assert not any(x.mark == TEMPLATE for x in preorder(w))
