"""Main text of pages through wrappers inferred for each host.

A page becomes a tree of its block elements. Its wrapper is a union-free regular expression over them: equal neighbours,
or equal runs of up to four, fold into a repeated group; where two pages of a host are aligned, what only one has becomes
optional; texts become slots, constant while all pages agree and variable after. Wrappers add up: each task folds its
pages by host, and the partial wrappers of a host are aligned in two further rounds, so every page takes part and no
task needs all pages of a host.

The host's expression says what is what. The article is where the variable text without links is: article or main
elements if they hold half of it, or else the smallest part that holds four fifths. Inside, parts that are constant on
half of the pages or more (three at least, headings apart), and repeated groups that are nearly all links, are template.
Each page is then matched against the expression of its host: the blocks that meet the article's parts are the text, less
those that meet template. Marked menus, adverts, comments and the like never are text. A page whose host has no other
page, no name or no variable text, or that matches no article, is cut by its own wrapper and its marks alone.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SHORT = re.compile(r"[a-zA-Z]{1,3}\d{1,2}")

# Elements that form blocks, elements whose content is raw text, elements without an end.
BLOCKS = frozenset("address article aside audio blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video".split())
RAW = frozenset("script style textarea title noembed noframes xmp iframe noscript template".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements, roles and words of class or id that mark what is not the article.
OUT_TAGS = frozenset("head script style noscript template iframe object svg canvas audio video nav footer aside form button select option textarea dialog menu search title noembed noframes".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar".split())
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion promotions banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations widget widgets toolbar masthead topbar skip login paywall".split())
ARTICLE_OUT = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())
NEGATING = frozenset("with has no without".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "body": ("head", "title")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}
CENTRES = ("article", "main")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that are alike whatever they hold; other elements without a class are alike if they hold the same elements.
ITEMS = frozenset(["p", "li", "tr", "td", "th", "dt", "dd", "option", "hr", *HEADINGS])
ARTICLE, TEMPLATE = 1, 2


class Node:
    """An element of a page; items are nodes or (text, whether in a link), mark what the host's expression says of it."""

    __slots__ = ("name", "tag", "label", "out", "items", "mark")

    def __init__(self, name: str, tag: str, label: str, out: bool):
        self.name, self.tag, self.label, self.out, self.items, self.mark = name, tag, label, out, [], 0


def words_of(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


@lru_cache(4096)
def kind(tag: str, raw: str) -> tuple[str, str, str, bool]:
    """Name, tag, label and whether it is out, of an element with these attributes."""
    attrs = {}
    if raw.strip(" /\n\t\r"):
        for name, a, b, c in ATTRIBUTE.findall(raw):
            attrs.setdefault(name.lower(), a or b or c)
    marks = [words_of(x) for x in (attrs.get("class", "") + " " + attrs.get("id", "")).split()]
    short = [x.lower() for x in attrs.get("class", "").split() if SHORT.fullmatch(x)]
    label = name = tag
    if tag not in ("html", "body"):
        # Numbers name single pages and items, save in short codes of classes.
        label += "".join(f".{m}" for m in sorted([*("-".join(m) for m in marks if m), *short]))
    role = attrs.get("role", "").lower()
    out = tag in OUT_TAGS or role in OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
    if tag not in ("html", "body", "main"):
        bad = ARTICLE_OUT if tag == "article" or attrs.get("itemprop") == "articleBody" else OUT_WORDS | {"header"}
        out = out or any(any(w in bad for w in m) and not (m[0] in NEGATING) for m in marks)
    if tag == "div" and (role == "main" or attrs.get("itemprop") == "articleBody"):
        tag = "main"
    return name, tag, label, out


def parse(page: str) -> Node:
    """Tree of blocks. Elements open at the end are closed there."""
    root = Node("", "", "", False)
    stack, at, link, text = [root], 0, 0, []
    # How many elements of a name are open, so that no end tag looks through all of a deep page for nothing.
    held: Counter = Counter()
    end = len(page)

    def flush():
        if text:
            s = html.unescape("".join(text))
            text.clear()
            if s:
                stack[-1].items.append((s, link > 0))

    def close_to(i: int):
        held.subtract(x.name for x in stack[i:])
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a" and link:
                # An inline link ends its piece of text, so that link text can be told from other text.
                flush()
                stack[-1].items.append(("", None))
                link -= 1
            elif tag in BLOCKS:
                if held[tag] or tag != "p":
                    flush()
                for i in range(len(stack) - 1, 0, -1) if held[tag] else ():
                    if stack[i].name == tag:
                        close_to(i)
                        link = 0
                        break
            continue
        if tag in RAW and not m[3].endswith("/"):
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            body_end, at = (stop.start(), stop.end()) if stop else (end, end)
            if tag == "textarea" or tag not in ("script", "style"):
                flush()
            continue
        if tag == "a":
            flush()
            stack[-1].items.append(("", None))
            link += 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1) if held["p"] else ():
                if stack[i].tag in ("div", "article", "section", "td", "body", "main", "table", "blockquote"):
                    break
                if stack[i].tag == "p":
                    close_to(i)
                    break
            closes = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if any(held[x] for x in closes) else ():
                if stack[i].tag in SCOPES.get(tag, ("table",)):
                    break
                if stack[i].tag in closes:
                    close_to(i)
                    break
            node = Node(*(kind if len(m[3]) < 200 else kind.__wrapped__)(tag, m[3]))
            stack[-1].items.append(node)
            if tag not in EMPTY:
                stack.append(node)
                held[tag] += 1
    flush()
    return root


class Part:
    """A node of a wrapper.

    n pages, c characters outside links, k characters in links, slot (hash of the constant text, "" for none, null once
    variable), inner (names of the elements in it), groups, nodes (elements of the one page that it stands for), mark.
    """

    __slots__ = ("label", "tag", "out", "n", "c", "k", "slot", "inner", "groups", "nodes", "mark")

    def __init__(self, label, tag, out, n=1, c=0, k=0, slot="", mark=0, inner=frozenset()):
        self.label, self.tag, self.out, self.n, self.c, self.k, self.slot, self.mark, self.inner = label, tag, out, n, c, k, slot, mark, inner
        self.groups, self.nodes = [], []

    def alike(self):
        return self.label if self.tag in ITEMS or "." in self.label else (self.label, self.inner)


class Group:
    """Parts that follow one another, perhaps repeated or optional."""

    __slots__ = ("repeated", "optional", "parts")

    def __init__(self, parts: list[Part], repeated: bool = False, optional: bool = False):
        self.parts, self.repeated, self.optional = parts, repeated, optional


def preorder(root: Part) -> list[Part]:
    out, stack = [], [root]
    while stack:
        out.append(stack.pop())
        stack += [y for g in reversed(out[-1].groups) for y in reversed(g.parts)]
    return out


def shape(root: Node) -> Part:
    """Wrapper of one page."""
    order, stack = [], [(root, None)]
    kids: dict[int, list[Part]] = {}
    while stack:
        node, parent = stack.pop()
        w = Part(node.label, node.tag, node.out)
        w.nodes.append(node)
        own = []
        for item in node.items:
            if isinstance(item, Node):
                continue
            words = item[0].split()
            if words:
                size = sum(map(len, words))
                if item[1]:
                    w.k += size
                else:
                    w.c += size
                own += words
        if own:
            w.slot = xxhash.xxh3_128_hexdigest(" ".join(own).encode("utf-8", "surrogatepass"))
        inside = [x for x in node.items if isinstance(x, Node)]
        if inside:
            w.inner = frozenset(x.name for x in inside)
            stack += [(x, w) for x in reversed(inside)]
        order.append(w)
        if parent is not None:
            kids.setdefault(id(parent), []).append(w)
    for w in reversed(order):
        # Children come after their parents in page order, so they are folded first.
        if id(w) in kids:
            w.groups = fold(kids[id(w)])
    return order[0]


def fold(parts: list[Part]) -> list[Group]:
    """Groups of a sequence: runs of one to four parts that repeat at once become one repeated group."""
    out, i, keys = [], 0, [w.alike() for w in parts]
    while i < len(parts):
        for k in (1, 2, 3, 4):
            run = keys[i : i + k]
            end = i + k
            while len(run) == k and keys[end : end + k] == run:
                end += k
            if end > i + k:
                for j in range(i + k, end):
                    merge(parts[i + (j - i) % k], parts[j], False)
                out.append(Group(parts[i : i + k], True))
                i = end
                break
        else:
            out.append(Group([parts[i]]))
            i += 1
    return out


def lattice(x: list[int], y: list[int], weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), ascending in both, of the greatest sum of weight[x[i], y[j]]; a weight of 0 makes no pair.

    Rows of scores are vectors. Where all of them would not fit, the split of y at the middle of x is found from the
    scores of both halves first, so memory stays in proportion to one row.
    """
    out, stack = [], [(0, len(x), 0, len(y))]
    xs, ys = np.asarray(x, np.int64), np.asarray(y, np.int64)

    def rows(a, b, c, d, back):
        """Scores of x[a:b] against every suffix (back) or prefix of y[c:d], row by row from the empty one."""
        row = np.zeros(d - c + 1, np.int32)
        yield row
        for i in range(b - 1, a - 1, -1) if back else range(a, b):
            w = weight[xs[i], ys[c:d]]
            new = row.copy()
            if back:
                new[:-1] = np.maximum(new[:-1], np.where(w > 0, row[1:] + w, 0))
                row = np.maximum.accumulate(new[::-1])[::-1]
            else:
                new[1:] = np.maximum(new[1:], np.where(w > 0, row[:-1] + w, 0))
                row = np.maximum.accumulate(new)
            yield row

    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > 1 << 22 and b - a > 1:
            mid = (a + b) // 2
            *_, up = rows(a, mid, c, d, False)
            *_, down = rows(mid, b, c, d, True)
            cut = c + int(np.argmax(up + down))
            stack += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        best = list(rows(a, b, c, d, True))[::-1]
        i, j = a, c
        while i < b and j < d:
            w = weight[xs[i], ys[j]]
            here, below = best[i - a], best[i - a + 1]
            if w > 0 and here[j - c] == below[j - c + 1] + w:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif below[j - c] >= here[j - c + 1]:
                i += 1
            else:
                j += 1
    return sorted(out)


def align(a: list[Group], b: list[Group]) -> list[tuple[int | None, int | None]]:
    """Places of two sequences side by side: groups of equal labels, those that hold like elements before others."""
    x, y = [tuple(w.alike() for w in g.parts) for g in a], [tuple(w.alike() for w in g.parts) for g in b]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(head)]
    i, j, n, m = head, head, len(x) - tail, len(y) - tail
    met = []
    if i < n and j < m:
        forms: dict = {}
        xs, ys = ([forms.setdefault((tuple(w.label for w in g.parts), tuple(w.inner for w in g.parts)), len(forms)) for g in z] for z in (a[i:n], b[j:m]))
        weight = np.zeros((len(forms), len(forms)), np.int32)
        for (p, p_in), u in forms.items():
            for (q, q_in), v in forms.items():
                if p == q:
                    weight[u, v] = 4 + sum(4 * len(s & t) // len(s | t) if s or t else 4 for s, t in zip(p_in, q_in)) // len(p)
        met = lattice(xs, ys, weight)
    for p, q in [*met, (n - head, m - head)]:
        out += [(k, None) for k in range(i, head + p)] + [(None, k) for k in range(j, head + q)]
        i, j = head + p, head + q
        if i < n and j < m:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def merge(a: Part, b: Part, pages: bool = True) -> Part:
    """b joins a. pages: they are of different pages, else of one."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        p.n = p.n + q.n if pages else max(p.n, q.n)
        p.c, p.k, p.inner = p.c + q.c, p.k + q.k, p.inner | q.inner
        p.slot = p.slot if p.slot == q.slot else None
        p.nodes += q.nodes
        if not p.groups and not q.groups:
            continue
        groups = []
        for i, j in align(p.groups, q.groups):
            if i is None or j is None:
                groups.append(p.groups[i] if j is None else q.groups[j])
                groups[-1].optional = True
            else:
                g, h = p.groups[i], q.groups[j]
                g.repeated, g.optional = g.repeated or h.repeated, g.optional or h.optional
                stack += zip(g.parts, h.parts)
                groups.append(g)
        p.groups = groups
    return a


def dump(root: Part) -> str:
    """The wrapper as JSON, in page order; flat, whatever its depth."""
    return json.dumps([[w.label, w.tag, int(w.out), w.n, w.c, w.k, w.slot, w.mark, sorted(w.inner), [[int(g.repeated), int(g.optional), len(g.parts)] for g in w.groups]] for w in preorder(root)])


def load(text: str) -> Part:
    done: list[Part] = []
    for label, tag, out, n, c, k, slot, mark, inner, groups in reversed(json.loads(text)):
        w = Part(label, tag, bool(out), n, c, k, slot, mark, frozenset(inner))
        w.groups = [Group([done.pop() for _ in range(size)], bool(repeated), bool(optional)) for repeated, optional, size in groups]
        done.append(w)
    return done[0]


def regular_expression(root: Part) -> str:
    """The wrapper as text: ( )+ repeated, ( )? optional, #TEXT a slot."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(f"<{x.label}>" + ("#TEXT" if x.slot is None else ""))
        stack.append(f"</{x.tag}>")
        for g in reversed(x.groups):
            stack += [")" + ("+" if g.repeated else "") + ("?" if g.optional else ""), *reversed(g.parts), "("]
    return "".join(out)


def decide(root: Part) -> bool:
    """Marks the parts that hold the article and, in them, those of the template. False if several pages show no variable text."""
    order, pages = preorder(root), root.n
    mass, chars, links, fixed = {}, {}, {}, {}
    for w in reversed(order):
        kids = [y for g in w.groups for y in g.parts]
        # Characters of variable text that aren't in links, outside what is out.
        varies = (w.slot is None or pages == 1) and not w.out and w.tag != "header"
        mass[id(w)] = 0 if w.out or w.tag == "header" else (max(0, w.c - w.k) if varies else 0) + sum(mass[id(y)] for y in kids)
        chars[id(w)], links[id(w)] = w.c + sum(chars[id(y)] for y in kids), w.k + sum(links[id(y)] for y in kids)
        fixed[id(w)] = w.slot is not None and all(fixed[id(y)] for y in kids)
    whole = mass[id(root)]
    if pages > 1 and not whole:
        return False

    def outermost(top: Part, tags: tuple[str, ...]) -> list[Part]:
        found, stack = [], [y for g in reversed(top.groups) for y in reversed(g.parts)]
        while stack:
            x = stack.pop()
            if x.out:
                continue
            if x.tag in tags:
                found.append(x)
            else:
                stack += [y for g in reversed(x.groups) for y in reversed(g.parts)]
        return found

    centres = []
    for x in outermost(root, CENTRES):
        # An article inside main says more than main, if it holds most of its text.
        inner = outermost(x, ("article",)) if x.tag == "main" else []
        centres += inner if inner and 2 * sum(mass[id(y)] for y in inner) >= mass[id(x)] else [x]
    if pages > 1 and 2 * sum(mass[id(x)] for x in centres) < whole:
        centres = []
    if not centres:
        at = root
        while whole:
            down = [y for g in at.groups for y in g.parts if not y.out and y.tag not in ITEMS and y.tag not in ("blockquote", "pre")]
            best = max(down, key=lambda y: mass[id(y)], default=None)
            if best is None or 10 * mass[id(best)] < 8 * whole:
                break
            at = best
        centres = [at]
    for x in centres:
        x.mark = ARTICLE
        stack = [(y, g.repeated) for g in x.groups for y in g.parts] if pages > 2 else []
        while stack:
            y, repeated = stack.pop()
            often = y.n > 2 and 2 * y.n >= pages
            many = repeated or any(g.repeated for g in y.groups)
            if often and (fixed[id(y)] and chars[id(y)] + links[id(y)] and y.tag not in HEADINGS or many and links[id(y)] > 9 * chars[id(y)]):
                y.mark = TEMPLATE
            else:
                stack += [(z, g.repeated) for g in y.groups for z in g.parts]
    return True


def rule(root: Part) -> str | None:
    """What matching needs of a host's expression: marked parts, those above them and what stands beside these."""
    if not decide(root):
        return None
    order, wanted = preorder(root), set()
    for w in reversed(order):
        if w.mark or any(id(y) in wanted for g in w.groups for y in g.parts):
            wanted.add(id(w))
    for w in order:
        if id(w) not in wanted or not any(id(y) in wanted for g in w.groups for y in g.parts):
            w.groups = []
        w.slot = ""
    return dump(root)


def match(wrapper: Part, page: Part) -> None:
    """Marks the elements of a page that meet marked parts of the wrapper."""
    stack = [(wrapper, page)]
    while stack:
        w, p = stack.pop()
        for node in p.nodes if w.mark else ():
            node.mark = w.mark
        if w.groups and w.mark != TEMPLATE:
            for i, j in align(w.groups, p.groups):
                if i is not None and j is not None:
                    stack += zip(w.groups[i].parts, p.groups[j].parts)


def blocks_of(roots: list[tuple[Node, bool]]) -> str:
    """Text of the blocks under the roots, in page order; under a root that is no article page headers are left out."""
    out = []
    for root, article in roots:
        stack, text = [iter(root.items)], []

        def flush():
            if s := " ".join("".join(text).split()):
                out.append(s)
            text.clear()

        while stack:
            item = next(stack[-1], None)
            if item is None:
                stack.pop()
                flush()
            elif isinstance(item, tuple):
                text.append(item[0])
            else:
                flush()
                if not item.out and item.mark != TEMPLATE and (article or item.tag != "header"):
                    stack.append(iter(item.items))
        flush()
    return "\n\n".join(out)


def extract(page: str, wrapper: Part | None) -> tuple[str, bool]:
    """The article's text by the host's expression, else by the page's own; and whether the host's decided."""
    root = parse(page)

    def text() -> str:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.mark == ARTICLE:
                found.append((node, node.tag in CENTRES))
            elif not node.out:
                stack += [x for x in reversed(node.items) if isinstance(x, Node)]
        return blocks_of(found)

    own = shape(root)
    if wrapper:
        match(wrapper, own)
        if got := text():
            return got, True
    for w in preorder(own):
        for node in w.nodes:
            node.mark = 0
    decide(own)
    for w in preorder(own):
        for node in w.nodes:
            node.mark = w.mark
    return text(), False


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


#: Hosts whose wrappers a task holds before it hands them on.
HELD = 2000
#: Rules of hosts that a task remembers in the form that matching needs.
RULES = 500


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), pages; of pages whose url names a host."""

    def fold_pages(batches):
        held: dict[str, Part] = {}

        def out():
            c = list(zip(*((h, dump(w), w.n) for h, w in held.items())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.int64())], names=["host", "wrapper", "pages"])

        for b in batches:
            for url, page in zip(b.column(0), b.column(1)):
                if not (host := host_of(url.as_py())):
                    continue
                w = shape(parse(page.as_py() or ""))
                for x in preorder(w):
                    x.nodes = []
                if host in held:
                    merge(held[host], w)
                else:
                    held[host] = w
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    def join(table: pa.Table) -> pa.Table:
        first, *more = sorted(table.column("wrapper").to_pylist())
        w = load(first)
        for x in more:
            merge(w, load(x))
        return pa.table({"host": table.column("host")[:1], "wrapper": [dump(w)], "pages": pa.array([w.n], pa.int64())})

    schema = "host string, wrapper string, pages long"
    parts = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(fold_pages, schema).withColumn("salt", F.spark_partition_id() % 32)
    some = parts.groupBy("host", "salt").applyInArrow(join, schema)
    return some.groupBy("host").applyInArrow(join, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, by_host (whether the host's expression found the text).

    A null or empty html gives an empty text. Pages whose url is null or names no host stand alone. Repeated rows give
    equal rows, an empty table none; other columns are not looked at. Which of several equally good alignments a host's
    expression has may depend on the order of its pages.
    """

    def rules(batches):
        for b in batches:
            got = [(h, r) for h, w in zip(b.column(0), b.column(1)) if (r := rule(load(w.as_py())))]
            yield pa.RecordBatch.from_arrays([pa.array([h.as_py() for h, _ in got], pa.string()), pa.array([r for _, r in got], pa.string())], names=["of", "rule"])

    def cut(batches):
        known: dict[str, Part] = {}
        for b in batches:
            got = []
            for h, r in zip(b.column(2), b.column(3)):
                r = r.as_py()
                if r is not None and r not in known:
                    if len(known) >= RULES:
                        known.clear()
                    known[r] = load(r)
                got.append(extract(h.as_py() or "", known.get(r)))
            texts = [t for t, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([x for _, x in got], pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_host"])

    def hosts(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u.as_py()) for u in b.column(1)], pa.string())], names=["page_id", "url", "html", "host"])

    several = wrappers(pages).where("pages > 1").select("host", "wrapper")
    known = Tables(pages.sparkSession, "html").write(several.mapInArrow(rules, "of string, rule string"), "rules")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.mapInArrow(hosts, "page_id long, url string, html string, host string")
    rows = rows.join(known, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "rule")
    return rows.mapInArrow(cut, "page_id long, url string, text string, n_chars long, by_host boolean")


def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
