"""The SQL dialect as Spark SQL text, by rewriting tokens. Clauses nest as parentheses do; each level is rewritten by itself."""

from __future__ import annotations

import re

from ..functions import registry
from ..operators import windows

TOKEN = re.compile(r"""\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|@@?[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?:BD|bd|[DdLlFfSsYy])?(?!\w)|\d+|\.\d+|[^\W\d]\w*|<=>|->>|->|::|:=|&&|\|\||<>|!=|<=|>=|<<|>>|.""", re.S)
#: Words after which a parenthesis is no call.
NO_CALL = frozenset("in and or not on where having select from join using values over as by when then else case exists any all some union except intersect partition with between like is limit qualify set xor recursive filter within table rollup cube sets".split())
CLAUSES = frozenset("select from where group having qualify window order limit offset fetch union intersect except".split())
BOUNDS = frozenset("and or xor where on having when then else qualify select case as , ;".split()) | CLAUSES


#: Aggregates whose call has the syntax of one but is made of another.
WRAPPERS = frozenset("nanvl transform get array_sort map_from_entries size array_distinct aggregate array_join filter".split())
#: Values of @@variables.
SYSTEM = {"version": "8.0.0", "version_comment": "sparkforge", "autocommit": 1, "sql_mode": "", "max_allowed_packet": 67108864, "time_zone": "UTC", "system_time_zone": "UTC", "character_set_client": "utf8mb4", "character_set_connection": "utf8mb4", "character_set_results": "utf8mb4", "collation_connection": "utf8mb4_bin", "transaction_isolation": "READ-COMMITTED", "lower_case_table_names": 1}


def closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at `at`; those in quotes don't count."""
    depth, quote, i = 0, "", at
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'`\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
        i += 1
    return len(text) - 1


class SqlError(ValueError):
    pass


def tokens(text: str) -> list[str]:
    out = []
    for t in TOKEN.findall(text):
        if t.isspace() or t.startswith(("--", "#")) or (t.startswith("/*") and not t.startswith("/*+")):
            continue
        out.append(t)
    return out


def tree(flat: list[str]) -> list:
    """Nested lists for (), [] and {}: ["(", ..., ")"]."""
    root: list = []
    stack = [root]
    close = {"(": ")", "[": "]", "{": "}"}
    for t in flat:
        if t in close:
            node = [t]
            stack[-1].append(node)
            stack.append(node)
        elif t in (")", "]", "}"):
            if len(stack) == 1 or close[stack[-1][0]] != t:
                raise SqlError(f"unexpected {t}")
            stack.pop().append(t)
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise SqlError("unclosed parenthesis")
    return root


def text_of(nodes) -> str:
    out = []
    for x in nodes:
        out.append(text_of(x) if isinstance(x, list) else x)
    s = " ".join(out)
    return re.sub(r"\s*\.\s*(?=[A-Za-z_`*])", ".", s)


def low(x) -> str:
    return x.lower() if isinstance(x, str) else ""


def split(nodes: list, sep: str = ",") -> list[list]:
    out: list[list] = [[]]
    for x in nodes:
        if x == sep:
            out.append([])
        else:
            out[-1].append(x)
    return out


def find(nodes: list, *words: str, start: int = 0) -> int:
    for i in range(start, len(nodes)):
        if low(nodes[i]) in words:
            return i
    return -1


#: Words behind a column in ORDER BY.
ORDERS = ("asc", "desc", "nulls", "first", "last")


class Rewriter:
    def __init__(self, dialect: str = "neutral", variables: dict | None = None, tables=None):
        self.dialect, self.variables, self.tables = dialect, variables or {}, tables

    def rewrite(self, text: str) -> str:
        return text_of(self.query(tree(tokens(text))))

    def query(self, nodes: list) -> list:
        """A level that may hold a query: set operations first, then blocks, then expressions."""
        nodes = self.hints(nodes)
        for i, x in enumerate(nodes):
            if low(x) in ("intersect", "except", "minus") and i + 1 < len(nodes) and low(nodes[i + 1]) == "all":
                raise SqlError(f"{x} ALL is not supported")
        parts, at = [], 0
        for i, x in enumerate(nodes):
            if low(x) in ("union", "intersect", "except"):
                parts += self.block(nodes[at:i]) + [x]
                at = i + 1
        return parts + self.block(nodes[at:])

    def hints(self, nodes: list) -> list:
        """WITH KEYED BY (k): Spark keeps rows of a key together by itself, so only the words go."""
        out, i = [], 0
        while i < len(nodes):
            if low(nodes[i]) == "keyed" and i + 2 < len(nodes) and low(nodes[i + 1]) == "by" and isinstance(nodes[i + 2], list):
                i += 3
                if low(out[-1]) == "with" and (i >= len(nodes) or low(nodes[i]) == "select"):
                    out.pop()
                continue
            if low(nodes[i]) in ("materialized",) or low(nodes[i]) == "not" and i + 1 < len(nodes) and low(nodes[i + 1]) == "materialized":
                i += 1 + (low(nodes[i]) == "not")
                continue
            out.append(nodes[i])
            i += 1
        return out

    def block(self, nodes: list) -> list:
        nodes = self.helper_columns(nodes)
        q = find(nodes, "qualify")
        if q < 0:
            return self.limits(self.level(nodes))
        start = find(nodes, "select")
        end = next((i for i in range(q + 1, len(nodes)) if low(nodes[i]) in ("order", "limit", "window", "offset", "fetch")), len(nodes))
        first = find(nodes, "from", start=start)
        condition, head, items, body, rest = nodes[q + 1 : end], nodes[:start], nodes[start + 1 : first], nodes[first:q], nodes[end:]
        if rest and low(rest[0]) == "window":
            stop = next((i for i in range(1, len(rest)) if low(rest[i]) in ("order", "limit", "offset", "fetch")), len(rest))
            body, rest = body + rest[:stop], rest[stop:]
        if any(low(x) == "over" for x in condition):
            inner = ["select", *items, ",", ["(", *condition, ")"], "as", "__qualify", *body]
            out = ["select", "*", "except", ["(", "__qualify", ")"], "from", ["(", *self.level(inner), ")"], "where", "__qualify"]
        else:
            out = ["select", "*", "from", ["(", *self.level(["select", *items, *body]), ")"], "where", *self.level(condition)]
        return self.limits(self.level(head) + out + self.level(rest))

    def helper_columns(self, nodes: list) -> list:
        """GROUPS frames and SESSION_NUMBER need a column that is itself a window's: the FROM part becomes a subquery with it."""
        start, first = find(nodes, "select"), find(nodes, "from")
        if start < 0 or first < 0:
            return nodes
        added: list[str] = []
        sides: list = []
        items = nodes[start + 1 : first]
        end = next((k for k in range(first, len(nodes)) if low(nodes[k]) in ("group", "having", "qualify", "window", "order", "limit", "offset", "fetch")), len(nodes))
        # Rows that may be others when they are read again are read once.
        sure = not re.search(r"\b(rand|random|randn|uuid|shuffle|limit|fetch|tablesample)\b", text_of(nodes[first:end]).lower())
        out, i = [], 0
        while i < len(items):
            window = items[i + 2] if i + 2 < len(items) and isinstance(items[i], list) and low(items[i + 1]) == "over" else None
            if low(out[-1] if out else "") == "session_number" and isinstance(window, list):
                x, delta = split(items[i][1:-1])
                if sure and (side := self.session_side(x, delta, window[1:-1], len(sides))):
                    sides.append(side)
                    out[-1:] = [side[0]]
                    i += 3
                    continue
                over, name = text_of(window[1:-1]), f"__session{len(added)}"
                before = f"last_value({text_of(x)}) IGNORE NULLS OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
                added.append(f"CASE WHEN {text_of(x)} - {before} > {text_of(delta)} THEN 1 ELSE 0 END AS {name}")
                out.pop()
                out += tree(tokens(f"cast(1 + sum({name}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint)"))
                i += 3
                continue
            if isinstance(items[i], list) and i and low(items[i - 1]) == "over" and find(items[i], "groups") > 0:
                inner = items[i][1:-1]
                if sure and (side := self.groups_side(out, inner, len(sides))):
                    sides.append(side)
                    out[-3:] = [side[0]]
                    i += 1
                    continue
                g, o = find(inner, "groups"), find(inner, "order")
                name = f"__group{len(added)}"
                added.append(f"dense_rank() OVER ({text_of(inner[:g])}) AS {name}")
                out.append(["(", *inner[:o], "order", "by", name, "range", *inner[g + 1 :], ")"])
                i += 1
                continue
            out.append(items[i])
            i += 1
        if not added and not sides:
            return nodes
        where = find(nodes[:end], "where", start=first)
        source = nodes[first + 1 : where if where >= 0 else end]
        if low(nodes[end] if end < len(nodes) else "") == "group":
            raise SqlError("GROUPS frames and SESSION_NUMBER can't stand beside GROUP BY; put the grouping in a subquery")
        named = [k for k, x in enumerate(source) if low(x) == "as"]
        alias = []
        if "join" not in map(low, source):
            if len(named) == 1:
                alias = [source[named[0] + 1]]
            elif "," not in source and isinstance(source[-1], str):
                alias = [source[-1]]
        extra = [t for a in [*added, *(c for side in sides for c in side[1])] for t in (",", *tree(tokens(a)))]
        inner = ["(", "select", "*", *extra, *nodes[first:end], ")"]
        base = text = text_of([inner])
        for _, _, join in sides:
            text = join(base, text)
        return [*nodes[:start], "select", *out, "from", *(tree(tokens(text)) if sides else [inner]), *alias, *nodes[end:]]

    def keys(self, window: list, until: int, n: int) -> tuple[list[str], list[str], list[str], list[list[str]]]:
        """Columns of what a window is partitioned and ordered by, the names of both, and the words behind each order."""
        o = find(window, "order")
        by, order = split(window[2:o]) if o else [], split(window[o + 2 : until])
        words = [[low(x) for x in part if low(x) in ORDERS] for part in order]
        names = [f"__p{n}_{k}" for k in range(len(by))], [f"__o{n}_{k}" for k in range(len(order))]
        values = [*by, *([x for x in part if low(x) not in ORDERS] for part in order)]
        return [f"{text_of(v)} AS {c}" for v, c in zip(values, names[0] + names[1])], *names, words

    def groups_side(self, out: list, window: list, n: int):
        """A GROUPS frame as a join with the frames' values by distinct groups (windows.groups_frame), or None where it can't be.

        The item in place of the call, columns for the FROM part, and a function of the FROM part, bare and with what was joined so far.
        """
        g, o = find(window, "groups"), find(window, "order")
        bound = r"(\d+ preceding|\d+ following|current row)"
        ends = re.fullmatch(rf"(?:between )?{bound}(?: and {bound})?", " ".join(text_of(window[g + 1 :]).lower().split()))
        if not ends or o < 0 or len(out) < 3 or not isinstance(out[-2], list) or low(out[-3]) not in windows.ANY_ORDER or len(out) > 3 and out[-4] != ",":
            return None
        start, stop = (0 if x in (None, "current row") else int(x.split()[0]) * (-1 if "preceding" in x else 1) for x in ends.groups())
        args = out[-2][1:-1]
        if not start <= 0 <= stop or stop - start >= windows.FRAMES or "," in args or low(args[0]) == "distinct":
            return None
        columns, by, order, words = self.keys(window, g, n)
        star = args == ["*"]
        columns += [] if star else [f"{text_of(args)} AS __x{n}"]
        call, keys = f"{out[-3]}({'*' if star else f'__x{n}'})", by + order
        group, part = "".join(f"{c}, " for c in by), f"PARTITION BY {', '.join(by)} " if by else ""
        ranked = ", ".join(" ".join([c, *w]) for c, w in zip(order, words))

        def same(a: str, b: str, names: list[str]) -> str:
            return " AND ".join(f"{a}.{c} <=> {b}.{c}" for c in names)

        def join(base: str, now: str) -> str:
            peers = f"(SELECT {', '.join(keys)}, dense_rank() OVER ({part}ORDER BY {ranked}) AS __g{n} FROM (SELECT DISTINCT {', '.join(keys)} FROM {base}))"
            inside = f"(SELECT __b.*, explode(sequence(__g{n} - {stop}, __g{n} + {-start})) AS __to{n} FROM {base} AS __b JOIN {peers} AS __q ON {same('__b', '__q', keys)})"
            values = f"(SELECT {group}__to{n}, {call} AS __value FROM {inside} GROUP BY {group}__to{n})"
            framed = f"(SELECT {', '.join(f'__q.{c}' for c in keys)}, __v.__value FROM {peers} AS __q JOIN {values} AS __v ON {' AND '.join([*([same('__q', '__v', by)] if by else []), f'__q.__g{n} = __v.__to{n}'])})"
            return f"(SELECT __b.* EXCEPT ({', '.join(keys if star else [*keys, f'__x{n}'])}), __f.__value AS __frame{n} FROM {now} AS __b LEFT JOIN {framed} AS __f ON {same('__b', '__f', keys)})"

        return f"__frame{n}", columns, join

    def session_side(self, x: list, delta: list, window: list, n: int):
        """SESSION_NUMBER over chunks of the order, numbered on from chunk to chunk, or None where it can't be; see groups_side.

        Chunks end at rows picked by their hash, so each reading of the rows has the same ones. A partition of all rows
        has 128 of them, one of few rows in many has one.
        """
        o = find(window, "order")
        if o < 0 or not re.fullmatch(r"[\d.]+|interval\b[^()]*", text_of(delta).lower().strip()):
            return None
        columns, by, order, words = self.keys(window, len(window), n)
        if "nulls" in words[0]:
            return None
        # Only the first columns that go in one direction are cut.
        down = "desc" in words[0]
        lead = order[: next((k for k, w in enumerate(words) if "nulls" in w or ("desc" in w) != down), len(order))]
        v, d, group = f"__x{n}", text_of(delta), "".join(f"{c}, " for c in by)
        columns.append(f"{text_of(x)} AS {v}")
        chunk, seen, prev, local = f"__chunk{n}", f"__seen{n}", f"__prev{n}", f"__local{n}"
        part = f"PARTITION BY {', '.join(by)} " if by else ""
        # Rows alike in all of their order differ in the value alone, so each reading numbers them alike.
        inner = f"PARTITION BY {group}{chunk} ORDER BY {', '.join(' '.join([c, *w]) for c, w in zip(order, words))}, {v}"
        after = f"{part}ORDER BY {chunk} {'DESC' if down else 'ASC'} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

        def join(base: str, now: str) -> str:
            picked = f"(SELECT {', '.join(by + order)} FROM {base} ORDER BY xxhash64({', '.join(by + order)}) LIMIT 1024)"
            counted = f"(SELECT struct({', '.join(lead)}) AS __c, count(*) OVER ({part}) AS __n FROM {picked})"
            sorted_ = f"(SELECT sort_array(collect_set(__c)) AS __c, greatest(1, size(collect_set(__c)) DIV cast(ceil(128.0 * max(__n) / count(*)) AS int)) AS __step FROM {counted})"
            cuts = f"(SELECT filter(__c, (z, i) -> i > 0 AND i % __step = 0) AS __cuts FROM {sorted_})"

            def numbered(rows: str) -> str:
                # Looked up among the first of each eight cuts, then among those eight.
                eights = f"(SELECT __cuts, filter(__cuts, (z, i) -> i % 8 = 0) AS __firsts FROM {cuts})"
                block = f"(SELECT __r.*, __cuts, size(filter(__firsts, z -> z <= struct({', '.join(lead)}))) - 1 AS __eight FROM {rows} AS __r CROSS JOIN {eights} AS __c)"
                within = f"8 * __eight + size(filter(slice(__cuts, 8 * __eight + 1, 8), z -> z <= struct({', '.join(lead)})))"
                cut = f"(SELECT * EXCEPT (__cuts, __eight), CASE WHEN __eight >= 0 THEN {within} ELSE 0 END AS {chunk} FROM {block})"
                seen_ = f"(SELECT *, last_value({v}) IGNORE NULLS OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {prev}, count({v}) OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {seen} FROM {cut})"
                return f"(SELECT *, sum(CASE WHEN {v} - {prev} > {d} THEN 1 ELSE 0 END) OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {local} FROM {seen_})"

            ends = f"(SELECT {group}{chunk}, max({local}) AS __total, max_by({v}, CASE WHEN {v} IS NOT NULL AND {seen} = 1 THEN 1 END) AS __first, max_by({v}, CASE WHEN {v} IS NOT NULL THEN {seen} END) AS __last FROM {numbered(base)} GROUP BY {group}{chunk})"
            met = f"(SELECT *, CASE WHEN __first - last_value(__last) IGNORE NULLS OVER ({after}) > {d} THEN 1 ELSE 0 END AS __met FROM {ends})"
            carried = f"(SELECT {group}{chunk}, __met, coalesce(sum(__total + __met) OVER ({after}), 0) AS __before FROM {met})"
            on = " AND ".join([*(f"__b.{c} <=> __c.{c}" for c in by), f"__b.{chunk} = __c.{chunk}"])
            number = f"cast(1 + __c.__before + __b.{local} + CASE WHEN __b.{seen} > 0 THEN __c.__met ELSE 0 END AS bigint)"
            return f"(SELECT __b.* EXCEPT ({', '.join([*by, *order, v, chunk, seen, prev, local])}), {number} AS __session{n} FROM {numbered(now)} AS __b JOIN {carried} AS __c ON {on})"

        return f"__session{n}", columns, join

    def limits(self, nodes: list) -> list:
        i = find(nodes, "limit")
        if i >= 0 and i + 3 < len(nodes) and nodes[i + 2] == ",":
            nodes = nodes[:i] + ["limit", nodes[i + 3], "offset", nodes[i + 1]] + nodes[i + 4 :]
        i = find(nodes, "fetch")
        if i >= 0 and low(nodes[i + 1]) in ("first", "next"):
            nodes = nodes[:i] + ["limit", nodes[i + 2]] + nodes[i + 5 :]
        o, limit = find(nodes, "offset"), find(nodes, "limit")
        if 0 <= o < limit:
            nodes = nodes[:o] + nodes[limit : limit + 2] + nodes[o : o + 2] + nodes[limit + 2 :]
        return nodes

    def level(self, nodes: list) -> list:
        """Expressions of one level, inner levels first."""
        out: list = []
        nodes = self.row_values(nodes)
        block = find(nodes, "select") >= 0
        i = 0
        while i < len(nodes):
            x, word = nodes[i], low(nodes[i])
            if isinstance(x, list):
                inner = x[1:-1]
                calls = i > 0 and isinstance(nodes[i - 1], str) and re.fullmatch(r"[^\W\d]\w*", nodes[i - 1]) and low(nodes[i - 1]) not in NO_CALL and not (i > 1 and low(nodes[i - 2]) in ("as", ".", "into", "table", "join", "from") and low(nodes[i - 1]) not in ("generate_series", "unnest", "read_csv", "read_json", "read_parquet"))
                if x[0] == "(" and calls:
                    name = out.pop()
                    if low(name) in ("count", "sum", "avg") and inner and low(inner[0]) == "distinct" and i + 2 < len(nodes) and low(nodes[i + 1]) == "over":
                        out.append(self.distinct_over(low(name), inner[1:], nodes[i + 2]))
                        i += 3
                        continue
                    text = self.call(name, inner, nodes[i - 2] if i > 1 else "")
                    if i + 2 < len(nodes) and low(nodes[i + 1]) == "over" and (spread := self.spread_over(text, nodes[i + 2])):
                        out.append(spread)
                        i += 3
                        continue
                    out.append(text)
                elif x[0] == "[" and not (out and (isinstance(out[-1], list) or re.fullmatch(r"[\w`]+|.*\)", str(out[-1])) and low(out[-1]) not in NO_CALL)):
                    out.append("array(" + text_of(self.level(inner)) + ")")
                elif x[0] == "[":
                    value = out.pop()
                    while len(out) > 1 and out[-1] == ".":
                        dot, head = out.pop(), out.pop()
                        value = text_of([head, dot, value])
                    out.append(f"try_element_at({text_of([value])}, {text_of(self.level(inner))})")
                else:
                    out.append([x[0], *(self.query(inner) if inner and low(inner[0]) in ("select", "with", "(") or any(low(y) in ("select", "union") for y in inner) else self.level(inner)), x[-1]])
            elif x in ("->", "->>") and i + 1 < len(nodes) and str(nodes[i + 1]).startswith("'$"):
                value = out.pop()
                while len(out) > 1 and out[-1] == ".":
                    dot, head = out.pop(), out.pop()
                    value = text_of([head, dot, value])
                out.append(f"get_json_object({text_of([value])}, {nodes[i + 1]})")
                i += 1
            elif x == "&&":
                out.append("AND")
            elif x == "||" and self.dialect == "mysql":
                out.append("OR")
            elif x == "!":
                out.append("NOT")
            elif word == "binary" and out[-1:] != ["as"] and i + 1 < len(nodes) and (isinstance(nodes[i + 1], list) or re.match(r"[\w'`@]", nodes[i + 1])) and low(nodes[i + 1]) not in BOUNDS:
                # Compares by bytes, as all strings here do.
                pass
            elif word == "collate" and out and i + 1 < len(nodes) and isinstance(nodes[i + 1], str) and re.fullmatch(r"[\w`']+", nodes[i + 1]) and re.search(r"_(ci|cs|bin|as)\b|^binary$|^c$|^posix$", low(nodes[i + 1]).strip("`'")):
                # Strings are compared by code point whatever the collation's name.
                i += 1
            elif x.startswith("@@"):
                out.append(self.literal(SYSTEM.get(x[2:].lower().removeprefix("session.").removeprefix("global."))))
            elif x.startswith("@"):
                out.append(self.literal(self.variables.get(x[1:].lower())))
            elif x.startswith('"') and self.dialect != "mysql":
                out.append("`" + x[1:-1] + "`")
            elif word == "div":
                out.append("div")
            elif word == "straight_join":
                out.append("JOIN")
            elif word == "distinctrow":
                out.append("DISTINCT")
            elif word == "sounds" and i + 1 < len(nodes) and low(nodes[i + 1]) == "like":
                a, b = out.pop(), self.level([nodes[i + 2]])[0]
                out.append(f"(soundex({text_of([a])}) = soundex({text_of([b])}))")
                i += 2
            elif word == "from" and block and i + 1 < len(nodes) and isinstance(nodes[i + 1], str) and nodes[i + 1].startswith("'") and self.tables:
                out += [x, self.tables.path(nodes[i + 1][1:-1])]
                i += 1
            elif word == "in" and i + 1 < len(nodes) and isinstance(nodes[i + 1], list):
                out.append(self.membership(out, nodes[i + 1]))
                i += 1
            elif word in ("now", "current_timestamp", "localtimestamp", "utc_timestamp") and not (i + 1 < len(nodes) and isinstance(nodes[i + 1], list)):
                out.append("localtimestamp()")
            else:
                out.append(x)
            i += 1
        return self.xor(out)

    def row_values(self, nodes: list) -> list:
        """(a, b) < (c, d) and the like: from left to right, the first difference decides."""
        for i in range(1, len(nodes) - 1):
            a, o, b = nodes[i - 1 : i + 2]
            if o in ("=", "<>", "!=", "<", "<=", ">", ">=") and all(isinstance(x, list) and x[0] == "(" and "," in x for x in (a, b)) and (i < 2 or not isinstance(nodes[i - 2], str) or low(nodes[i - 2]) in BOUNDS or low(nodes[i - 2]) == "not"):
                p, q = split(a[1:-1]), split(b[1:-1])
                if len(p) != len(q):
                    raise SqlError("row values differ in length")
                if o in ("=", "<>", "!="):
                    test = " AND ".join(f"({text_of(x)}) = ({text_of(y)})" for x, y in zip(p, q))
                    test = test if o == "=" else f"NOT ({test})"
                else:
                    tests = []
                    for k in range(len(p)):
                        same = [f"({text_of(x)}) = ({text_of(y)})" for x, y in zip(p[:k], q[:k])]
                        last = o if k == len(p) - 1 else o[0]
                        tests.append("(" + " AND ".join([*same, f"({text_of(p[k])}) {last} ({text_of(q[k])})"]) + ")")
                    test = " OR ".join(tests)
                return self.row_values([*nodes[: i - 1], ["(", *tree(tokens(test)), ")"], *nodes[i + 2 :]])
        return nodes

    def membership(self, out: list, group: list):
        """IN over a list or a query. Nulls in the set don't count; a NULL is in no set and not in an empty one only."""
        inner = group[1:-1]
        negated = bool(out) and low(out[-1]) == "not"
        query = bool(inner) and low(inner[0]) in ("select", "with")
        if not query:
            items = [x for x in split(inner) if low(x[0]) != "null"]
            body = text_of([y for k, x in enumerate(items) for y in ([","] if k else []) + self.level(x)]) if items else "NULL"
            return f"IN ({body})"
        body = text_of(self.query(inner))
        if not negated:
            return f"IN ({body})"
        out.pop()
        probe = []
        while out and low(out[-1]) not in BOUNDS and out[-1] not in ("(",):
            probe.insert(0, out.pop())
        p = text_of(probe)
        if probe and isinstance(probe[-1], list) and len(probe) == 1 and "," in probe[-1]:
            n = len(split(probe[-1][1:-1]))
            names = ", ".join(f"__v{k}" for k in range(n))
            match = " AND ".join(f"__v{k} = ({text_of(v)})" for k, v in enumerate(split(probe[-1][1:-1])))
            return f"(NOT EXISTS (SELECT 1 FROM ({body}) AS __s({names}) WHERE {match}))"
        # The NULL has a test of its own: an OR beside the equality would leave a nested loop over all pairs.
        return f"(NOT EXISTS (SELECT 1 FROM ({body}) AS __s(__v) WHERE __v = ({p})) AND (({p}) IS NOT NULL OR NOT EXISTS (SELECT 1 FROM ({body}) AS __s(__v))))"

    def xor(self, nodes: list) -> list:
        i = find(nodes, "xor")
        if i < 0:
            return nodes
        a = i
        while a > 0 and low(nodes[a - 1]) not in BOUNDS:
            a -= 1
        b = i + 1
        while b < len(nodes) and low(nodes[b]) not in BOUNDS:
            b += 1
        pair = ["(", "(", *nodes[a:i], ")", "<>", "(", *nodes[i + 1 : b], ")", ")"]
        return self.xor(nodes[:a] + [text_of(pair)] + nodes[b:])

    def literal(self, v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    def call(self, name: str, inner: list, before="") -> str:
        word = name.lower()
        if word in ("generate_series", "unnest", "read_csv", "read_json", "read_parquet") and (low(before) in ("from", "join", ",", "lateral")):
            return self.source(word, inner)
        if word in ("cast", "try_cast", "extract", "position", "exists", "timestampdiff", "timestampadd", "date_add", "date_sub", "adddate", "subdate") and word not in ("date_add", "date_sub", "adddate", "subdate"):
            if word == "extract" and len(inner) > 1 and "_" in low(inner[0]):
                return registry.rewrite(f"extract_{low(inner[0])}", [text_of(self.level(inner[2:]))])
            body = self.query(inner) if inner and low(inner[0]) == "select" else self.level(inner)
            return f"{'try_cast' if word == 'cast' else name}({text_of(body)})"
        if word == "convert" and len(split(inner)) == 2:
            a, b = split(inner)
            return f"try_cast({text_of(self.level(a))} AS {text_of(b).replace('SIGNED', 'BIGINT').replace('signed', 'bigint')})"
        if word == "trim" and any(low(x) in ("leading", "trailing", "both") for x in inner):
            return f"trim({text_of(self.level(inner))})"
        if word in ("group_concat", "string_agg", "listagg"):
            return self.group_concat(inner)
        parts = [p for p in split(inner)] if inner else []
        distinct = parts and low(parts[0][0]) == "distinct" if parts and parts[0] else False
        if word == "array_agg" and (k := find(inner, "order")) >= 0:
            body = inner[1:k] if distinct else inner[:k]
            packed, value = self.sorted_list(text_of(self.level(body)), inner[k + 2 :], bool(distinct), False)
            return f"transform({packed}, z -> z.{value})"
        if distinct and word == "array_agg":
            return f"array_sort(collect_set({text_of(self.level(parts[0][1:]))}))"
        if distinct or inner == ["*"] or any(low(x) in ("order", "ignore", "respect", "from", "for") for x in inner):
            return f"{name}({text_of(self.level(inner))})"
        args = [text_of(self.level(p)) for p in parts]
        if word in ("date_add", "date_sub", "adddate", "subdate") and len(parts) == 2 and parts[1] and low(parts[1][0]) == "interval":
            sign = "" if "add" in word else "-"
            return f"timestampadd({low(parts[1][-1]).rstrip('s')}, {sign}({text_of(self.level(parts[1][1:-1])).strip(chr(39))}), cast({args[0]} as timestamp_ntz))"
        got = registry.rewrite(name, args, self.dialect)
        return got if got is not None else f"{name}({', '.join(args)})"

    def spread_over(self, text: str, window) -> str | None:
        """A composed aggregate over a window: OVER goes behind each of the aggregates that it is made of."""
        if re.fullmatch(r"\w+", text) or (m := re.match(r"\w+\(", text)) and closing(text, m.end() - 1) == len(text) - 1 and text[: m.end() - 1].lower() not in WRAPPERS and not text.startswith("count(DISTINCT"):
            return None
        over = text_of(["(", *self.level(window[1:-1]), ")"]) if isinstance(window, list) else window
        out, at = [], 0
        for m in re.finditer(r"\b(collect_list|collect_set|count|sum|avg|min|max|corr|percentile|first|last)\(", text):
            if m.start() < at:
                continue
            end = closing(text, m.end() - 1) + 1
            call = text[m.start() : end]
            distinct = re.match(r"count\(DISTINCT (.*)\)$", call, re.S)
            out += [text[at : m.start()], f"cast(size(collect_set({distinct[1]}) OVER {over}) as bigint)" if distinct else f"{call} OVER {over}"]
            at = end
        return "".join(out) + text[at:] if at else None

    def distinct_over(self, name: str, inner: list, window) -> str:
        """DISTINCT aggregates over a window, from the set of values of the frame."""
        over = text_of(["(", *self.level(window[1:-1]), ")"]) if isinstance(window, list) else window
        values = f"collect_set({text_of(self.level(inner))}) OVER {over}"
        if name == "count":
            return f"cast(size({values}) as bigint)"
        total = f"aggregate({values}, 0D, (a, x) -> a + x)"
        return f"(CASE WHEN size({values}) > 0 THEN {total} END)" if name == "sum" else f"try_divide({total}, size({values}))"

    def sorted_list(self, value: str, order: list, distinct: bool, skip_nulls: bool) -> tuple[str, str]:
        """A sorted array of structs of a group's values and the name of the value in them. Nulls come first, last if descending."""
        fields, down = [], []
        for k, part in enumerate(split(order)):
            words = [low(x) for x in part]
            down.append("desc" in words)
            fields.append(f"{text_of(self.level([x for x in part if low(x) not in ('asc', 'desc')]))} AS o{k}")
        compare = "0"
        for k, d in reversed(list(enumerate(down))):
            less, more = ("1", "-1") if d else ("-1", "1")
            compare = f"CASE WHEN a.o{k} <=> b.o{k} THEN {compare} WHEN a.o{k} IS NULL THEN {less} WHEN b.o{k} IS NULL THEN {more} WHEN a.o{k} < b.o{k} THEN {less} ELSE {more} END"
        rows = f"{'collect_set' if distinct else 'collect_list'}(struct({', '.join(fields)}, {value} AS v))"
        if skip_nulls:
            rows = f"filter({rows}, z -> z.v IS NOT NULL)"
        return f"array_sort({rows}, (a, b) -> {compare})", "v"

    def group_concat(self, inner: list) -> str:
        sep, order = "','", ""
        i = find(inner, "separator")
        if i >= 0:
            sep, inner = inner[i + 1], inner[:i]
        i = find(inner, "order")
        if i >= 0:
            source = inner[i + 2 :]
            order, inner = f" WITHIN GROUP (ORDER BY {text_of(self.level(source))})", inner[:i]
        parts = split(inner)
        if len(parts) == 2 and parts[1] and str(parts[1][0]).startswith("'"):
            sep, inner = parts[1][0], parts[0]
        distinct = "DISTINCT " if low(inner[0]) == "distinct" else ""
        body = inner[1:] if distinct else inner
        value = " || ".join(f"cast({text_of(self.level(p))} as string)" for p in split(body))
        if distinct and i >= 0:
            # Values in the order of what they are, not of their text; the set holds one of each.
            packed, v = self.sorted_list(value, source, True, True)
            return f"transform(array({packed}), l -> CASE WHEN size(l) > 0 THEN array_join(array_distinct(transform(l, z -> z.{v})), {sep}) END)[0]"
        return f"listagg({distinct}{value}, {sep}){order}"

    def source(self, word: str, inner: list) -> str:
        """A function in FROM."""
        args = split(inner)
        if word == "generate_series":
            named = {low(a[0]): a[2:] for a in args if len(a) > 2 and a[1] in ("=", ":=") and low(a[0]) in ("start", "stop", "end", "step")}
            if named:
                args = [named["start"], named.get("stop") or named["end"], *([named["step"]] if "step" in named else [])]
            a = [text_of(self.level(x)) for x in args]
            step = a[2] if len(a) > 2 else "1"
            return f"explode(CASE WHEN ({step}) = 0 THEN raise_error('the step of generate_series is 0') WHEN sign({step}) * (({a[1]}) - ({a[0]})) >= 0 THEN sequence(cast({a[0]} as bigint), cast({a[1]} as bigint), cast({step} as bigint)) ELSE cast(array() as array<bigint>) END)"
        if word == "unnest":
            a = [text_of(self.level(x)) for x in args]
            return f"explode({a[0]})" if len(a) == 1 else f"inline(arrays_zip({', '.join(a)}))"
        options = {low(x[0]): text_of(x[2:]).strip("'") for x in args[1:] if len(x) > 2}
        return self.tables.file(word[5:], text_of(args[0]).strip("'"), options)
