"""Statements: queries, variables, DDL and DML over the keyed store, catalog listings, and those that need no action."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect import Rewriter, SqlError, find, low, split, text_of, tokens, tree

#: Accepted without an effect here: there is nothing to lock, flush or compact.
NO_ACTION = frozenset("begin start commit rollback savepoint release lock unlock flush optimize check kill".split())


def statements(text: str) -> list[list]:
    return [[*joined(s)] for s in split(tree(tokens(text)), ";") if s]


def joined(nodes: list) -> list:
    """A name of two parts behind a word that a table's name follows becomes one token."""
    out, i = [], 0
    while i < len(nodes):
        x = nodes[i]
        if i + 2 < len(nodes) and nodes[i + 1] == "." and isinstance(x, str) and isinstance(nodes[i + 2], str) and out and low(out[-1]) in ("table", "into", "update", "exists", "view", "truncate"):
            out.append(f"{x}.{nodes[i + 2]}".replace("`", ""))
            i += 3
            continue
        out.append(x)
        i += 1
    return out


def bound(text: str, args: list) -> str:
    """The text with its parameters as literals; those in strings are left alone."""
    r, flat, k = Rewriter(), [], 0
    for t in tokens(text.replace("$", " $ ")) if "$" in text else tokens(text):
        if t == "?":
            t, k = r.literal(args[k]), k + 1
        elif flat and flat[-1] == "$" and t.isdigit():
            flat.pop()
            t = r.literal(args[int(t) - 1])
        flat.append(t)
    return text_of(flat)


def copy(engine, nodes: list, dialect: str) -> DataFrame:
    """COPY table FROM 'path' or COPY table | (query) TO 'path', WITH (header, delimiter, null)."""
    from ..sources.files import copy_in, copy_out

    at = find(nodes, "from", "to")
    path = nodes[at + 1].strip("'")
    given = next((x for x in nodes[at + 2 :] if isinstance(x, list)), ["(", ")"])
    options = {low(p[0]): text_of(p[1:]).strip("'") or "true" for p in split(given[1:-1]) if p}
    header, sep, null = options.get("header", "false") in ("true", "on", "1"), options.get("delimiter", ","), options.get("null", "")
    if low(nodes[at]) == "to":
        source = nodes[1]
        df = query(engine, source[1:-1], dialect) if isinstance(source, list) else engine.spark.table(text_of(nodes[1:at]))
        copy_out(df, path, header, sep, null)
        return done(engine, "copy", df.count())
    name = text_of(nodes[1:2])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in engine.store.read(name).schema)
    return done(engine, "copy", engine.store.insert(name, copy_in(engine.spark, path, schema, header, sep, null)))


def execute(engine, text: str, dialect: str) -> DataFrame:
    out = None
    for nodes in statements(text):
        out = one(engine, nodes, dialect)
    return out if out is not None else done(engine, "empty")


def done(engine, what: str, rows: int = 0) -> DataFrame:
    return engine.spark.createDataFrame([(what, rows)], "statement string, rows long")


def rewriter(engine, dialect: str) -> Rewriter:
    return Rewriter(dialect, engine.variables, engine.store)


def query(engine, nodes: list, dialect: str) -> DataFrame:
    if low(nodes[0]) == "with" and len(nodes) > 1 and low(nodes[1]) == "recursive":
        from ..operators.recursive import run_with

        got = run_with(engine, nodes, dialect)
        if got is not None:
            return got
    return engine.run(text_of(rewriter(engine, dialect).query(nodes)))


def one(engine, nodes: list, dialect: str) -> DataFrame:
    word = low(nodes[0])
    second = low(nodes[1]) if len(nodes) > 1 else ""
    if word in ("select", "with", "values", "table", "from") or isinstance(nodes[0], list):
        return query(engine, nodes, dialect)
    if word == "explain":
        body = nodes[1:]
        if low(body[0]) == "format":
            body = body[3:]
        plan = query(engine, body, dialect)._jdf.queryExecution().explainString(engine.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return engine.spark.createDataFrame([(plan,)], "plan string")
    if word == "copy":
        return copy(engine, nodes, dialect)
    if word == "set":
        return assign(engine, nodes, dialect)
    if word in NO_ACTION:
        return done(engine, word)
    if word == "analyze":
        return done(engine, word)
    if word == "show":
        return show(engine, nodes)
    if word in ("describe", "desc"):
        return engine.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in engine.spark.table(text_of(nodes[1:])).schema], "name string, type string, nullable boolean")
    if word == "use":
        engine.spark.catalog.setCurrentDatabase(text_of(nodes[1:]))
        return done(engine, "use")
    if word == "create":
        return create(engine, nodes, dialect)
    if word == "drop":
        names = nodes[2:]
        if names and low(names[0]) == "if":
            names = names[2:]
        if second in ("table", "view", "materialized", "temporary"):
            for n in split(names[1:] if second in ("materialized", "temporary") else names):
                engine.store.drop(text_of(n))
        elif second == "function":
            engine.functions.pop(text_of(names).lower(), None)
            engine.run(f"DROP TEMPORARY FUNCTION IF EXISTS {text_of(names)}")
        elif second in ("database", "schema"):
            engine.run(text_of(nodes))
        return done(engine, "drop")
    if word == "refresh":
        engine.store.refresh(text_of(nodes[3:] if second == "materialized" else nodes[1:]))
        return done(engine, "refresh")
    if word == "truncate":
        name = text_of(nodes[2:] if second == "table" else nodes[1:])
        engine.store.replace(name, engine.store.read(name).limit(0))
        return done(engine, "truncate")
    if word == "alter":
        return alter(engine, nodes, dialect)
    if word == "rename":
        engine.store.rename(text_of(nodes[2:3]), text_of(nodes[4:5]))
        return done(engine, "rename")
    if word in ("insert", "replace"):
        return insert(engine, nodes, dialect)
    if word == "update":
        return update(engine, nodes, dialect)
    if word == "delete":
        return delete(engine, nodes, dialect)
    raise SqlError(f"unknown statement {nodes[0]}")


def assign(engine, nodes: list, dialect: str) -> DataFrame:
    """SET @a = expr, ...: from left to right, later ones see earlier ones."""
    for part in split(nodes[1:]):
        if str(part[0]).startswith("@") and not str(part[0]).startswith("@@"):
            sql = "SELECT " + text_of(rewriter(engine, dialect).level(part[2:])) + " AS v"
            engine.variables[part[0][1:].lower()] = engine.run(sql).first()[0]
    return done(engine, "set")


def show(engine, nodes: list) -> DataFrame:
    word, spark = low(nodes[1]), engine.spark
    if word in ("databases", "schemas"):
        return spark.sql("SHOW DATABASES")
    if word == "tables":
        return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")
    if word == "functions":
        from ..functions.registry import COMPOSED, NATIVE
        from ..functions.udfs import UDFS

        return spark.createDataFrame([(n,) for n in sorted({*COMPOSED, *NATIVE, *UDFS, *engine.functions})], "name string")
    if word == "columns":
        return one(engine, ["describe", *nodes[3:]], "neutral")
    if word == "create":
        name = text_of(nodes[3:])
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(name).schema)
        return spark.createDataFrame([(name, f"CREATE TABLE {name} ({cols})")], "name string, statement string")
    if word == "processlist":
        return spark.createDataFrame([], "id long, state string")
    raise SqlError(f"unknown SHOW {word}")


# Column types of the dialect as Spark types.
TYPES = {"tinyint": "tinyint", "smallint": "smallint", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "largeint": "decimal(38,0)", "float": "float", "real": "float", "double": "double", "boolean": "boolean", "bool": "boolean", "char": "string", "varchar": "string", "string": "string", "text": "string", "date": "date", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "time": "string", "year": "smallint", "enum": "string", "set": "string", "bit": "bigint", "binary": "string", "varbinary": "string", "blob": "string", "uuid": "string", "json": "string", "bitmap": "array<bigint>", "serial": "bigint"}


def spark_type(nodes: list) -> str:
    """The type at the start of a column's definition."""
    name = low(nodes[0])
    if name in ("decimal", "numeric") and len(nodes) > 1 and isinstance(nodes[1], list):
        p = int(nodes[1][1])
        if p > 38:
            raise SqlError("decimals have at most 38 digits")
        return text_of(["decimal", nodes[1]]).replace(" ", "")
    if name in ("array", "map", "struct"):
        depth, out = 0, []
        for x in nodes:
            out.append(x)
            depth += {"<": 1, ">": -1, ">>": -2}.get(x, 0) if isinstance(x, str) else 0
            if depth == 0 and len(out) > 1:
                break
        flat = text_of(out)
        flat = re.sub(r"(?i)\b(varchar|char)\s*\(\s*\d+\s*\)", "string", flat)
        return re.sub(r"[A-Za-z]+(?=\s*[,>)])", lambda m: TYPES.get(m[0].lower(), m[0]), flat)
    if name not in TYPES:
        raise SqlError(f"unknown type {name}")
    return TYPES[name]


def create(engine, nodes: list, dialect: str) -> DataFrame:
    words = [low(x) for x in nodes[:6]]
    kind = next((w for w in words if w in ("table", "view", "database", "schema", "function", "index")), "")
    at = words.index(kind) if kind else -1
    if kind in ("database", "schema"):
        engine.run(text_of(nodes))
        return done(engine, "create")
    if kind == "index" or not kind:
        return done(engine, "create")
    rest = nodes[at + 1 :]
    exists_ok = low(rest[0]) == "if"
    if exists_ok:
        rest = rest[3:]
    name = text_of(rest[:1])
    if kind == "view":
        start = find(rest, "as")
        if "materialized" in words:
            engine.store.materialize(name, text_of(rest[start + 1 :]), dialect)
        else:
            engine.view(name, query(engine, rest[start + 1 :], dialect))
        return done(engine, "create")
    if kind == "function":
        return create_function(engine, rest, dialect)
    if exists_ok and engine.store.has(name):
        return done(engine, "create")
    body = next((x for x in rest[1:] if isinstance(x, list)), None)
    start = find(rest, "as", "select")
    if low(rest[1]) == "like" if len(rest) > 1 else False:
        engine.store.create(name, engine.store.read(text_of(rest[2:3])).limit(0), engine.store.keys(text_of(rest[2:3])))
    elif start >= 0:
        df = query(engine, rest[start + 1 :] if low(rest[start]) == "as" else rest[start:], dialect)
        keys = key_of(rest[1:start])
        engine.store.create(name, df, keys)
        return done(engine, "create", engine.store.read(name).count())
    else:
        columns, keys, extra = definition(body[1:-1])
        keys = keys or key_of(rest[2:])
        engine.store.create(name, engine.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in columns)), keys, extra)
    return done(engine, "create")


def key_of(nodes: list) -> list[str]:
    for i, x in enumerate(nodes):
        if low(x) == "key" and i and low(nodes[i - 1]) in ("primary", "unique") and i + 1 < len(nodes) and isinstance(nodes[i + 1], list):
            return [text_of(c).strip("`") for c in split(nodes[i + 1][1:-1])]
    return []


def definition(nodes: list) -> tuple[list, list, dict]:
    """Columns, key and, by column, default, auto_increment and on_update."""
    columns, keys, extra = [], [], {}
    for part in split(nodes):
        head = low(part[0])
        if head in ("primary", "unique", "constraint", "index", "key", "foreign", "check"):
            keys = keys or key_of(part)
            continue
        name = part[0].strip("`")
        columns.append((name, spark_type(part[1:])))
        words = [low(x) for x in part]
        if "primary" in words:
            keys = [name]
        e = {}
        if "auto_increment" in words or "identity" in words or words[1] == "serial":
            e["auto"] = True
        if "default" in words and "generated" not in words:
            d = part[words.index("default") + 1 :]
            e["default"] = text_of(d[:2] if len(d) > 1 and isinstance(d[1], list) else d[:1])
        if "update" in words:
            e["on_update"] = "localtimestamp()"
        if e:
            extra[name] = e
    return columns, keys, extra


def create_function(engine, nodes: list, dialect: str) -> DataFrame:
    """CREATE FUNCTION f(a T, ..) RETURNS TABLE AS (SELECT ..) or RETURNS T AS expression."""
    name, args = nodes[0], [(p[0], spark_type(p[1:])) for p in split(nodes[1][1:-1]) if p]
    start = max(find(nodes, "as"), find(nodes, "return"))
    body = nodes[start + 1 :]
    if len(body) == 1 and isinstance(body[0], list):
        body = body[0][1:-1]
    table = low(nodes[find(nodes, "returns") + 1]) == "table"
    sql = text_of(rewriter(engine, dialect).query(body))
    head = ", ".join(f"{a} {t}" for a, t in args)
    kind = "TABLE" if table else spark_type(nodes[find(nodes, "returns") + 1 :])
    engine.run(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({head}) RETURNS {kind} RETURN {sql}")
    engine.functions[name.lower()] = sql
    return done(engine, "create")


def alter(engine, nodes: list, dialect: str) -> DataFrame:
    name, rest = text_of(nodes[2:3]), nodes[3:]
    df, word = engine.store.read(name), low(rest[0])
    tail = rest[2:] if len(rest) > 1 and low(rest[1]) == "column" else rest[1:]
    if word == "add":
        column, kind = tail[0].strip("`"), spark_type(tail[1:])
        words = [low(x) for x in tail]
        value = F.expr(text_of([tail[words.index("default") + 1]])) if "default" in words else F.lit(None)
        cols = df.columns
        place = 0 if words[-1] == "first" else (cols.index(tail[-1].strip("`")) + 1 if "after" in words else len(cols))
        df = df.withColumn(column, value.cast(kind)).select(*cols[:place], column, *cols[place:])
    elif word == "drop":
        df = df.drop(tail[0].strip("`"))
    elif word == "rename" and low(rest[1]) in ("to", "as"):
        engine.store.rename(name, text_of(rest[2:]))
        return done(engine, "alter")
    elif word == "rename":
        df = df.withColumnRenamed(tail[0].strip("`"), tail[2].strip("`"))
    elif word == "change":
        df = df.withColumnRenamed(tail[0].strip("`"), tail[1].strip("`")).withColumn(tail[1].strip("`"), F.col(tail[1]).cast(spark_type(tail[2:])))
    elif word == "modify":
        df = df.withColumn(tail[0].strip("`"), F.col(tail[0]).cast(spark_type(tail[1:])))
    else:
        return done(engine, "alter")
    engine.store.replace(name, df)
    return done(engine, "alter")


def insert(engine, nodes: list, dialect: str) -> DataFrame:
    mode = low(nodes[0])
    i = 1
    if low(nodes[i]) == "ignore":
        mode, i = "ignore", i + 1
    if low(nodes[i]) == "into":
        i += 1
    name, i = text_of(nodes[i : i + 1]), i + 1
    columns = None
    if i < len(nodes) and isinstance(nodes[i], list) and low(nodes[i][1]) not in ("select", "with"):
        columns, i = [text_of(c).strip("`") for c in split(nodes[i][1:-1])], i + 1
    rest, changes = nodes[i:], None
    on = next((k for k in range(len(rest) - 3) if [low(x) for x in rest[k : k + 4]] == ["on", "duplicate", "key", "update"]), -1)
    if on >= 0:
        changes, rest = rest[on + 4 :], rest[:on]
    if low(rest[0]) == "set":
        pairs = [(p[0].strip("`"), p[2:]) for p in split(rest[1:])]
        columns, rest = [c for c, _ in pairs], ["select", *[y for k, (_, v) in enumerate(pairs) for y in ([","] if k else []) + v]]
    if low(rest[0]) == "values" and any(low(x) == "default" for row in rest[1:] if isinstance(row, list) for x in row):
        rest = [[["NULL" if low(x) == "default" else x for x in row] if isinstance(row, list) else row for row in [r]][0] for r in rest]
    df = query(engine, rest, dialect)
    updates = None
    if changes is not None:
        # VALUES(c) is the row that was to be inserted, a bare column the one that is there.
        r = rewriter(engine, dialect)
        updates = {p[0].strip("`"): re.sub(r"(?i)\bvalues\s*\(\s*(\w+)\s*\)", r"__new.\1", text_of(r.level([x if not (k and low(p[2:][k - 1]) == "values") else x for k, x in enumerate(p[2:])]))) for p in split(changes)}
    n = engine.store.insert(name, df, columns, "update" if updates is not None else mode, updates)
    return done(engine, low(nodes[0]), n)


def update(engine, nodes: list, dialect: str) -> DataFrame:
    s, w = find(nodes, "set"), find(nodes, "where")
    source, end = nodes[1:s], w if w >= 0 else len(nodes)
    r = rewriter(engine, dialect)
    changes = {}
    for p in split(nodes[s + 1 : end]):
        eq = p.index("=")
        changes[str(p[eq - 1]).strip("`")] = text_of(r.level(p[eq + 1 :]))
    where = text_of(r.level(nodes[w + 1 :])) if w >= 0 else "true"
    n = engine.store.update(text_of(source[:1]), text_of(r.level(source)), changes, where, str(source[1]) if len(source) == 2 else None)
    return done(engine, "update", n)


def delete(engine, nodes: list, dialect: str) -> DataFrame:
    f, w = find(nodes, "from", "using"), find(nodes, "where")
    source = nodes[f + 1 : w if w >= 0 else len(nodes)]
    target = text_of(nodes[1:f]) if f > 1 else text_of(source[:1])
    r = rewriter(engine, dialect)
    where = text_of(r.level(nodes[w + 1 :])) if w >= 0 else "true"
    table = next((text_of(source[k - 1 : k]) for k in range(1, len(source)) if text_of(source[k : k + 1]) == target), target)
    n = engine.store.delete(table, text_of(r.level(source)), where, target if target != table else None)
    return done(engine, "delete", n)
