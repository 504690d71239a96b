"""Tables that take statements: versions of Parquet folders behind a pointer.

A write makes a new folder and then moves the pointer, so that readers keep the version they began with, a failed write
leaves nothing visible, and the files of one version never change. Keyed tables keep one row per key. Rows put into a table
without a key are a folder of their own beside the others of the version. The pointer is a numbered file: a store that is
opened again on its root finds its tables, and two writers can't both make the same version on stores that refuse to rename
onto a file.
"""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of one version at most; one more insert writes them as one.
PARTS = 64


class Store:
    def __init__(self, engine, root: str | None = None):
        self.engine, self.root = engine, root
        self.versions: dict[str, tuple[tuple[str, ...], StructType]] = {}
        self.numbers: dict[str, int] = {}
        self.batches: dict[str, dict[str, int]] = {}
        self.key: dict[str, list[str]] = {}
        self.extra: dict[str, dict] = {}
        self.views: dict[str, tuple[str, str]] = {}
        self.next: dict[str, int] = {}
        if root:
            self.reopen()

    # Small files beside the tables.

    def hadoop(self, path: str):
        """A path and its file system."""
        context = self.engine.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(context._jsc.hadoopConfiguration())

    def put(self, path: str, text: str) -> None:
        """Writes a file that is there as a whole or not at all, and only once."""
        p, fs = self.hadoop(path)
        part, _ = self.hadoop(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p) or not fs.rename(part, p):
            fs.delete(part, False)
            raise RuntimeError(f"another writer made {path}")

    def get(self, path: str) -> str:
        p, fs = self.hadoop(path)
        stream = fs.open(p)
        try:
            return self.engine.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, path: str) -> list[str]:
        """Names in a folder, but not of files that are being written; none if there is no such folder."""
        p, fs = self.hadoop(path)
        return sorted(n for x in fs.listStatus(p) if not (n := x.getPath().getName()).endswith(".part")) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        p, fs = self.hadoop(path)
        fs.delete(p, True)

    def publish(self, n: str) -> None:
        """Moves the table's pointer to the version that is in memory."""
        (paths, schema), number = self.versions[n], self.numbers.get(n, 0) + 1
        state = {"paths": paths, "schema": schema.json(), "key": self.key.get(n, []), "extra": self.extra.get(n, {}), "next": self.next.get(n, 1), "batches": self.batches.get(n, {}), "view": self.views.get(n)}
        self.put(f"{self.folder()}/{n}/_versions/{number:012d}", json.dumps(state))
        self.numbers[n] = number

    def reopen(self) -> None:
        """The tables whose pointers are under the root."""
        for n in self.names(self.root):
            if found := self.names(f"{self.root}/{n}/_versions"):
                state = json.loads(self.get(f"{self.root}/{n}/_versions/{found[-1]}"))
                self.versions[n], self.numbers[n] = (tuple(state["paths"]), StructType.fromJson(json.loads(state["schema"]))), int(found[-1])
                self.key[n], self.extra[n], self.next[n], self.batches[n] = (state[k] for k in ("key", "extra", "next", "batches"))
                if state["view"]:
                    self.views[n] = tuple(state["view"])
                self.engine.view(n, self.read(n))

    def folder(self) -> str:
        if self.root is None:
            shared = self.engine.spark.conf.get("spark.checkpoint.dir", None)
            if shared:
                self.root = f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"
            else:
                if not self.engine.spark.sparkContext.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
                local = tempfile.mkdtemp(prefix="sparkforge-store-")
                atexit.register(shutil.rmtree, local, ignore_errors=True)
                self.root = f"file://{local}"
        return self.root

    @staticmethod
    def name(name: str) -> str:
        return re.sub(r"\s*\.\s*", "__", name.replace("`", "").strip()).lower()

    def has(self, name: str) -> bool:
        return self.name(name) in self.versions

    def keys(self, name: str) -> list[str]:
        return self.key.get(self.name(name), [])

    def read(self, name: str) -> DataFrame:
        n = self.name(name)
        if n not in self.versions:
            return self.engine.spark.table(name)
        paths, schema = self.versions[n]
        return self.engine.spark.read.schema(schema).parquet(*paths)

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a new version, sorted by the key inside partitions so that row groups can be skipped, and moves the pointer."""
        n = self.name(name)
        path = f"{self.folder()}/{n}/{uuid.uuid4().hex}"
        keys = [k for k in self.key.get(n, []) if k in df.columns]
        (df.sortWithinPartitions(*keys) if keys else df).write.parquet(path)
        self.versions[n] = ((path,), df.schema)
        self.publish(n)
        self.engine.view(n, self.read(n))

    def append(self, name: str, df: DataFrame) -> int:
        """Rows as one more folder of the table, whose other files stay as they are. Returns their number."""
        n = self.name(name)
        path = f"{self.folder()}/{n}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        paths, schema = self.versions[n]
        self.versions[n] = ((*paths, path), schema)
        if len(paths) < PARTS:
            self.publish(n)
            self.engine.view(n, self.read(n))
        else:
            self.replace(n, self.read(n))
        return self.engine.spark.read.schema(schema).parquet(path).count()

    def create(self, name: str, df: DataFrame, keys: list[str] | None = None, extra: dict | None = None) -> None:
        n = self.name(name)
        self.key[n], self.extra[n], self.next[n] = keys or [], extra or {}, 1
        self.replace(name, df if not keys else self.latest(df, keys))

    def drop(self, name: str) -> None:
        n = self.name(name)
        for d in (self.versions, self.key, self.extra, self.views, self.next, self.batches, self.numbers):
            d.pop(n, None)
        self.remove(f"{self.folder()}/{n}/_versions")
        self.engine.spark.catalog.dropTempView(n)

    def rename(self, old: str, new: str) -> None:
        a, b = self.name(old), self.name(new)
        for d in (self.versions, self.key, self.extra, self.next, self.batches, self.views):
            if a in d:
                d[b] = d.pop(a)
        self.publish(b)
        self.numbers.pop(a, None)
        self.remove(f"{self.folder()}/{a}/_versions")
        self.engine.spark.catalog.dropTempView(a)
        self.engine.view(b, self.read(b))

    @staticmethod
    def latest(df: DataFrame, keys: list[str], order=None) -> DataFrame:
        """One row per key: the last by `order`, else the last that came."""
        o = order if order is not None else F.monotonically_increasing_id()
        w = Window.partitionBy(*keys).orderBy(F.desc("__o"))
        return df.withColumn("__o", o).withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__o", "__i")

    def shaped(self, name: str, df: DataFrame, columns: list[str] | None) -> DataFrame:
        """df's columns under the table's names and types, with defaults, numbers for AUTO_INCREMENT, and nulls for the rest."""
        n = self.name(name)
        schema, extra = self.read(name).schema, self.extra.get(n, {})
        given = columns or schema.names[: len(df.columns)]
        df = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
        place = {c.lower(): f"__c{i}" for i, c in enumerate(given)}
        auto = next((c for c, e in extra.items() if e.get("auto")), None)
        if auto:
            df = self.numbered(df, f"{self.folder()}/{n}/{uuid.uuid4().hex}-new", self.next.get(n, 1))
        out = []
        for f in schema:
            e = extra.get(f.name, {})
            c = F.col(place[f.name.lower()]) if f.name.lower() in place else None
            if f.name == auto:
                c = F.col("__n") if c is None else F.coalesce(c, F.col("__n"))
            elif "default" in e and c is None:
                c = F.expr(re.sub(r"(?i)current_timestamp(\s*\(.*?\))?|now\s*\(\s*\)", "localtimestamp()", e["default"]))
            out.append((F.lit(None) if c is None else c).cast(f.dataType).alias(f.name))
        return df.select(*out)

    def numbered(self, df: DataFrame, path: str, first: int) -> DataFrame:
        """df with consecutive numbers from `first` on as __n: places inside partitions, written so that they stay, behind
        the rows of the partitions before, of which there is one count each."""
        out = df.withColumn("__m", F.monotonically_increasing_id())
        out.write.parquet(path)
        out = self.engine.spark.read.schema(out.schema).parquet(path).withColumn("__p", F.shiftright("__m", 33))
        counts = out.groupBy("__p").agg(F.count("*").alias("__c"))
        before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select(F.col("__p").alias("__q"), before.alias("__b"))
        place = F.col("__m") - F.shiftleft("__p", 33) + F.col("__b") + F.lit(first)
        return out.join(starts, F.col("__p") == F.col("__q")).withColumn("__n", place).drop("__m", "__p", "__q", "__b")

    def insert(self, name: str, df: DataFrame, columns: list[str] | None = None, mode: str = "insert", updates: dict | None = None) -> int:
        """mode: insert and replace (new row wins), ignore (old row wins), update (changes of the old row)."""
        n, now, keys = self.name(name), self.read(name), self.keys(name)
        new = self.shaped(name, df, columns)
        auto = next((c for c, e in self.extra.get(n, {}).items() if e.get("auto")), None)
        if not keys and not auto:
            return self.append(n, new)
        if not keys:
            out = now.union(new)
        elif mode == "ignore":
            first = self.latest(new, keys, -F.monotonically_increasing_id())
            out = now.union(first.join(now.select(*keys), keys, "left_anti").select(*now.columns))
        elif mode == "update":
            first = self.latest(new, keys)
            there = now.alias("t").join(first.alias("__new"), keys, "inner")
            touched = {c.lower(): u for c, u in (updates or {}).items()}
            stamp = {c: e["on_update"] for c, e in self.extra.get(n, {}).items() if e.get("on_update")}
            cols = [F.expr(self.qualified(touched[c.lower()], now.columns)).cast(now.schema[c].dataType).alias(c) if c.lower() in touched else (F.expr(stamp[c]).alias(c) if c in stamp else F.col(f"t.{c}")) for c in now.columns]
            out = now.join(first.select(*keys), keys, "left_anti").select(*now.columns).union(there.select(*cols)).union(first.join(now.select(*keys), keys, "left_anti").select(*now.columns))
        else:
            out = now.join(new.select(*keys), keys, "left_anti").select(*now.columns).union(self.latest(new, keys))
        before = now.count()
        self.replace(name, out)
        if auto:
            top = self.read(name).agg(F.max(auto)).first()[0]
            self.next[n] = int(top or 0) + 1
            self.publish(n)
        return self.read(name).count() - before

    @staticmethod
    def qualified(expression: str, columns: list[str]) -> str:
        """Bare column names mean the row that is there."""
        return re.sub(r"(?<![\w.])(" + "|".join(map(re.escape, columns)) + r")\b(?!\s*[.(])", r"t.\1", expression)

    def update(self, name: str, source: str, changes: dict, where: str, alias: str | None = None) -> int:
        """Rows of the table that the joined source and condition match once or more change, with the first match's values."""
        now, n = self.read(name), self.name(name)
        t = alias or n
        base = now.withColumn("__row", F.monotonically_increasing_id())
        path = f"{self.folder()}/{n}/{uuid.uuid4().hex}-rows"
        base.write.parquet(path)
        base = self.engine.spark.read.schema(base.schema).parquet(path)
        self.engine.view(n, base)
        stamp = {c: e["on_update"] for c, e in self.extra.get(n, {}).items() if e.get("on_update")}
        values = stamp | {c: v for c, v in changes.items()}
        picks = ", ".join(f"{v} AS `__v_{c}`" for c, v in values.items())
        hit = self.engine.run(f"SELECT {t}.__row AS __hit, {picks} FROM {source} WHERE {where}").dropDuplicates(["__hit"])
        both = base.join(hit, F.col("__row") == F.col("__hit"), "left")
        names = {c.lower(): c for c in values}
        cols = [F.when(F.col("__hit").isNotNull(), F.col(f"__v_{names[c.lower()]}").cast(now.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c.lower() in names else F.col(c) for c in now.columns]
        out, changed = both.select(*cols), hit.count()
        self.replace(name, out)
        return changed

    def delete(self, name: str, source: str, where: str, alias: str | None = None) -> int:
        now, n = self.read(name), self.name(name)
        base = now.withColumn("__row", F.monotonically_increasing_id())
        path = f"{self.folder()}/{n}/{uuid.uuid4().hex}-rows"
        base.write.parquet(path)
        base = self.engine.spark.read.schema(base.schema).parquet(path)
        self.engine.view(n, base)
        hit = self.engine.run(f"SELECT DISTINCT {alias or n}.__row AS __hit FROM {source} WHERE {where}")
        before = base.count()
        self.replace(name, base.join(hit, F.col("__row") == F.col("__hit"), "left_anti").select(*now.columns))
        return before - self.read(name).count()

    def materialize(self, name: str, text: str, dialect: str) -> None:
        self.views[self.name(name)] = (text, dialect)
        self.create(name, self.engine.sql(text, dialect))

    def refresh(self, name: str) -> None:
        """Builds the view's table beside the old one and swaps."""
        text, dialect = self.views[self.name(name)]
        self.replace(name, self.engine.sql(text, dialect))

    # Files in FROM.

    def path(self, path: str) -> str:
        kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
        return self.file({"csv": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet"}.get(kind, "parquet"), path, {})

    def file(self, kind: str, path: str, options: dict) -> str:
        from .files import read

        name = f"file_{uuid.uuid4().hex[:12]}"
        self.engine.view(name, read(self.engine.spark, kind, path, options))
        return name
