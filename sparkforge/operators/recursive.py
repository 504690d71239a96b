"""WITH RECURSIVE. UNION ALL is Spark's own; UNION (distinct) is a driver loop over rounds of new rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import Rewriter, SqlError, find, low, split, text_of

ROUNDS = 1000


def fixpoint(anchor: DataFrame, step, rounds: int = ROUNDS) -> DataFrame:
    """All rows that step reaches from anchor, each once. A round works on the rows that the last one found.

    Rounds are written to the shared folder: that cuts lineage, survives lost executors, and keeps each round's input
    from being computed again.
    """
    spark = anchor.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        import atexit
        import shutil
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="sparkforge-rounds-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
    base = f"{root.rstrip('/')}/recursive-{uuid.uuid4().hex}"

    def keep(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{base}/{k}")
        return spark.read.schema(anchor.schema).parquet(f"{base}/{k}")

    fresh = keep(anchor.distinct(), 0)
    for k in range(1, rounds + 1):
        found = step(fresh).toDF(*anchor.columns)
        found = found.select(*(F.col(c).cast(anchor.schema[c].dataType).alias(c) for c in anchor.columns))
        every = spark.read.schema(anchor.schema).parquet(*(f"{base}/{i}" for i in range(k)))
        fresh = keep(found.distinct().subtract(every), k)
        if fresh.isEmpty():
            return every
    raise SqlError(f"the recursion has more than {rounds} rounds")


def run_with(engine, nodes: list, dialect: str) -> DataFrame | None:
    """Runs WITH RECURSIVE whose recursive members use UNION (distinct); None where there is none."""
    at = 2
    defs = []
    while True:
        name, at = nodes[at], at + 1
        columns = None
        if isinstance(nodes[at], list):
            columns, at = [text_of(c) for c in split(nodes[at][1:-1])], at + 1
        if low(nodes[at]) != "as":
            return None
        body, at = nodes[at + 1][1:-1], at + 2
        defs.append((name, columns, body))
        if at < len(nodes) and nodes[at] == ",":
            at += 1
            continue
        break

    def distinct_union(body: list) -> int:
        u = find(body, "union")
        return u if u >= 0 and low(body[u + 1]) != "all" else -1

    def mentions(body, name) -> bool:
        return any(mentions(x, name) if isinstance(x, list) else x.lower() == name.lower() for x in body)

    recursive = [d for d in defs if distinct_union(d[2]) >= 0 and mentions(d[2][distinct_union(d[2]) :], d[0])]
    if not recursive:
        return None
    for name, columns, body in defs:
        r = Rewriter(dialect, engine.variables, engine.store)
        u = distinct_union(body)
        if u >= 0 and mentions(body[u:], name):
            anchor = engine.run(text_of(r.query(body[:u])))
            if columns:
                anchor = anchor.toDF(*columns)
            step = text_of(r.query(body[u + 1 :]))

            def rounds(df: DataFrame, name=name, step=step) -> DataFrame:
                engine.view(name, df)
                return engine.run(step)

            engine.view(name, fixpoint(anchor, rounds))
        else:
            df = engine.run(text_of(r.query(body)))
            engine.view(name, df.toDF(*columns) if columns else df)
    return engine.run(text_of(Rewriter(dialect, engine.variables, engine.store).query(nodes[at:])))
