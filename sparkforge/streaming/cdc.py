"""Change streams: micro-batches merged by key into a store table, each batch once."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Store


def merge(store: Store, table: str, changes: DataFrame, keys: list[str], order: str, operation: str | None = None, batch: tuple[str, int] | None = None) -> None:
    """The newest change of each key wins; operation 'd' deletes, anything else upserts.

    Where the table has the order column, a change that is older than the stored row changes nothing, whichever batch it
    comes in. A deleted row leaves no trace, so a change that comes after its deletion counts as new. Null keys equal.

    batch: the stream's name and the batch's number, which the table's pointer keeps with the version that holds the batch.
    One that is in already, by a driver that failed before its checkpoint was written, is left out.
    """
    done = store.batches.setdefault(Store.name(table), {})
    if batch:
        if batch[1] <= done.get(batch[0], -1):
            return
    last = Store.latest(changes, keys, F.col(order))
    now = store.read(table)

    if order in now.columns:
        held = now.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(order).alias("__held"))
        last = last.join(held, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)) & (F.col("__held") > F.col(order)), "left_anti")
    kept = now.join(last.select(*(F.col(k).alias(f"__{k}") for k in keys)), reduce(and_, (now[k].eqNullSafe(F.col(f"__{k}")) for k in keys)), "left_anti").select(*now.columns)
    new = last.where(F.coalesce(F.lower(F.col(operation)), F.lit("u")) != "d") if operation else last
    before = done.get(batch[0]) if batch else None
    if batch:
        done[batch[0]] = batch[1]
    try:
        store.replace(table, kept.unionByName(new.select(*now.columns)))
    except BaseException:
        if batch:
            done.pop(batch[0])
            done.update({} if before is None else {batch[0]: before})
        raise


def upsert_stream(stream: DataFrame, store: Store, table: str, keys: list[str], order: str, operation: str | None = None, name: str = "cdc", checkpoint: str | None = None):
    """Starts the query; its batches are merged one after the other, each once for a name and checkpoint."""

    def batch(df: DataFrame, number: int) -> None:
        merge(store, table, df, keys, order, operation, (f"{name} {checkpoint}", number) if checkpoint else None)

    writer = stream.writeStream.queryName(name).foreachBatch(batch)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


class Staged:
    """XA-like branches: writes are kept by id until they are committed; committing an unknown id does nothing.

    A prepared branch is a file of the store, so that it outlives the driver; a commit that failed on its way can be given
    again and then runs all its statements again.
    """

    def __init__(self, engine):
        self.engine, self.open = engine, {}

    def path(self, xid: str) -> str:
        return f"{self.engine.store.folder()}/_branches/{quote(xid, safe='')}"

    def start(self, xid: str) -> None:
        self.open[xid] = []

    def write(self, xid: str, sql: str) -> None:
        self.open[xid].append(sql)

    def prepare(self, xid: str) -> None:
        self.engine.store.put(self.path(xid), json.dumps(self.open[xid]))
        self.open.pop(xid)

    def commit(self, xid: str) -> None:
        if xid in self.recover():
            for sql in json.loads(self.engine.store.get(self.path(xid))):
                self.engine.sql(sql)
            self.engine.store.remove(self.path(xid))

    def rollback(self, xid: str) -> None:
        self.engine.store.remove(self.path(xid))
        self.open.pop(xid, None)

    def recover(self) -> list[str]:
        return sorted(map(unquote, self.engine.store.names(f"{self.engine.store.folder()}/_branches")))


def bucketed(stream: DataFrame, at: str, width: str, late: str, by: list[str], **aggregates) -> DataFrame:
    """Tumbling windows over an event time, in batch or stream; rows later than `late` are left out of a stream."""
    rows = stream.withWatermark(at, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(at, width), *by).agg(*(F.expr(v).alias(k) for k, v in aggregates.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *aggregates)
