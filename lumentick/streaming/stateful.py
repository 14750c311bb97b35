"""Structured Streaming forms: windows with a watermark, last values, conflation, transactions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumentick.functions.filters import listed
from lumentick.operators.transactions import BEGIN, END, PENDING, REMOVE, SNIP


def event_time(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a time stamp with zone; session time is UTC."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def bars(ticks: DataFrame, period: str, late: str) -> DataFrame:
    """Bars of closed windows; ticks later than ``late`` are dropped."""
    at = F.struct("ts", "seq")
    return (
        event_time(ticks).withWatermark("ts", late).groupBy("symbol", F.window("ts", period).alias("w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("count"), F.sum("size").alias("volume"))
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "count", "volume")
    )


def last_values(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, for update mode."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def deduplicated(rows: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return event_time(rows).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def transactions(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, arrival, index, value, flags) as complete transactions deliver them, with ``snapshot`` and ``tx``.

    The state of a key is its open transaction: the rows that are not released yet.
    """
    kind = rows.schema[key].dataType.simpleString()
    held = "rows array<struct<arrival:long,idx:long,value:double,flags:int>>, partial boolean, seen boolean, tx long"
    out = f"{key} {kind}, arrival long, index long, value double, flags int, snapshot boolean, tx long"

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, partial, seen, tx = state.get if state.exists else ([], False, False, 0)
        pending = [tuple(x) for x in pending]
        got = pd.concat(list(parts)).sort_values("arrival")
        released = []
        for a, i, v, f in zip(got["arrival"], got["index"], got["value"], got["flags"]):
            f = int(f)
            if f & BEGIN:
                pending, partial, seen, tx = [], True, True, 0
            if seen and f & (END | SNIP):
                partial = False
            pending.append((int(a), int(i), float(v), f))
            if not partial and not f & PENDING:
                snapshot = seen and tx == 0
                rows = pending
                if snapshot:
                    last = {}
                    for r in pending:
                        last.pop(r[1], None)
                        if not r[3] & REMOVE:
                            last[r[1]] = r
                    rows = list(last.values())
                released += [(k[0], *r, snapshot, tx) for r in rows]
                pending, tx = [], tx + 1
        state.update(([tuple(r) for r in pending], partial, seen, tx))
        yield pd.DataFrame(released, columns=[key, "arrival", "index", "value", "flags", "snapshot", "tx"])

    cut = rows.select(key, "arrival", "index", F.col("value").cast("double").alias("value"), F.col("flags").cast("int").alias("flags"))
    return cut.groupBy(key).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


def snapshot_then_updates(stored: DataFrame, stream: DataFrame, deliver: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """A new reader first gets the stored rows, then each batch of the stream; after a restart only what is new."""
    stored_columns = stored.columns

    def batch(rows: DataFrame, number: int) -> None:
        if number == 0:
            deliver(stored)
        deliver(rows.select(*stored_columns))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listed_updates(stream: DataFrame, read_list: Callable[[], DataFrame], deliver: Callable[[DataFrame], None], checkpoint: str, symbol: str = "symbol") -> StreamingQuery:
    """Rows whose symbol is in a list that may change: each batch reads the list anew."""

    def batch(rows: DataFrame, number: int) -> None:
        deliver(listed(rows, read_list(), symbol))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def aligned_streams(first: DataFrame, second: DataFrame, keys: list[str], wait: str) -> DataFrame:
    """Rows of two streams that meet on ``keys`` within ``wait`` of each other; each stream waits for the other so long, not longer."""
    a = event_time(first).withWatermark("ts", wait).alias("a")
    b = event_time(second).withWatermark("ts", wait).alias("b")
    near = F.expr(f"b.ts between a.ts - interval {wait} and a.ts + interval {wait}")
    for k in keys:
        near = near & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, near)


def sticky(subscriptions: DataFrame, key: str, period: str) -> DataFrame:
    """Of subscription events (key, ts, active): windows of time in which a key counts as subscribed, its last event and ``period`` long."""
    return event_time(subscriptions).withWatermark("ts", period).where("active").groupBy(key, F.session_window("ts", period).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("from"), F.col("w.end").alias("until"), "n")


def clamped(rows: DataFrame, keys: list[str], order: list[str], time: str = "ts") -> DataFrame:
    """Late rows of a batch get the greatest time of the rows before them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(time, F.max(time).over(w))
