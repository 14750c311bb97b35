"""Bars, slices and conflation of ticks (symbol, ts, seq, price, size)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import ticker_last
from .ordering import numbered, running


def slice_start(ts: str, seconds: int) -> Column:
    """floor(ts / period) * period, for time stamps without zone."""
    since = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(since / F.lit(seconds)) * F.lit(seconds)).cast("timestamp_ntz")


def ohlc(ticks: DataFrame, *keys: str) -> DataFrame:
    """Open, high, low, close, count, volume and VWAP of each group, in the order of (ts, seq)."""
    at, value = F.struct("ts", "seq"), F.col("price") * F.col("size")
    return ticks.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("count"),
        F.sum("size").alias("volume"), F.coalesce(F.try_divide(F.sum(value), F.sum("size")), F.lit(0.0)).alias("vwap"),
    )


def time_bars(ticks: DataFrame, seconds: int) -> DataFrame:
    return ohlc(ticks.withColumn("start", slice_start("ts", seconds)), "symbol", "start")


def tick_bars(ticks: DataFrame, n: int, bucket: Column) -> DataFrame:
    """Bars of ``n`` ticks each."""
    at = numbered(ticks, ["symbol"], ["ts", "seq"], bucket, "__n")
    return ohlc(at.withColumn("bar", F.floor((F.col("__n") - 1) / n)), "symbol", "bar")


def volume_bars(ticks: DataFrame, volume: float, bucket: Column) -> DataFrame:
    """Bars of ``volume`` each; a tick belongs to the bar in which its first share falls."""
    at = running(ticks, ["symbol"], ["ts", "seq"], bucket, F.col("size"), "__v")
    return ohlc(at.withColumn("bar", F.floor((F.col("__v") - F.col("size")) / F.lit(volume)).cast("long")), "symbol", "bar")


def level_bars(ticks: DataFrame, seconds: int, width: float) -> DataFrame:
    """Time bars of each price corridor of ``width``."""
    level = F.floor(F.col("price") / F.lit(width)) * F.lit(width)
    return ohlc(ticks.withColumn("start", slice_start("ts", seconds)).withColumn("level", level), "symbol", "start", "level")


def session_bars(ticks: DataFrame, sessions: DataFrame, seconds: int) -> DataFrame:
    """Bars aligned to the start of the session that holds the tick; ticks outside every session are left out.

    ``sessions`` has (day, open, close), any number a day; of sessions that overlap the earliest counts.
    """
    plan = sessions.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("open", "close"))).alias("__all"))
    ts = F.col("ts")
    held = ticks.withColumn("day", F.to_date("ts")).join(plan, "day").withColumn("__s", F.get(F.filter("__all", lambda x: (ts >= x["open"]) & (ts < x["close"])), F.lit(0))).where("__s is not null")
    opened = F.unix_seconds(F.col("__s.open").cast("timestamp"))
    since = F.unix_seconds(ts.cast("timestamp")) - opened
    start = F.timestamp_seconds(opened + F.floor(since / F.lit(seconds)) * F.lit(seconds)).cast("timestamp_ntz")
    return ohlc(held.withColumn("start", start).drop("__all", "__s"), "symbol", "start")


def tick_candles(ticks: DataFrame) -> DataFrame:
    """Each trade as its own candle; the index is (seconds << 32) | sequence."""
    index = F.unix_seconds(F.col("ts").cast("timestamp")) * F.lit(1 << 32) + F.col("seq")
    return ticks.select("symbol", index.alias("index"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("long").alias("count"), F.col("size").alias("volume"))


def filled_slices(ticks: DataFrame, seconds: int) -> DataFrame:
    """VWAP, volume and cumulative volume of each slice from a symbol's first to its last, empty ones included."""
    bars = ticks.withColumn("start", slice_start("ts", seconds)).groupBy("symbol", "start").agg(F.sum("size").alias("v"), F.sum(F.col("price") * F.col("size")).alias("pv"))
    span = bars.groupBy("symbol").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    step = F.expr(f"make_dt_interval(0, 0, 0, {seconds})")
    grid = span.select("symbol", F.explode(F.sequence("a", "b", step)).alias("start"))
    t = grid.join(bars, ["symbol", "start"], "left").fillna(0.0, ["v", "pv"])
    so_far = Window.partitionBy("symbol").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("symbol", "start", F.col("v").alias("volume"), F.coalesce(F.try_divide("pv", "v"), F.lit(0.0)).alias("vwap"), F.sum("v").over(so_far).alias("total_volume"))


def conflated(rows: DataFrame, keys: list[str], order: list[str], seconds: int) -> DataFrame:
    """At most one row of each key a period: the latest."""
    return ticker_last(rows.withColumn("period", slice_start(order[0], seconds)), [*keys, "period"], order)


def _price_bars(kind: str, size: float):
    """Bars driven by price, for one symbol's ticks in order.

    range: high - low = size, the next bar opens at the close; momentum: it opens one ``tick`` further on;
    renko: bricks of ``size``, a turn needs twice as much.
    """

    def fold(ticks: Iterator[tuple[float, int]]) -> Iterator[tuple]:
        opened = None
        for p, s in ticks:
            if opened is None:
                opened = low = high = p
                n, first, bar, trend = 0, s, 0, 0
            n += 1
            if kind == "renko":
                while abs(p - opened) >= size * (2 if trend and (p > opened) != (trend > 0) else 1):
                    step = size if p > opened else -size
                    start = opened + step if trend and (step > 0) != (trend > 0) else opened
                    yield bar, first, start, max(start, start + step), min(start, start + step), start + step, n
                    opened, trend, bar, n, first = start + step, (1 if step > 0 else -1), bar + 1, 0, s
                continue
            while p - low >= size or high - p >= size:
                up = p - low >= size
                close = low + size if up else high - size
                yield bar, first, opened, max(high, close), min(low, close), close, n
                opened = close + (0.0 if kind == "range" else (size / 10 if up else -size / 10))
                bar, n, first, low, high = bar + 1, 0, s, opened, opened
            low, high = min(low, p), max(high, p)

    return fold


#: Bars of an output batch.
BATCH = 10_000
PRICE_BARS = "symbol string, bar long, seq long, open double, high double, low double, close double, count long"


def price_bars(ticks: DataFrame, kind: str, size: float) -> DataFrame:
    """Bars of kind ``range``, ``momentum`` or ``renko``: each bar depends on the one before, so a symbol is one sequence.

    Spark sorts it (on disk where need be) and it passes through its task in batches, with one bar's state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("symbol", "price", "seq"))))
        made = ((symbol, *bar) for symbol, own in groupby(rows, itemgetter(0)) for bar in _price_bars(kind, size)((p, s) for _, p, s in own))
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds)], names=[x.split()[0] for x in PRICE_BARS.split(", ")])

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int64()]
    valid = ticks.select("symbol", "ts", F.col("seq").cast("long").alias("seq"), F.col("price").cast("double").alias("price")).where("price is not null and not isnan(price)")
    return valid.repartition("symbol").sortWithinPartitions("symbol", "ts", "seq").mapInArrow(run, PRICE_BARS)
