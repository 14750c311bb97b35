"""The calls of a market-data client over stored rows (record, symbol, ts, seq, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumentick.operators import contracts, transactions


def last_events(rows: DataFrame, wanted: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each wanted key with its last row; a key without any stays, with nulls."""
    few = rows.join(wanted.select(*keys).distinct(), keys, "left_semi")
    return wanted.join(contracts.ticker_last(few, keys, order), keys, "left")


def last_events_if_subscribed(rows: DataFrame, wanted: DataFrame, subscription: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only wanted keys that are subscribed: with their last row, or nulls where nothing has come yet."""
    return last_events(rows, wanted.join(subscription.select(*keys).distinct(), keys, "left_semi"), keys, order)


def time_series(rows: DataFrame, symbol: Column, time: str, start: Column, end: Column, remove: Column, flags: str | None = None, complete: Column | None = None) -> DataFrame:
    """A symbol's rows of the inclusive range, removals left out and flags zeroed; only where ``complete`` says that the snapshot is."""
    out = rows.where(symbol & F.col(time).between(start, end) & ~remove)
    out = out if complete is None else out.where(complete)
    return out if flags is None else out.withColumn(flags, F.lit(0).cast(rows.schema[flags].dataType))


def time_series_if_subscribed(rows: DataFrame, subscription: DataFrame, keys: list[str], time: str, start: Column, end: Column, remove: Column) -> DataFrame:
    """The rows at hand of subscribed keys, whether or not their snapshot is complete."""
    return time_series(rows.join(subscription.select(*keys).distinct(), keys, "left_semi"), F.lit(True), time, start, end, remove)


def indexed_events_if_subscribed(rows: DataFrame, subscription: DataFrame, keys: list[str], index: str = "index", arrival: str = "arrival") -> DataFrame:
    """The last row at hand of each index of subscribed keys, removals left out, without the guarantee of a snapshot."""
    own = rows.join(subscription.select(*keys).distinct(), keys, "left_semi")
    return contracts.history(own, keys, index, [arrival], F.col("flags").bitwiseAND(transactions.REMOVE) != 0)


def field_value(rows: DataFrame, wanted: DataFrame, keys: list[str], order: list[str], field: str) -> DataFrame:
    """One field of the wanted keys' last rows; 0 (numbers) or null where there is none."""
    last = last_events(rows.select(*dict.fromkeys([*keys, *order, field])), wanted.select(*keys), keys, order)
    zero = F.coalesce(F.col(field), F.lit(0).cast(rows.schema[field].dataType)) if isinstance(rows.schema[field].dataType, T.NumericType) else F.col(field)
    return last.select(*keys, zero.alias(field))


def events(rows: DataFrame, subscription: DataFrame, record: str, symbol: str, time: str, start: Column, end: Column, source: str | None = None) -> DataFrame:
    """What a query of event types, symbols (and sources) between two times answers, with a ``status``.

    ``subscription`` has (record, symbol[, source]); asked pairs without rows in the range give one row of
    nulls with TIMED_OUT, the others OK.
    """
    on = [record, symbol, *([source] if source else [])]
    asked = subscription.select(F.col("record").alias(record), F.col("symbol").alias(symbol), *([F.col("source").alias(source)] if source else [])).distinct()
    found = rows.where(F.col(time).between(start, end)).withColumn("status", F.lit("OK"))
    return asked.join(found, on, "left").withColumn("status", F.coalesce("status", F.lit("TIMED_OUT")))


def observed(subscription: DataFrame, record: str = "record", symbol: str = "symbol") -> DataFrame:
    """What a publisher sees: each wanted (record, symbol) with the number of readers."""
    return subscription.groupBy(record, symbol).agg(F.count("*").alias("readers"))


def overflowed(rows: DataFrame, keys: list[str], order: list[str], most: int, policy: str = "DROP_OLDEST") -> DataFrame:
    """A reader's buffer of ``most`` rows a key when all have come: the newest or (DROP_NEWEST) the oldest, with ``dropped`` of the key."""
    newest = policy == "DROP_OLDEST"
    w = Window.partitionBy(*keys)
    t = rows.withColumn("__n", F.row_number().over(w.orderBy(*[F.col(c).desc() if newest else F.col(c) for c in order]))).withColumn("dropped", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return t.where(F.col("__n") <= most).drop("__n")


def dumped(rows: DataFrame, record: str, stamp: str | None = None) -> DataFrame:
    """Rows as text lines: record and fields with tabs between them, a time before them on request."""
    rest = [c for c in rows.columns if c not in (record, stamp)]
    parts = [*([F.date_format(stamp, "yyyyMMdd-HHmmss.SSS")] if stamp else []), F.col(record), *[F.coalesce(F.col(c).cast("string"), F.lit("NaN" if t == "double" else "")) for c, t in rows.select(*rest).dtypes]]
    return rows.select(F.concat_ws("\t", *parts).alias("line"))


def converted(rows: DataFrame, path: str, records: dict[str, list[str]], record: str = "record") -> None:
    """A tape's rows as typed events, one folder a record with the fields that it has."""
    for name, names in records.items():
        rows.where(F.col(record) == name).select(*names).write.mode("overwrite").parquet(f"{path}/{name}")


def indexed_events(rows: DataFrame, keys: list[str], symbol: Column) -> DataFrame:
    """The complete indexed list of the chosen keys, ordered by ``position``, flags zeroed."""
    return transactions.indexed_list(rows.where(symbol), keys)


def as_of(rows: DataFrame, keys: list[str], order: list[str], at: Column) -> DataFrame:
    """Last values as they stood at a time."""
    return contracts.ticker_last(rows.where(F.col(order[0]) <= at), keys, order)


def delayed(rows: DataFrame, time: str, seconds: int) -> DataFrame:
    return rows.withColumn(time, F.col(time) + F.expr(f"make_dt_interval(0, 0, 0, {seconds})"))


def merged_feeds(*feeds: DataFrame) -> DataFrame:
    """Several feeds as one; columns that a feed lacks are null."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
