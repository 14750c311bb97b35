"""Delivery contracts over ordered rows: last value, every event, history.

Arrival order is always an explicit column. Subscriptions are DataFrames of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running

#: Rows kept for each key unless told otherwise.
RETENTION = {"candle": 8000, "time_series": 1000}


def ticker_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; ``order`` is the arrival order and must be total within a key.

    The aggregate combines before the shuffle, so a hot key sends one row a task.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r")) if _orderable(rows, rest) else rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__r"))
    return newest.select(*[c if c in keys else F.col("__r")[c].alias(c) for c in rows.columns])


def _orderable(rows: DataFrame, columns: list[str]) -> bool:
    return all(rows.schema[c].dataType.typeName() not in ("map", "variant") for c in columns)


def ticker_changes(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows that differ from the key's row before them; the first row of a key always does."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    return rows.withColumn("__p", F.lag(now).over(w)).where(~F.col("__p").eqNullSafe(now)).drop("__p")


def subscribed(rows: DataFrame, subscription: DataFrame, record: str = "record", symbol: str = "symbol", wildcard: str = "*") -> DataFrame:
    """Every row that some subscription (record, symbol) asks for, once; the wildcard symbol asks for all of a record."""
    exact = subscription.where(F.col("symbol") != wildcard).select(F.col("record").alias(record), F.col("symbol").alias(symbol)).distinct()
    whole = subscription.where(F.col("symbol") == wildcard).select(F.col("record").alias(record), F.lit(True).alias("__all")).distinct()
    marked = rows.join(whole, record, "left").join(exact.withColumn("__one", F.lit(True)), [record, symbol], "left")
    return marked.where(F.col("__all") | F.col("__one")).select(*rows.columns)


def subscribed_from(rows: DataFrame, subscription: DataFrame, key: str, time: str, from_time: str = "from_time") -> DataFrame:
    """Rows of subscribed keys from the subscription's time on; the earliest of a key's subscriptions counts."""
    first = subscription.groupBy(key).agg(F.min(from_time).alias("__from"))
    return rows.join(first, key).where(F.col(time) >= F.col("__from")).select(*rows.columns)


def removed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose keys are not among ``keys``."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def history(rows: DataFrame, keys: list[str], time: str, arrival: list[str], remove: Column | None = None) -> DataFrame:
    """One row for each (key, time): the last to arrive; where that is a removal, none."""
    last = ticker_last(rows if remove is None else rows.withColumn("__gone", remove), [*keys, time], arrival)
    return last if remove is None else last.where(~F.col("__gone")).drop("__gone")


def retained(rows: DataFrame, keys: list[str], time: list[str], most: int) -> DataFrame:
    """The newest ``most`` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in time])
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def scanned(rows: DataFrame, keys: list[str], time: str, start: Column, end: Column, descending: bool = False) -> DataFrame:
    """Rows with time in the inclusive range, with their place ``position`` in the direction of the scan."""
    inside = rows.where(F.col(time).between(start, end) if not descending else F.col(time).between(end, start))
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc() if descending else F.col(time))
    return inside.withColumn("position", F.row_number().over(w).cast("long"))


def available(rows: DataFrame, keys: list[str], time: str, start: Column, end: Column, wanted: DataFrame | None = None) -> DataFrame:
    """Least and greatest time of each key, and the number of rows in the inclusive range; zeros for ``wanted`` keys without rows."""
    found = rows.groupBy(*keys).agg(F.min(time).alias("min_time"), F.max(time).alias("max_time"), F.count_if(F.col(time).between(start, end)).alias("available"))
    if wanted is None:
        return found
    return wanted.select(*keys).distinct().join(found, keys, "left").fillna(0, ["min_time", "max_time", "available"])


def examined(rows: DataFrame, subscription: DataFrame | None = None, record: str = "record", symbol: str = "symbol") -> DataFrame:
    """All stored rows, or those that a subscription asks for."""
    return rows if subscription is None else subscribed(rows, subscription, record, symbol)


def stored_rows(rows: DataFrame, subscription: DataFrame, everything: Column | None = None, record: str = "record", symbol: str = "symbol") -> DataFrame:
    """What is kept without a reader: rows that a subscription asks for, and those that the ``everything`` condition holds for.

    A key without a subscription and outside the condition loses its state.
    """
    if everything is None:
        return subscribed(rows, subscription, record, symbol)
    kept = F.coalesce(everything, F.lit(False))
    return rows.where(kept).unionByName(subscribed(rows.where(~kept), subscription, record, symbol))


def timed(rows: DataFrame, records: DataFrame, record: str = "record") -> DataFrame:
    """Rows of records that have a time coordinate (``records``: record, has_time); a history ignores the others."""
    return rows.join(records.where("has_time").select(F.col("record").alias(record)).distinct(), record, "left_semi")


def history_of_last(rows: DataFrame, keys: list[str], order: list[str], from_time: Column | None = None) -> DataFrame:
    """A history of one row a key, its last value; none if that is older than ``from_time``."""
    last = ticker_last(rows, keys, order)
    return last if from_time is None else last.where(F.col(order[0]) >= from_time)


def stream_of(rows: DataFrame, keys: list[str], order: list[str], conflate: bool = False, values: list[str] | None = None) -> DataFrame:
    """A stream made from another contract: every row as it is, or (conflated) only changes of a key's value."""
    return ticker_changes(rows, keys, order, values or [c for c in rows.columns if c not in keys and c not in order]) if conflate else rows


def changed_subscription(now: DataFrame, added: DataFrame | None = None, removed_: DataFrame | None = None, on: tuple[str, ...] = ("record", "symbol")) -> DataFrame:
    """A subscription with symbols added, then others removed; each once."""
    out = now.select(*on) if added is None else now.select(*on).union(added.select(*on))
    out = out.distinct()
    return out if removed_ is None else out.join(removed_.select(*on).distinct(), list(on), "left_anti")


def snapshots(rows: DataFrame, keys: list[str], arrival: str, begin: Column, snip: Column, time: str, remove: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """What a history holds in the end, where BEGIN starts a snapshot anew and SNIP ends it early.

    A snapshot comes from its newest time downwards. It sweeps what is stored at later times than its
    least one so far and isn't sent again; times below stay. A SNIP drops everything older than its own time.
    A row that arrives last for its time and is a removal leaves nothing.

    A row is swept by any later snapshot that has come down below its time, so the least of the later
    snapshots' least times decides: one row a snapshot is summed up along a key, from its end. With
    ``bucket`` (not decreasing along ``arrival``) a hot key is cut for the numbering of snapshots, too.
    """
    t = rows.withColumn("__begin", begin.cast("long")).withColumn("__snip", F.when(snip, F.col(time))).withColumn("__gone", F.lit(False) if remove is None else remove)
    t = running(t, keys, [arrival], F.lit(0) if bucket is None else bucket, F.col("__begin"), "__s")
    after = Window.partitionBy(*keys).orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = t.groupBy(*keys, "__s").agg(F.min(time).alias("__low"), F.max("__snip").alias("__high"))
    spans = spans.select(*keys, "__s", F.min("__low").over(after).alias("__swept"), F.max("__high").over(after).alias("__cut"))
    within = Window.partitionBy(*keys, "__s").orderBy(F.col(arrival).desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = ticker_last(t.withColumn("__own", F.max("__snip").over(within)), [*keys, time], [arrival]).join(spans, [*keys, "__s"])
    stays = F.coalesce(F.col(time) <= F.col("__swept"), F.lit(True)) & F.coalesce(F.col(time) >= F.col("__cut"), F.lit(True)) & F.coalesce(F.col(time) >= F.col("__own"), F.lit(True))
    return last.where(stays & ~F.col("__gone")).select(*rows.columns)


def transactions(rows: DataFrame, keys: list[str], arrival: str, pending: Column) -> DataFrame:
    """Adds ``tx``: the number of rows before this one that closed a transaction (those not pending)."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("tx", F.coalesce(F.sum((~pending).cast("long")).over(before), F.lit(0)).cast("long"))
