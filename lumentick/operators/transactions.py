"""Indexed events that come as snapshots and transactions, batch form.

Flags: BEGIN starts a snapshot, END or SNIP ends it, PENDING holds a transaction open, REMOVE deletes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING, REMOVE, BEGIN, END, SNIP = 1, 2, 4, 8, 16


def _has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) != 0


def released(rows: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """Rows that a complete transaction has delivered, with ``segment`` (snapshots begun so far), ``tx`` and ``snapshot``.

    Within a segment a row that is not PENDING, once the snapshot has been closed, releases all before it.
    Rows of an unfinished snapshot or transaction are discarded.
    """
    order = Window.partitionBy(*keys).orderBy(arrival)
    t = rows.withColumn("segment", F.sum(_has(BEGIN).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "segment").orderBy(arrival)
    closed = (F.col("segment") == 0) | (F.max(_has(END) | _has(SNIP)).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("__release", (closed & ~_has(PENDING)).cast("long"))
    t = t.withColumn("__later", F.sum("__release").over(within.rowsBetween(0, Window.unboundedFollowing))).where("__later > 0")
    t = t.withColumn("tx", F.coalesce(F.sum("__release").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return t.withColumn("snapshot", (F.col("segment") > 0) & (F.col("tx") == 0)).drop("__release", "__later")


def _last(t: DataFrame, keys: list[str], index: str, arrival: str) -> DataFrame:
    w = Window.partitionBy(*keys, index).orderBy(F.col(arrival).desc())
    return t.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delivered(rows: DataFrame, keys: list[str], index: str = "index", arrival: str = "arrival") -> DataFrame:
    """What listeners get: of a snapshot the last row of each index without removed ones, updates as they are."""
    t = released(rows, keys, arrival)
    w = Window.partitionBy(*keys, "segment", "tx", index).orderBy(F.col(arrival).desc())
    t = t.withColumn("__n", F.row_number().over(w))
    return t.where(~F.col("snapshot") | ((F.col("__n") == 1) & ~_has(REMOVE))).drop("__n")


def final(rows: DataFrame, keys: list[str], index: str = "index", arrival: str = "arrival") -> DataFrame:
    """The list at the end: of the last segment that delivered anything, each index's last row unless removed."""
    t = released(rows, keys, arrival)
    t = t.withColumn("__last", F.max("segment").over(Window.partitionBy(*keys))).where("segment = __last").drop("__last")
    return _last(t, keys, index, arrival).where(~_has(REMOVE)).select(*rows.columns)


def indexed_list(rows: DataFrame, keys: list[str], index: str = "index", arrival: str = "arrival", source: str | None = None, most: int | None = None) -> DataFrame:
    """The indexed events of each key as a model shows them: snapshots clear a source, flags are zeroed, ``position`` is by (source, index).

    Beyond ``most`` entries the first ones (of the least index) are dropped.
    """
    own = [*keys, *([source] if source else [])]
    t = final(rows, own, index, arrival).withColumn("flags", F.lit(0))
    if most is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ([source] if source else [])], F.col(index).desc())
        t = t.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    place = Window.partitionBy(*keys).orderBy(*([source] if source else []), index)
    return t.withColumn("position", F.row_number().over(place).cast("long"))


def time_series_list(rows: DataFrame, keys: list[str], time: str, from_time: Column, arrival: str = "arrival", most: int | None = None) -> DataFrame:
    """The same ordered by time, of times from ``from_time`` on."""
    return indexed_list(rows.where(F.col(time) >= from_time), keys, time, arrival, None, most)
