"""Order-dependent sums and lookups that no single key can overload.

A window over a key puts the whole key into one task. These forms cut each key along its own order
into buckets (say, days): per-bucket totals are pre-aggregated, only they are summed up along a key,
and rows are then handled inside their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows up to and with this one.

    ``bucket`` must not decrease along ``order``; ``order`` must be total within a key.
    """
    rows = rows.withColumn("__b", bucket)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__b").agg(F.sum(value).alias("__t"))
    totals = totals.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__in", F.sum(value).over(inside)).join(totals, [*keys, "__b"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__before", "__in")


def numbered(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "n") -> DataFrame:
    """Adds ``name``: the row's place within its key, from 1."""
    return running(rows, keys, order, bucket, F.lit(1).cast("long"), name)


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str], bucket: Column) -> DataFrame:
    """``left`` with ``values`` of the key's last row in ``right`` at or before it in ``order``; null without one."""
    state = F.struct(*[F.col(v) for v in values])
    both = left.withColumn("__left", F.struct(*[F.col(c) for c in left.columns])).withColumn("__v", F.lit(None).cast(right.select(state).schema[0].dataType)).select(*keys, order, "__left", "__v")
    both = both.unionByName(right.select(*keys, order, F.lit(None).cast(both.schema["__left"].dataType).alias("__left"), state.alias("__v"))).withColumn("__b", bucket)
    ends = both.where("__v is not null").groupBy(*keys, "__b").agg(F.max_by("__v", order).alias("__v"))
    # The state at the end of each bucket is what the next ones begin with; buckets without left rows are still few rows a key.
    marks = both.select(*keys, "__b").distinct().join(ends, [*keys, "__b"], "left")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(*keys, "__b", F.last("__v", ignorenulls=True).over(before).alias("__start"))
    inside = Window.partitionBy(*keys, "__b").orderBy(order, F.col("__left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__now", F.last("__v", ignorenulls=True).over(inside)).where("__left is not null").join(marks, [*keys, "__b"])
    found = F.coalesce("__now", "__start")
    return out.select("__left.*", *[found[v].alias(v) for v in values])
