"""Counts over streams: top symbols, totals by level, comparison of two streams, sampling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, symbol: str, n: int) -> DataFrame:
    """The ``n`` symbols with most rows; equal counts by symbol."""
    return rows.groupBy(symbol).agg(F.count("*").alias("n")).orderBy(F.desc("n"), symbol).limit(n)


def totals(rows: DataFrame, record: str, symbol: str, value: str) -> DataFrame:
    """Count and sum by (record, symbol), by record, and of all."""
    return rows.groupingSets([[record, symbol], [record], []], record, symbol).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def compared(first: DataFrame, second: DataFrame, keys: list[str], payload: list[str], time: str) -> DataFrame:
    """Rows of each stream and key, those that both have (by payload and occurrence), and the sum of their delays in µs.

    The n-th occurrence of a payload in one stream meets the n-th in the other; a payload with many
    occurrences is numbered inside its key, and keys by payload are fine-grained.
    """
    w = Window.partitionBy(*keys, *payload).orderBy(time)
    a = first.select(*keys, *payload, F.col(time).alias("t1")).withColumn("k", F.row_number().over(w.orderBy("t1")))
    b = second.select(*keys, *payload, F.col(time).alias("t2")).withColumn("k", F.row_number().over(w.orderBy("t2")))
    both = a.join(b, [*keys, *payload, "k"], "full")
    delay = F.unix_micros(F.col("t2").cast("timestamp")) - F.unix_micros(F.col("t1").cast("timestamp"))
    return both.groupBy(*keys).agg(F.count("t1").alias("received1"), F.count("t2").alias("received2"), F.count(delay).alias("matched"), F.sum(delay).alias("delay_us"))


def common_length(first: list, second: list) -> int:
    """The length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    at: dict = {}
    for k, v in enumerate(second):
        at[v] = at.get(v, 0) | 1 << k
    whole = (1 << len(second)) - 1
    open_ = whole
    for v in first:
        met = open_ & at.get(v, 0)
        open_ = ((open_ + met) | (open_ - met)) & whole
    return len(second) - open_.bit_count()


def aligned(first: DataFrame, second: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """Number of rows of each key in the longest common subsequence of two streams.

    A key is one pair of sequences, as the measure asks for: its rows are in one task, and the work is
    their product over 64. ``compared`` is the form for keys of any size.
    """
    kind = first.schema[key].dataType.simpleString()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        # A side without rows has the key's column alone.
        x, y = (t.sort_by(order).column(payload).to_pylist() if payload in t.column_names else [] for t in (a, b))
        n = common_length(x, y)
        return pa.table([(a if x else b).column(key).slice(0, 1), pa.array([len(x)]), pa.array([len(y)]), pa.array([n])], names=[key, "received1", "received2", "matched"])

    cut = lambda t: t.select(key, payload, order)
    return cut(first).groupBy(key).cogroup(cut(second).groupBy(key)).applyInArrow(run, f"{key} {kind}, received1 long, received2 long, matched long")


def compared_totals(first: DataFrame, second: DataFrame, record: str, symbol: str, payload: list[str], time: str) -> DataFrame:
    """``compared`` by (record, symbol), by record and of all: also dropped shares in percent and the mean delay in µs."""
    each = compared(first, second, [record, symbol], payload, time)
    total = each.groupingSets([[record, symbol], [record], []], record, symbol).agg(*[F.sum(c).alias(c) for c in ("received1", "received2", "matched", "delay_us")])
    lost = lambda n: F.try_divide(F.lit(100.0) * (F.col(n) - F.col("matched")), F.col(n))
    return total.withColumn("dropped1", lost("received1")).withColumn("dropped2", lost("received2")).withColumn("mean_delay_us", F.try_divide(F.col("delay_us").cast("double"), F.col("matched")))


def dropped(rows: DataFrame, key: str, per_million: int) -> DataFrame:
    """Rows without those whose key's hash falls into the given share: the same rows each time."""
    head = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.where(head % 1_000_000 >= per_million)


def described(rows: DataFrame, record: str, symbol: str, values: list[str]) -> DataFrame:
    """Of each record: rows, symbols, and of each value its least, greatest, missing and zero ones."""
    each = [x for v in values for x in (F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.count_if(F.col(v).isNull()).alias(f"{v}_missing"), F.count_if(F.col(v) == 0).alias(f"{v}_zero"))]
    return rows.groupBy(record).agg(F.count("*").alias("n"), F.count_distinct(symbol).alias("symbols"), *each)


def subscription_totals(subscription: DataFrame, record: str, symbol: str, category) -> DataFrame:
    """Unique symbols of each record and category."""
    return subscription.groupBy(F.col(record).alias("record"), category.alias("category")).agg(F.count_distinct(symbol).alias("symbols"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON line."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def field_statistics(rows: DataFrame, record: str, symbol: str, category) -> DataFrame:
    """Of each record and symbol category: rows, symbols, bytes of the rows as text and of their symbols, and bits a symbol takes by frequency."""
    text = F.octet_length(F.to_csv(F.struct(*rows.columns)))
    by = [F.col(record).alias("record"), category.alias("category")]
    each = rows.select(*by, F.col(symbol).cast("string").alias("s"), text.alias("b")).groupBy("record", "category", "s").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    # Entropy of counts n: log2(N) - sum(n log2 n) / N.
    total = each.groupBy("record", "category").agg(F.sum("n").alias("n"), F.count("*").alias("symbols"), F.sum("b").alias("bytes"), F.sum(F.col("n") * F.octet_length("s")).alias("symbol_bytes"), F.sum(F.col("n") * F.log2("n")).alias("h"))
    return total.select("record", "category", "n", "symbols", "bytes", "symbol_bytes", (F.log2("n") - F.col("h") / F.col("n")).alias("symbol_bits"))


def as_xml(rows: DataFrame, name: str = "event") -> DataFrame:
    """Each row as one XML element, line breaks and indents taken out."""
    return rows.select(F.regexp_replace(F.to_xml(F.struct(*rows.columns), {"rowTag": name}), r"\n\s*", "").alias("line"))
