"""Streaming forms against their batch forms on closed windows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumentick.operators import bars, contracts, transactions
from lumentick.streaming import stateful

from .test_operators import flag


def through(spark, df, path, make, mode="append"):
    """The rows that a stream over ``df``, in two files, has put out when all is read."""
    df.coalesce(1).write.mode("append").parquet(path)
    stream = make(spark.readStream.schema(df.schema).parquet(path))
    name = f"t{abs(hash(path)) % 10**9}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_closed_windows(spark, tmp_path):
    rng = random.Random(1)
    data = [("S", datetime(2024, 1, 1) + timedelta(seconds=7 * i), i, float(rng.randrange(100)), 1.0) for i in range(300)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, seq long, price double, size double")
    got = through(spark, df, f"{tmp_path}/a", lambda s: stateful.bars(s, "1 minute", "10 seconds")).withColumn("start", F.col("start").cast("timestamp_ntz"))
    want = {r["start"]: (r["open"], r["high"], r["low"], r["close"], r["count"]) for r in bars.time_bars(df, 60).collect()}
    rows = got.collect()
    assert len(rows) >= len(want) - 2
    assert all(want[r["start"]] == (r["open"], r["high"], r["low"], r["close"], r["count"]) for r in rows)


def test_last_values(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i, float(i)) for i in range(60)], "k long, seq long, v double")
    got = through(spark, df, f"{tmp_path}/b", lambda s: stateful.last_values(s, ["k"], ["seq"]), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, contracts.ticker_last(df, ["k"], ["seq"]).collect()))


def test_transactions(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, i, rng.randrange(5), float(i), flag(rng)) for s in range(10) for i in range(25)]
    df = spark.createDataFrame(rows, "symbol long, arrival long, index long, value double, flags int")
    got = through(spark, df, f"{tmp_path}/c", lambda s: stateful.transactions(s, "symbol"))
    want = transactions.delivered(df, ["symbol"]).select("symbol", "arrival", "snapshot", "tx")
    assert sorted(map(tuple, got.select("symbol", "arrival", "snapshot", "tx").collect())) == sorted(map(tuple, want.collect()))
