"""Operators without SQL, against plain versions and invariants."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumentick.functions import calendar, candles, codes, fields, filters, lists, prices, symbols, times
from lumentick.operators import analysis, bars, book, contracts, ordering, profiles, transactions
from lumentick.plans import feed
from lumentick.sources import tapes


def values(spark, column, *inputs):
    df = spark.createDataFrame([(x,) for x in inputs], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_globs(spark):
    assert values(spark, lambda c: filters.glob(c, ".*"), ".OPRA", "IBM", "*") == [True, False, True]
    assert values(spark, lambda c: filters.glob(c, ".[A-K]*"), ".ABBA", ".K", ".Z", ".L") == [True, True, False, False]
    assert values(spark, lambda c: filters.glob(c, "!A*"), "AB", "B") == [False, True]
    for bad in ("**", "*a*b*", "ibm*"):
        with pytest.raises(ValueError):
            filters.glob(F.lit("x"), bad)


def test_hash_groups_cover_all(spark):
    got = values(spark, lambda c: filters.hash_group(c, 16), *[f"SYM{i}" for i in range(400)])
    assert set(got) == set(range(16))
    assert values(spark, filters.java_hash, "IBM", "") == [(ord("I") * 31 + ord("B")) * 31 + ord("M"), 0]
    assert values(spark, lambda c: filters.range_stripe(c, ["G", "P"]), "ABC", "GOOG", "MSFT", "TSLA") == [0, 1, 1, 2]


def test_price_increments(spark):
    df = spark.createDataFrame([(0.1234,), (-0.1234,), (1.0,), (5.0,)], "p double")
    p = F.col("p")
    got = df.select(*[prices.rounded(p, "0.01", d) for d in (0, 1, -1)]).collect()
    assert [tuple(r) for r in got[:2]] == [(0.12, 0.13, 0.12), (-0.12, -0.12, -0.13)]
    two = df.select(*[prices.increment(p, "0.0001 1; 0.01", d) for d in (0, 1, -1)], prices.precision(p, "0.0001 1; 0.01")).collect()
    assert tuple(two[2]) == (0.0001, 0.01, 0.0001, 4) and tuple(two[3]) == (0.01, 0.01, 0.01, 2)
    assert df.select(prices.stepped(p, "0.5", 1)).collect()[3][0] == 5.5
    assert df.select(prices.rounded(p, "")).collect()[0][0] == 0.1234


def test_symbols(spark):
    assert values(spark, symbols.base_symbol, "SPY&N{=5m}", "SPY", "A&B") == ["SPY", "SPY", "A"]
    assert values(spark, lambda c: symbols.with_exchange(c, "Q"), "SPY&N{=5m}", "SPY") == ["SPY&Q{=5m}", "SPY&Q"]
    assert values(spark, lambda c: symbols.with_attribute(c, "b", "2"), "S{c=1,a=0}", "S") == ["S{a=0,b=2,c=1}", "S{b=2}"]
    assert values(spark, candles.period_millis, "15m", "d", "2h", "1day", "5min", "100t") == [900_000, 86_400_000, 7_200_000, 86_400_000, 300_000, 0]
    legs = spark.sql("select array(named_struct('symbol', 'A', 'quantity', 1.0D), named_struct('symbol', 'B', 'quantity', -1.0D)) l")
    assert legs.select(symbols.spread_symbol(F.col("l"))).first()[0] == "=A-B"


def test_times(spark):
    got = values(spark, times.parsed, "20240102", "2024-01-02", "20240102-101112", "2024-01-02T10:11:12", "1704190272000", "x")
    day, at = datetime(2024, 1, 2), datetime(2024, 1, 2, 10, 11, 12)
    assert got == [day, day, at, at, at, None]
    assert times.period("PT1H30M") == times.period("1h30m") == timedelta(minutes=90) and times.period("inf") is None and times.period("15") == timedelta(seconds=15)
    with pytest.raises(ValueError):
        times.period("soon")


def test_lists(spark):
    assert values(spark, lambda c: lists.has_item(c, "TMP"), "TMP;XYZ;YT", "TM;XYZ", "") == [True, False, False]
    assert values(spark, lambda c: lists.add_item(c, "B"), "A;C", "", "B", "A") == ["A;B;C", "B", "B", "A;B"]
    assert values(spark, lambda c: lists.shares(c, F.lit("SE")), "SE 50;FSLR 20", "X 1", "") == [50.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        lists.has_item(F.lit(""), "a;b")
    df = spark.createDataFrame([(123456789.123456789,), (0.0,)], "x double")
    assert [r[0] for r in df.select(lists.canonical(F.col("x"), 4)).collect()] == [123500000.0, 0.0]


def test_codes_and_fields(spark):
    assert values(spark, codes.source_id, "A", "ABCD") == [65, 0x41424344]
    df = spark.createDataFrame([("a", "b", 1)], "name string, note string, n int")
    assert fields.visible(df, [(False, "n.*"), (True, "note")]).columns == ["note"]
    assert fields.retain(df, ["note"]).first() == ("", "b", 1)


def test_calendar(spark):
    text = "tz=America/New_York;hd=20240115;sd=20240116;sds=ec0300;td=12345;0=p04000930r09301600a16002000"
    days, sessions = calendar.calendar(spark, text, date(2024, 1, 12), date(2024, 1, 17))
    got = {(r["day"].day, r["kind"]): (r["open"], r["close"]) for r in sessions.collect()}
    assert got[(12, "REGULAR")] == (datetime(2024, 1, 12, 14, 30), datetime(2024, 1, 12, 21))
    assert got[(16, "REGULAR")][1] == datetime(2024, 1, 16, 18) and not [k for k in got if k[0] in (13, 14, 15)]
    at = calendar.trading_day(days, days, "day", 1).where("day = '2024-01-12'").first()
    assert at["trading_day"] == date(2024, 1, 16)
    rows = spark.createDataFrame([(1, datetime(2024, 1, 12, 14, 30)), (2, datetime(2024, 1, 13, 15)), (3, datetime(2024, 1, 13, 0, 30))], "id int, ts timestamp_ntz")
    assert {r["id"]: r["kind"] for r in calendar.session_of(rows, sessions).collect()} == {1: "REGULAR", 2: "NO_TRADING", 3: "AFTER_MARKET"}
    with pytest.raises(ValueError):
        calendar.definition("td=1")


def test_bucketed_orders_equal_plain_windows(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t long, v long")
    seen, want = {}, {}
    for k, t, v in data:
        n, s = seen.get(k, (0, 0))
        seen[k] = (n + 1, s + v)
        want[t] = seen[k]
    bucket = F.floor(F.col("t") / 7)
    got = ordering.running(ordering.numbered(df, ["k"], ["t"], bucket), ["k"], ["t"], bucket, F.col("v"), "s").collect()
    assert {r["t"]: (r["n"], r["s"]) for r in got} == want
    left, right = df.where("t % 3 = 0").select("k", "t"), df.where("t % 5 = 1").select("k", "t", F.col("v").alias("q"))
    got = {r["t"]: r["q"] for r in ordering.asof(left, right, ["k"], "t", ["q"], bucket).collect()}
    assert got == {t: next((v for k2, t2, v in reversed(data) if k2 == k and t2 <= t and t2 % 5 == 1), None) for k, t, _ in data if t % 3 == 0}


def replay(events):
    """The documented state machine, one row at a time: rows that are delivered as (arrival, snapshot, tx, segment)."""
    out, pending, partial, segment, tx = [], [], False, 0, 0
    for arrival, _, flags in events:
        if flags & 4:
            pending, partial, segment, tx = [], True, segment + 1, 0
        if segment and flags & 24:
            partial = False
        pending.append(arrival)
        if not partial and not flags & 1:
            out += [(a, segment > 0 and tx == 0, tx, segment) for a in pending]
            pending, tx = [], tx + 1
    return sorted(out)


def flag(rng):
    return sum(f for f, p in ((1, 0.3), (2, 0.2), (4, 0.1), (8, 0.15), (16, 0.05)) if rng.random() < p)


def test_transactions_equal_the_state_machine(spark):
    rng = random.Random(6)
    streams = {s: [(i, rng.randrange(5), flag(rng)) for i in range(25)] for s in range(40)}
    df = spark.createDataFrame([(s, *r) for s, rows in streams.items() for r in rows], "symbol long, arrival long, index long, flags int")
    got = {}
    for r in transactions.released(df, ["symbol"]).collect():
        got.setdefault(r["symbol"], []).append((r["arrival"], r["snapshot"], r["tx"], r["segment"]))
    for s, rows in streams.items():
        assert sorted(got.get(s, [])) == replay(rows)


def test_snapshots_sweep_their_range(spark):
    rows = [("A", 1, 10, 4), ("A", 2, 9, 0), ("A", 3, 8, 8), ("A", 4, 12, 0), ("A", 5, 10, 4), ("A", 6, 8, 8), ("A", 7, 3, 0)]
    df = spark.createDataFrame(rows, "symbol string, arrival long, time long, flags int")
    got = contracts.snapshots(df, ["symbol"], "arrival", codes.has_flag(F.col("flags"), 4), codes.has_flag(F.col("flags"), 16), "time")
    # A snapshot's first row sweeps all that is newer too: 12 goes.
    assert sorted(r["time"] for r in got.collect()) == [3, 8, 10]


def test_price_bars(spark):
    rng = random.Random(1)
    price, data = 100.0, []
    for i in range(400):
        price += rng.choice([-1.5, -0.5, 0.5, 1.5])
        data.append(("S", datetime(2024, 1, 1) + timedelta(seconds=i), i, price, 1.0))
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, seq long, price double, size double")
    out = {k: sorted(bars.price_bars(df, k, 4.0).collect(), key=lambda r: r["bar"]) for k in ("range", "momentum", "renko")}
    assert all(abs(r["high"] - r["low"] - 4) < 1e-9 and r["close"] in (r["high"], r["low"]) for r in out["range"])
    assert all(a["close"] == b["open"] for a, b in zip(out["range"], out["range"][1:]))
    assert all(abs(abs(a["close"] - b["open"]) - 0.4) < 1e-9 for a, b in zip(out["momentum"], out["momentum"][1:]))
    assert all(abs(abs(r["close"] - r["open"]) - 4) < 1e-9 for r in out["renko"])
    assert all(abs(b["high"] - a["high"] - 4) < 1e-9 or abs(a["low"] - b["low"] - 4) < 1e-9 for a, b in zip(out["renko"], out["renko"][1:]))


def test_scopes_hide(spark):
    rows = [(1, "BUY", s, e, m, 10.0, 1.0, 1, i, i) for i, (s, e, m) in enumerate([("COMPOSITE", "", None), ("REGIONAL", "Q", None), ("AGGREGATE", "Q", "X"), ("ORDER", "Q", "X"), ("AGGREGATE", "Q", "Y"), ("REGIONAL", "Z", None)])]
    df = spark.createDataFrame(rows, "symbol int, side string, scope string, exchange string, market_maker string, price double, size double, time long, seq long, index long")
    assert sorted(r["index"] for r in book.visible(book.book(df)).collect()) == [3, 4, 5]


def test_alignment(spark):
    a = spark.createDataFrame([("k", c, i) for i, c in enumerate("ABCBDAB")], "k string, p string, t long")
    b = spark.createDataFrame([("k", c, i) for i, c in enumerate("BDCABA")], "k string, p string, t long")
    assert analysis.aligned(a, b, "k", "p", "t").first()["matched"] == 4


def test_subscriptions(spark):
    df = spark.createDataFrame([("Trade", "A", 1), ("Trade", "B", 2), ("Quote", "A", 3), (None, "A", 4)], "record string, symbol string, n int")
    sub = spark.createDataFrame([("Trade", "A"), ("Trade", "A"), ("Quote", "*"), ("Quote", "A")], "record string, symbol string")
    assert sorted(r["n"] for r in contracts.subscribed(df, sub).collect()) == [1, 3]
    assert feed.merged_feeds(df, df.drop("n")).count() == 8


def test_tapes(spark, tmp_path):
    ticks = tapes.random_ticks(spark, 200, 5)
    tapes.write_tape(ticks.select("seq", "symbol", "price", "size", "ts"), f"{tmp_path}/tape")
    back = tapes.read_tape(spark, f"{tmp_path}/tape/period=*", "seq long, symbol string, price double, size double, ts timestamp_ntz", "2024-01-01 00:00:10", "2024-01-01 00:00:20")
    assert sorted(r["seq"] for r in back.collect()) == list(range(10, 20))
    (tmp_path / "t.txt").write_text("=Quote\tSymbol\tBid\nQuote\tIBM\t1.5\n\n=Trade\tSymbol\tPrice\nTrade\tA\t2\n")
    got = {r["record"]: r["values"] for r in tapes.described(spark, f"{tmp_path}/t.txt").collect()}
    assert got == {"Quote": {"Symbol": "IBM", "Bid": "1.5"}, "Trade": {"Symbol": "A", "Price": "2"}}
    (tmp_path / "p.ipf").write_text('#STOCK::=TYPE,SYMBOL,DESCRIPTION\nSTOCK,IBM,"a, b"\nSTOCK,X,\n##COMPLETE\n')
    got = {r["symbol"]: r["fields"].get("DESCRIPTION") for r in tapes.read_profiles(spark, f"{tmp_path}/p.ipf").collect()}
    assert got == {"IBM": "a, b", "X": None}


def test_price_bars_hold_no_symbol_as_a_whole(spark):
    """Bars come out while ticks still arrive, and no group is collected."""
    from itertools import count

    first = next(bars._price_bars("range", 5.0)((float(i), i) for i in count()))
    assert first == (0, 0, 0.0, 5.0, 0.0, 5.0, 6)
    df = spark.createDataFrame([("A", i % 7, i, float(i * i % 31)) for i in range(200)], "symbol string, ts int, seq long, price double")
    plan = bars.price_bars(df, "renko", 4.0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_changes_are_counted_by_row(spark):
    """Rows of one symbol are not paired with each other, and those whose symbol changes count."""
    rows = spark.createDataFrame([("S", "A", 1.0, ""), ("S", "A", 2.0, ""), ("S", "B", 2.0, "A 5"), (None, "A", None, "")], "symbol string, underlying string, spc double, additional_underlyings string")
    got = profiles.counted_changes(rows, lambda t: profiles.renamed(t, "A", "N"), ["underlying", "spc", "additional_underlyings"]).collect()
    assert {r["field"]: r["n"] for r in got} == {"underlying": 3, "spc": 0, "additional_underlyings": 1, "*": 4}
    got = profiles.counted_changes(rows, lambda t: t.withColumn("symbol", F.concat("symbol", F.lit("x"))), ["symbol", "spc"]).collect()
    assert {r["field"]: r["n"] for r in got} == {"symbol": 3, "spc": 0, "*": 3}


def test_candle_symbols_take_their_attributes_apart_once(spark):
    """Once for the normal form and once for all parts, however many there are."""
    t = spark.createDataFrame([("IBM&Q{a=S,price=b,=15min,a=m,dt=,pl}",), ("{}",), (None,)], "s string")
    t = t.select(candles.normal(F.col("s")).alias("n"), candles.parts(F.col("s")).alias("p"))
    assert [r["n"] for r in t.collect()] == ["IBM&Q{=15m,a=s,pl=,price=bid}", "", None]
    p = t.first()["p"]
    assert (p["period"], p["price"], p["alignment"], p["level"], p["data_type"]) == ("15m", "bid", "s", None, "")
    assert t._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
