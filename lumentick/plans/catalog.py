"""Named queries of the library over the driver's tables, and the SQL that gives the same rows.

Ticks come from ``events`` (symbol = user, record = event type) and, with sizes, from ``lineitem``
(symbol = part); quotes, books and profiles are derived from the other tables in a fixed way.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentick.functions import calendar, candles, codes, fields, filters, lists, prices, symbols, times
from lumentick.operators import analysis, bars, book, chains, contracts, ordering, profiles, transactions
from lumentick.plans import feed
from lumentick.sources import tapes

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Stand-ins for market tables.


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


TICKS = "ticks as (select event_type symbol, ts, event_id seq, value price, 1.0::double size from events)"


def sales(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"), seq.alias("seq"), F.floor("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").alias("size"), F.col("l_returnflag").alias("exchange"))


SALES = "sales as (select l_partkey::varchar symbol, l_shipdate ts, l_orderkey * 10 + l_linenumber seq, floor(l_extendedprice) price, l_quantity size, l_returnflag exchange from lineitem)"


def orders_book(spark: SparkSession, d: str) -> DataFrame:
    pr = F.substring("o_orderpriority", 1, 1)
    scope = F.when(pr == "1", "COMPOSITE").when(pr == "2", "REGIONAL").when(pr == "3", "AGGREGATE").otherwise("ORDER")
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 50).alias("symbol"), F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("side"), scope.alias("scope"), F.substring("o_orderstatus", 1, 1).alias("exchange"),
        F.when(F.col("o_custkey") % 3 > 0, (F.col("o_custkey") % 7).cast("string")).alias("market_maker"), F.floor("o_totalprice").cast("double").alias("price"), (F.col("o_orderkey") % 9).cast("double").alias("size"),
        F.col("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("index"),
    )


BOOK = """book0 as (select o_custkey % 50 symbol, case when o_orderstatus = 'F' then 'BUY' else 'SELL' end side,
 case substr(o_orderpriority, 1, 1) when '1' then 'COMPOSITE' when '2' then 'REGIONAL' when '3' then 'AGGREGATE' else 'ORDER' end scope, substr(o_orderstatus, 1, 1) exchange,
 coalesce(case when o_custkey % 3 > 0 then (o_custkey % 7)::varchar end, '') market_maker, floor(o_totalprice) price, (o_orderkey % 9)::double size, o_orderdate time, o_orderkey seq, o_orderkey "index" from orders),
book as (select * from book0 where size <> 0 or scope = 'COMPOSITE')"""
SIDE = "partition by symbol, side"
BOOK_ORDER = """order by case when side = 'BUY' then -price else price end, case when scope = 'ORDER' then 1 else 0 end, case when scope = 'ORDER' then time end, case when scope = 'ORDER' then seq end,
 case when scope = 'ORDER' then "index" end, size desc, time, seq, list_position(['COMPOSITE', 'REGIONAL', 'AGGREGATE', 'ORDER'], scope), exchange, market_maker, "index\""""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """Indexed events with flags, from orders: BEGIN, END, PENDING, REMOVE and SNIP by remainders of the key."""
    k = F.col("o_orderkey")
    bit = lambda c, v: F.when(c, F.lit(v)).otherwise(0)
    flags = bit(k % 13 == 0, 4) + bit(k % 13 == 5, 8) + bit(k % 4 == 1, 1) + bit(k % 6 == 2, 2) + bit(k % 29 == 7, 16)
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("symbol"), k.alias("arrival"), (k % 11).alias("index"), F.col("o_totalprice").alias("value"), flags.cast("int").alias("flags"))


FLAGGED = """flagged as (select o_custkey % 20 symbol, o_orderkey arrival, o_orderkey % 11 "index", o_totalprice "value",
 ((case when o_orderkey % 13 = 0 then 4 else 0 end) + (case when o_orderkey % 13 = 5 then 8 else 0 end) + (case when o_orderkey % 4 = 1 then 1 else 0 end) + (case when o_orderkey % 6 = 2 then 2 else 0 end) + (case when o_orderkey % 29 = 7 then 16 else 0 end))::int flags from orders)"""
RELEASED = FLAGGED + """, s1 as (select *, sum((flags & 4 <> 0)::int) over (partition by symbol order by arrival) segment from flagged),
s2 as (select *, (segment = 0 or max((flags & 24 <> 0)::int) over (partition by symbol, segment order by arrival) = 1) and flags & 1 = 0 rel from s1),
s3 as (select *, sum(rel::int) over (partition by symbol, segment order by arrival rows between current row and unbounded following) later,
 coalesce(sum(rel::int) over (partition by symbol, segment order by arrival rows between unbounded preceding and 1 preceding), 0)::bigint tx from s2),
released as (select symbol, arrival, "index", "value", flags, segment::bigint segment, tx, segment > 0 and tx = 0 snapshot from s3 where later > 0)"""


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """Option profiles from parts."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("."), F.col("p_brand"), k.cast("string")).alias("symbol"), F.when(k % 5 == 0, "FUTURE").otherwise("OPTION").alias("type"), F.when(k % 2 == 0, "OCASPS").when(k % 7 == 0, "FXXXXX").otherwise("OPASPS").alias("cfi"),
        F.col("p_brand").alias("underlying"), F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("product"), (F.col("p_size") % 4).cast("long").alias("expiration"), F.floor("p_retailprice").cast("double").alias("strike"), F.lit(100.0).alias("multiplier"), F.col("p_name").alias("description"), k.alias("arrival"),
        (F.col("p_size") % 3).cast("long").alias("last_trade"), F.when(k % 11 == 0, 10.0).otherwise(100.0).alias("spc"), F.when(k % 13 == 0, F.concat(F.lit("SE 50;"), F.col("p_brand"), F.lit(" 20;XY 7.5"))).otherwise("").alias("additional_underlyings"),
        F.when(k % 3 == 0, "202403").otherwise("").alias("mmy"), F.when(k % 17 == 0, "FLEX").otherwise("STAN").alias("option_type"), F.when(k % 19 == 0, "Weeklys").otherwise("").alias("expiration_style"), F.when(k % 23 == 0, "Close").otherwise("Open").alias("settlement_style"),
        F.when(k % 2 == 0, "XNYS").otherwise("ARCX").alias("opol"), F.when(k % 4 == 0, "ARCX;BATO;XNYS").when(k % 4 == 1, "ARCX").otherwise("").alias("exchanges"), F.concat(F.lit("a;b;"), (k % 3).cast("string")).alias("exchange_data"), F.lit("0.25 50; 0.5").alias("price_increments"),
    )


INSTRUMENTS = """inst as (select '.' || p_brand || p_partkey::varchar symbol, case when p_partkey % 5 = 0 then 'FUTURE' else 'OPTION' end "type",
 case when p_partkey % 2 = 0 then 'OCASPS' when p_partkey % 7 = 0 then 'FXXXXX' else 'OPASPS' end cfi, p_brand underlying, case when p_partkey % 3 = 0 then p_type else '' end product,
 (p_size % 4)::bigint expiration, floor(p_retailprice) strike, 100.0::double multiplier, p_name description, p_partkey arrival,
 (p_size % 3)::bigint last_trade, case when p_partkey % 11 = 0 then 10.0::double else 100.0::double end spc, case when p_partkey % 13 = 0 then 'SE 50;' || p_brand || ' 20;XY 7.5' else '' end additional_underlyings,
 case when p_partkey % 3 = 0 then '202403' else '' end mmy, case when p_partkey % 17 = 0 then 'FLEX' else 'STAN' end option_type, case when p_partkey % 19 = 0 then 'Weeklys' else '' end expiration_style, case when p_partkey % 23 = 0 then 'Close' else 'Open' end settlement_style,
 case when p_partkey % 2 = 0 then 'XNYS' else 'ARCX' end opol, case p_partkey % 4 when 0 then 'ARCX;BATO;XNYS' when 1 then 'ARCX' else '' end exchanges, 'a;b;' || (p_partkey % 3) exchange_data, '0.25 50; 0.5' price_increments from part)
"""
FIELDS = "expiration, last_trade, multiplier, spc, additional_underlyings, mmy, option_type, expiration_style, settlement_style"


# Contracts.


@query("select user_id, event_type, ts, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def ticker_last(spark, d):
    return contracts.ticker_last(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"])


@query("select event_id, ts, user_id, event_type, value from events qualify lag(value) over (partition by user_id, event_type order by event_id) is distinct from value")
def ticker_changes(spark, d):
    return contracts.ticker_changes(events(spark, d), ["user_id", "event_type"], ["event_id"], ["value"])


@query("""select event_id, ts, user_id, event_type, value from events where event_type = 'error'
 or (event_type = 'purchase' and exists (select 1 from customer where c_custkey = user_id and c_mktsegment = 'BUILDING'))""")
def stream_subscribed(spark, d):
    one = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("purchase").alias("record"), F.col("c_custkey").cast("string").alias("symbol"))
    sub = one.union(spark.createDataFrame([("error", "*")], "record string, symbol string"))
    rows = events(spark, d).withColumn("symbol", F.col("user_id").cast("string"))
    return contracts.subscribed(rows, sub, "event_type").drop("symbol")


@query("""with l as (select *, date_trunc('hour', ts)::timestamp "hour" from events)
select user_id, "hour", event_id, event_type, value from l qualify row_number() over (partition by user_id, "hour" order by event_id desc) = 1 and event_type <> 'error'""")
def history_upsert(spark, d):
    rows = events(spark, d).withColumn("hour", bars.slice_start("ts", 3600)).drop("ts")
    return contracts.history(rows, ["user_id"], "hour", ["event_id"], F.col("event_type") == "error").select("user_id", "hour", "event_id", "event_type", "value")


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id)::bigint as \"position\" from events where event_id between 100 and 700")
def history_range(spark, d):
    return contracts.scanned(events(spark, d).select("user_id", "event_id"), ["user_id"], "event_id", F.lit(100), F.lit(700))


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id desc)::bigint as \"position\" from events where event_id between 100 and 700")
def history_range_descending(spark, d):
    return contracts.scanned(events(spark, d).select("user_id", "event_id"), ["user_id"], "event_id", F.lit(700), F.lit(100), descending=True)


@query("select user_id, min(event_id) min_time, max(event_id) max_time, count(*) filter (where event_id between 100 and 700) available from events group by user_id")
def history_available(spark, d):
    return contracts.available(events(spark, d), ["user_id"], "event_id", F.lit(100), F.lit(700))


@query("select user_id, ts, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")
def history_retention(spark, d):
    return contracts.retained(events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 5)


@query("""select e.user_id, e.event_id, e.ts from events e join (select o_custkey user_id, min(o_orderkey) f from orders group by 1) s using (user_id) where e.event_id >= s.f""")
def history_from_time(spark, d):
    sub = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("from_time"))
    return contracts.subscribed_from(events(spark, d).select("user_id", "event_id", "ts"), sub, "user_id", "event_id")


@query("select user_id, event_id from events where not exists (select 1 from customer where c_custkey = user_id and c_acctbal < 0)")
def data_removal(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return contracts.removed(events(spark, d).select("user_id", "event_id"), gone, ["user_id"])


@query("""select user_id, event_id, event_type, coalesce(count(*) filter (where event_type <> 'view') over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint tx from events""")
def history_transactions(spark, d):
    return contracts.transactions(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "view")


@query(f"""with {FLAGGED}, s as (select *, coalesce(sum((flags & 4 <> 0)::int) over (partition by symbol order by arrival), 0) seg from flagged), m as (select symbol, seg, min("index") low from s group by all),
l as (select * from s qualify row_number() over (partition by symbol, "index" order by arrival desc) = 1)
select symbol, arrival, "index", "value", flags from l where flags & 2 = 0 and not exists (select 1 from m where m.symbol = l.symbol and m.seg > l.seg and m.low < l."index")
 and not exists (select 1 from s where s.symbol = l.symbol and s.arrival > l.arrival and s.flags & 16 <> 0 and s."index" > l."index")""")
def history_snapshots(spark, d):
    rows = flagged(spark, d)
    has = lambda bit: codes.has_flag(F.col("flags"), bit)
    return contracts.snapshots(rows, ["symbol"], "arrival", has(4), has(16), "index", has(2), F.floor(F.col("arrival") / 10_000))


@query("select c_custkey user_id, coalesce(min(event_id), 0) min_time, coalesce(max(event_id), 0) max_time, count(event_id) filter (where event_id >= 5000) available from customer left join events on user_id = c_custkey group by c_custkey")
def history_available_of_wanted(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return contracts.available(events(spark, d), ["user_id"], "event_id", F.lit(5000), F.lit(10**18), wanted)


@query("""select event_id, ts, user_id, event_type, value from events where event_type = 'error' or (event_type = 'purchase' and exists (select 1 from customer where c_custkey = user_id and c_mktsegment = 'BUILDING')) or value > 90""")
def stored_everything(spark, d):
    one = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.lit("purchase").alias("record"), F.col("c_custkey").cast("string").alias("symbol"))
    sub = one.union(spark.createDataFrame([("error", "*")], "record string, symbol string"))
    return contracts.stored_rows(events(spark, d).withColumn("symbol", F.col("user_id").cast("string")), sub, F.col("value") > 90, "event_type").drop("symbol")


@query("select event_id, user_id, event_type, value from events where event_type in (select event_type from events group by event_type having min(length(event_type)) > 4)")
def history_timed(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "value")
    records = e.groupBy(F.col("event_type").alias("record")).agg((F.min(F.length("event_type")) > 4).alias("has_time"))
    return contracts.timed(e, records, "event_type")


@query("select user_id, event_id, value from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_id >= 500")
def history_of_last(spark, d):
    return contracts.history_of_last(events(spark, d).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.lit(500))


@query("select user_id, event_id, event_type from events qualify lag(event_type) over (partition by user_id order by event_id) is distinct from event_type")
def stream_conflated(spark, d):
    return contracts.stream_of(events(spark, d).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], conflate=True)


@query("""select record, symbol from (select event_type record, user_id symbol from events where event_type <> 'view' union select 'quote', c_custkey from customer) where not (record = 'click' and symbol in (select c_custkey from customer where c_acctbal < 0))""")
def subscription_changed(spark, d):
    now = events(spark, d).where("event_type <> 'view'").select(F.col("event_type").alias("record"), F.col("user_id").alias("symbol"))
    c = table(spark, d, "customer")
    gone = c.where("c_acctbal < 0").select(F.lit("click").alias("record"), F.col("c_custkey").alias("symbol"))
    return contracts.changed_subscription(now, c.select(F.lit("quote").alias("record"), F.col("c_custkey").alias("symbol")), gone)


@query("""with v as (select user_id, event_id, value from events where event_type = 'view')
select p.user_id, p.event_id, p.value, v.value quote from (select * from events where event_type = 'purchase') p asof left join v on p.user_id = v.user_id and p.event_id >= v.event_id""")
def asof_last(spark, d):
    e = events(spark, d).select("user_id", "event_id", "event_type", "value")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "value")
    right = e.where("event_type = 'view'").select("user_id", "event_id", F.col("value").alias("quote"))
    return ordering.asof(left, right, ["user_id"], "event_id", ["quote"], F.floor(F.col("event_id") / 1000))


@query("select c_custkey user_id, e.event_type, coalesce(e.event_id, 0) event_id, e.value from customer left join (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) e on user_id = c_custkey")
def feed_last_events(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return feed.last_events(events(spark, d), wanted, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", F.coalesce("event_id", F.lit(0)).alias("event_id"), "value")


@query("select event_id, ts, user_id, event_type, value from events where user_id % 10 = 3 and event_id between 50 and 900 and event_type <> 'error'")
def feed_time_series(spark, d):
    return feed.time_series(events(spark, d), F.col("user_id") % 10 == 3, "event_id", F.lit(50), F.lit(900), F.col("event_type") == "error")


@query("select user_id, event_id, value from events where event_id <= 600 qualify row_number() over (partition by user_id order by event_id desc) = 1")
def feed_as_of(spark, d):
    return feed.as_of(events(spark, d).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.lit(600))


@query("""with w as (select c_custkey user_id from customer where c_acctbal >= 0), l as (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1)
select user_id, event_id, value from w left join l using (user_id) where user_id in (select o_custkey from orders)""")
def feed_last_events_if_subscribed(spark, d):
    wanted = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    sub = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    return feed.last_events_if_subscribed(events(spark, d).select("user_id", "event_id", "value"), wanted, sub, ["user_id"], ["event_id"])


@query(f"""with {FLAGGED}, l as (select * from flagged qualify row_number() over (partition by symbol, "index" order by arrival desc) = 1)
select symbol, arrival, "index", "value", flags from l where flags & 2 = 0 and symbol in (select c_nationkey from customer where c_acctbal < 1000)""")
def feed_indexed_if_subscribed(spark, d):
    sub = table(spark, d, "customer").where("c_acctbal < 1000").select(F.col("c_nationkey").cast("long").alias("symbol"))
    return feed.indexed_events_if_subscribed(flagged(spark, d), sub, ["symbol"])


@query("select event_id, ts, user_id, event_type, value from events where ts between timestamp '2024-01-05' and timestamp '2024-01-20' and event_type <> 'error' and user_id in (select o_custkey from orders)")
def feed_time_series_if_subscribed(spark, d):
    sub = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return feed.time_series_if_subscribed(events(spark, d), sub, ["user_id"], "ts", at("2024-01-05"), at("2024-01-20"), F.col("event_type") == "error")


@query("select c_custkey user_id, coalesce(value, 0) as \"value\" from customer left join (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) on user_id = c_custkey")
def feed_field(spark, d):
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return feed.field_value(events(spark, d), wanted, ["user_id"], ["event_id"], "value")


@query("""with a as (select distinct 'click' event_type, c_custkey user_id from customer), r as (select * from events where ts >= timestamp '2024-01-10')
select a.event_type, a.user_id, event_id, value, case when event_id is null then 'TIMED_OUT' else 'OK' end status from a left join r on a.event_type = r.event_type and a.user_id = r.user_id""")
def feed_events_query(spark, d):
    sub = table(spark, d, "customer").select(F.lit("click").alias("record"), F.col("c_custkey").alias("symbol"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return feed.events(events(spark, d), sub, "event_type", "user_id", "ts", at("2024-01-10"), at("9999-01-01")).select("event_type", "user_id", "event_id", "value", "status")


@query("select user_id, event_id, dropped from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) n, greatest(count(*) over (partition by user_id) - 3, 0) dropped from events) where n <= 3")
def feed_overflowed(spark, d):
    return feed.overflowed(events(spark, d).select("user_id", "event_id"), ["user_id"], ["event_id"], 3)


@query("select event_type, user_id, count(*) readers from events group by all")
def feed_observed(spark, d):
    return feed.observed(events(spark, d), "event_type", "user_id")


@query("select strftime(ts, '%Y%m%d-%H%M%S') || '.' || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') || chr(9) || event_type || chr(9) || event_id || chr(9) || user_id line from events")
def feed_dumped(spark, d):
    return feed.dumped(events(spark, d).select("event_id", "ts", "user_id", "event_type"), "event_type", "ts")


# The same calls with bounds for each key, from other tables, so that every row of events is judged.


def order_span(spark, d, first: str, last: str):
    """Each user's least and greatest order key."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias(first), F.max("o_orderkey").alias(last))


SPAN = "span as (select o_custkey user_id, min(o_orderkey) f, max(o_orderkey) t from orders group by 1)"


@query(f"with {SPAN} select e.event_id, e.ts, e.user_id, e.event_type, e.value from events e join span using (user_id) where e.event_id between f and t and e.event_type <> 'error'")
def feed_time_series_by_user(spark, d):
    rows = events(spark, d).join(order_span(spark, d, "f", "t"), "user_id")
    return feed.time_series(rows, F.lit(True), "event_id", F.col("f"), F.col("t"), F.col("event_type") == "error").select("event_id", "ts", "user_id", "event_type", "value")


@query(f"with {SPAN} select e.user_id, e.event_id, e.value from events e join span using (user_id) where e.event_id <= t qualify row_number() over (partition by e.user_id order by e.event_id desc) = 1")
def feed_as_of_by_user(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "value").join(order_span(spark, d, "f", "t"), "user_id")
    return feed.as_of(rows, ["user_id"], ["event_id"], F.col("t")).select("user_id", "event_id", "value")


@query(f"with {SPAN} select e.user_id, e.event_id, row_number() over (partition by e.user_id order by e.event_id)::bigint as \"position\" from events e join span using (user_id) where e.event_id between f and t")
def history_range_by_user(spark, d):
    rows = events(spark, d).select("user_id", "event_id").join(order_span(spark, d, "f", "t"), "user_id")
    return contracts.scanned(rows, ["user_id"], "event_id", F.col("f"), F.col("t")).drop("f", "t")


@query(f"with {SPAN} select e.user_id, e.event_id, row_number() over (partition by e.user_id order by e.event_id desc)::bigint as \"position\" from events e join span using (user_id) where e.event_id between f and t")
def history_range_descending_by_user(spark, d):
    rows = events(spark, d).select("user_id", "event_id").join(order_span(spark, d, "f", "t"), "user_id")
    return contracts.scanned(rows, ["user_id"], "event_id", F.col("t"), F.col("f"), descending=True).drop("f", "t")


# Bars.

OHLC = """min_by(price, (ts, seq)) "open", max(price) high, min(price) low, max_by(price, (ts, seq)) "close", count(*) "count", sum(size) volume,
 coalesce(round_even(sum(price * size) / nullif(sum(size), 0) * 10000.0::double, 0) / 10000.0::double, 0) vwap"""
OHLC = OHLC.replace("(ts, seq)", "row(ts, seq)")


def to4(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last bits: compared with four places."""
    return df.withColumns({c: F.rint(F.col(c) * 1e4) / 1e4 for c in columns})


@query(f"with {SALES} select symbol, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as \"start\", {OHLC} from sales group by all")
def bars_time(spark, d):
    return to4(bars.time_bars(sales(spark, d), 7 * 86400), "vwap")


@query(f"with {SALES}, n as (select *, row_number() over (partition by symbol order by ts, seq) n from sales) select symbol, ((n - 1) // 10)::bigint bar, {OHLC} from n group by all")
def bars_tick(spark, d):
    return to4(bars.tick_bars(sales(spark, d), 10, F.trunc("ts", "year")), "vwap")


@query(f"with {SALES}, n as (select *, sum(size) over (partition by symbol order by ts, seq) v from sales) select symbol, floor((v - size) / 100.0::double)::bigint bar, {OHLC} from n group by all")
def bars_volume(spark, d):
    return to4(bars.volume_bars(sales(spark, d), 100.0, F.trunc("ts", "year")), "vwap")


@query(f"with {SALES} select symbol, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as \"start\", floor(price / 5000.0::double) * 5000.0::double \"level\", {OHLC} from sales group by all")
def bars_level(spark, d):
    return to4(bars.level_bars(sales(spark, d), 7 * 86400, 5000.0), "vwap")


@query(f"""with {TICKS}, s as (select *, date_trunc('day', ts)::timestamp + interval '9 hours 30 minutes' o from ticks where isodow(ts) < 6)
select symbol, o + to_seconds(floor(epoch(ts - o) / 1800)::bigint * 1800) as "start", {OHLC} from s where ts >= o and ts < o + interval '6 hours 30 minutes' group by all""")
def bars_session(spark, d):
    t = ticks(spark, d)
    days = t.select(F.to_date("ts").alias("day")).distinct().where(F.weekday("day") < 5)
    at = lambda h, m: F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(h), mins=F.lit(m))
    return to4(bars.session_bars(t, days.select("day", at(9, 30).alias("open"), at(16, 0).alias("close")), 1800), "vwap")


@query(f"""with {TICKS}, s as (select *, date_trunc('day', ts)::timestamp d from ticks), h as (select *, case when ts < d + interval '11 hours' and ts >= d + interval '9 hours' then d + interval '9 hours' when ts >= d + interval '13 hours' and ts < d + interval '17 hours' then d + interval '13 hours' end o from s)
select symbol, o + to_seconds(floor(epoch(ts - o) / 2700)::bigint * 2700) as "start", {OHLC} from h where o is not null group by all""")
def bars_two_sessions(spark, d):
    t = ticks(spark, d)
    days = t.select(F.to_date("ts").alias("day")).distinct()
    at = lambda h: F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(h))
    both = [days.select("day", at(a).alias("open"), at(b).alias("close")) for a, b in ((9, 11), (13, 17))]
    return to4(bars.session_bars(t, both[0].union(both[1]), 2700), "vwap")


@query(f"with {TICKS} select symbol, floor(epoch(ts))::bigint * 4294967296 + seq \"index\", price \"open\", price high, price low, price \"close\", 1::bigint \"count\", size volume from ticks")
def candles_tick(spark, d):
    return bars.tick_candles(ticks(spark, d))


@query(f"""with {SALES}, b as (select symbol, time_bucket(interval '30 days', ts, timestamp '1970-01-01') s, sum(size) v, sum(price * size) pv from sales group by all),
g as (select symbol, unnest(generate_series(min(s), max(s), interval '30 days')) s from b group by symbol), j as (select g.symbol, g.s, coalesce(v, 0) v, coalesce(pv, 0) pv from g left join b using (symbol, s))
select symbol, s as "start", v volume, coalesce(round_even(pv / nullif(v, 0) * 10000.0::double, 0) / 10000.0::double, 0) vwap, sum(v) over (partition by symbol order by s) total_volume from j""")
def slices_vwap(spark, d):
    return to4(bars.filled_slices(sales(spark, d), 30 * 86400), "vwap")


@query("""select event_id, user_id, value, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as "period", ts from events
qualify row_number() over (partition by user_id, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') order by ts desc, event_id desc) = 1""")
def conflated_period(spark, d):
    return bars.conflated(events(spark, d).select("event_id", "ts", "user_id", "value"), ["user_id"], ["ts", "event_id"], 6 * 3600)


@query()
def bars_range(spark, d):
    return bars.price_bars(ticks(spark, d), "range", 50.0)


@query()
def bars_momentum(spark, d):
    return bars.price_bars(ticks(spark, d), "momentum", 50.0)


@query()
def bars_renko(spark, d):
    return bars.price_bars(ticks(spark, d), "renko", 50.0)


# Books.


@query(f"with {BOOK} select symbol, side, seq, price, size, row_number() over ({SIDE} {BOOK_ORDER})::bigint \"level\" from book")
def book_sorted(spark, d):
    return book.sorted_book(book.book(orders_book(spark, d))).select("symbol", "side", "seq", "price", "size", "level")


@query(f"""with {BOOK}, f as (select *, max((scope = 'ORDER')::int) over ({SIDE}, exchange, market_maker) o, max((scope in ('ORDER', 'AGGREGATE'))::int) over ({SIDE}, exchange) f, max((scope <> 'COMPOSITE')::int) over ({SIDE}) x from book)
select symbol, side, scope, exchange, market_maker, seq from f where not ((scope = 'AGGREGATE' and o = 1) or (scope = 'REGIONAL' and f = 1) or (scope = 'COMPOSITE' and x = 1))""")
def book_visible(spark, d):
    return book.visible(book.book(orders_book(spark, d))).select("symbol", "side", "scope", "exchange", "market_maker", "seq")


@query(f"with {BOOK} select symbol, max(price) filter (where side = 'BUY') bid, min(price) filter (where side <> 'BUY') ask, coalesce(max(price) filter (where side = 'BUY') < min(price) filter (where side <> 'BUY'), false) \"valid\" from book group by symbol")
def book_best(spark, d):
    return book.best(book.book(orders_book(spark, d)))


@query(f"with {BOOK} select symbol, side, scope, seq, case when scope = 'ORDER' then size else size * 100.0::double end size from book where scope in ('AGGREGATE', 'REGIONAL', 'COMPOSITE')")
def book_lots(spark, d):
    return book.book(orders_book(spark, d), "COMPOSITE_REGIONAL_AGGREGATE", 100.0).select("symbol", "side", "scope", "seq", "size")


@query(f"""with {BOOK}, b as (select *, coalesce(sum(size) over ({SIDE} {BOOK_ORDER} rows between unbounded preceding and 1 preceding), 0) c from book), t as (select *, greatest(least(size, 20.0::double - c), 0) k from b)
select symbol, side, sum(k) filled, round_even(sum(k * price) / nullif(sum(k), 0) * 10000.0::double, 0) / 10000.0::double price from t group by symbol, side""")
def book_price_for_size(spark, d):
    return to4(book.price_for_size(book.book(orders_book(spark, d)), 20.0), "price")


@query(f"""with {BOOK}, t as (select *, case when side = 'BUY' then max(price) over ({SIDE}) else min(price) over ({SIDE}) end top from book)
select symbol, side, seq, abs(price - top) > top * (case when top < 1000 then 0.5::double when top < 100000 then 0.2::double else 0.1::double end) outlier from t""")
def book_outliers(spark, d):
    return book.outliers(book.book(orders_book(spark, d)), [(1000.0, 0.5), (100000.0, 0.2), (1e12, 0.1)]).select("symbol", "side", "seq", "outlier")


@query(f"""with {SALES}, q as (select symbol, exchange, ts "time", seq, price * 0.5::double bid, price * 2.0::double ask, size from sales)
select symbol, exchange, "time", seq, 'COMPOSITE' scope, 'BUY' side, bid price, size from q union all select symbol, exchange, "time", seq, 'COMPOSITE', 'SELL', ask, size from q""")
def orders_from_quotes(spark, d):
    q = sales(spark, d).select("symbol", "exchange", F.col("ts").alias("time"), "seq", (F.col("price") * F.lit(0.5)).alias("bid"), F.col("size").alias("bid_size"), (F.col("price") * F.lit(2.0)).alias("ask"), F.col("size").alias("ask_size"))
    return book.from_quotes(q)


@query(f"""with {BOOK} select symbol, max(price) filter (where side = 'BUY') bid, max_by(size, row(price, size)) filter (where side = 'BUY') bid_size, min(price) filter (where side <> 'BUY') ask, min_by(size, row(price, size)) filter (where side <> 'BUY') ask_size,
 count(*) = count(distinct price) and coalesce(max(price) filter (where side = 'BUY') < min(price) filter (where side <> 'BUY'), true) "valid" from book group by symbol""")
def book_best_adjacent(spark, d):
    return book.best_adjacent(book.book(orders_book(spark, d)))


@query(f"""with {SALES}, q as (select symbol, exchange, ts "time", seq, price * 0.5::double bid, price * 2.0::double ask, size from sales),
o as (select symbol, exchange, "time", seq, 'BUY' side, bid price, size, 5 source from q union all select symbol, exchange, "time", seq, 'SELL', ask, size, 6 from q)
select symbol, exchange, exchange || 'AB' market_maker, "time", seq, 'AGGREGATE' scope, side, price, size, source::bigint source, source::bigint * 281474976710656 + ascii(exchange)::bigint * 4294967296 + ascii(exchange)::bigint * 65536 + 65 * 256 + 66 "index" from o""")
def orders_from_maker_quotes(spark, d):
    q = sales(spark, d).select("symbol", "exchange", F.concat("exchange", F.lit("AB")).alias("market_maker"), F.col("ts").alias("time"), "seq", (F.col("price") * F.lit(0.5)).alias("bid"), F.col("size").alias("bid_size"), (F.col("price") * F.lit(2.0)).alias("ask"), F.col("size").alias("ask_size"))
    return book.synthetic(q, "AGGREGATE")


@query(f"""with {SALES}, o as (select symbol, exchange, seq, 'BUY' side, price * 0.5::double price, 140737488355328 b from sales union all select symbol, exchange, seq, 'SELL', price * 2.0::double, 0 from sales)
select symbol, exchange, seq, side, price, 8::bigint source, 8::bigint * 281474976710656 + b + ascii(exchange)::bigint * 4294967296 "index" from o""")
def orders_unitary(spark, d):
    q = sales(spark, d).select("symbol", "exchange", F.col("ts").alias("time"), "seq", (F.col("price") * F.lit(0.5)).alias("bid"), F.col("size").alias("bid_size"), (F.col("price") * F.lit(2.0)).alias("ask"), F.col("size").alias("ask_size"))
    return book.synthetic(q, "REGIONAL", unitary=True).select("symbol", "exchange", "seq", "side", "price", "source", "index")


ACTION = "['NEW', 'MODIFY', 'DELETE', 'TRADE', 'EXECUTE', 'PARTIAL', 'BUST', 'REPLACE']"


@query(f"""with a as (select o_custkey % 50 symbol, o_orderkey % 40 order_id, o_orderkey seq, o_totalprice size, {ACTION}[(o_custkey % 8 + 1)::int] "action" from orders), t as (select * from a where "action" not in ('TRADE', 'BUST'))
select symbol, order_id, seq, size, "action" from t qualify row_number() over (partition by symbol, order_id order by seq desc) = 1 and "action" not in ('DELETE', 'EXECUTE')""")
def book_by_actions(spark, d):
    names_ = F.split(F.lit("NEW,MODIFY,DELETE,TRADE,EXECUTE,PARTIAL,BUST,REPLACE"), ",")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("symbol"), (F.col("o_orderkey") % 40).alias("order_id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("size"), F.get(names_, (F.col("o_custkey") % 8).cast("int")).alias("action"))
    return book.by_actions(rows, ["symbol", "order_id"], ["seq"])


@query()
def book_corrected(spark, d):
    rows = orders_book(spark, d).withColumn("scope", F.when(F.col("seq") % 4 > 0, "AGGREGATE").otherwise("ORDER")).withColumn("index", F.col("index") % 25).withColumn("price", F.floor(F.col("price") / 20_000).cast("double"))
    return book.corrected(rows.withColumns({"arrival": F.col("seq"), "time": F.unix_millis(F.col("time").cast("timestamp"))}), 200 * 86_400_000, 30 * 86_400_000)


# Transactions.


@query(f"""with {RELEASED}, n as (select *, row_number() over (partition by symbol, segment, tx, "index" order by arrival desc) n from released)
select symbol, arrival, "index", "value", flags, segment, tx, snapshot from n where not snapshot or (n = 1 and flags & 2 = 0)""")
def tx_delivered(spark, d):
    return transactions.delivered(flagged(spark, d), ["symbol"])


@query(f"""with {RELEASED}, l as (select * from released qualify segment = max(segment) over (partition by symbol)), n as (select *, row_number() over (partition by symbol, "index" order by arrival desc) n from l)
select symbol, arrival, "index", "value", flags from n where n = 1 and flags & 2 = 0""")
def tx_final(spark, d):
    return transactions.final(flagged(spark, d), ["symbol"])


@query(f"""with {RELEASED}, l as (select * from released qualify segment = max(segment) over (partition by symbol)), n as (select *, row_number() over (partition by symbol, "index" order by arrival desc) n from l)
select symbol, arrival, "index", "value", 0 flags, row_number() over (partition by symbol order by "index")::bigint as "position" from n where n = 1 and flags & 2 = 0""")
def tx_indexed_list(spark, d):
    return transactions.indexed_list(flagged(spark, d), ["symbol"])


@query(f"""with flagged0 as (select * from orders where o_orderkey % 11 >= 4), {RELEASED.replace("from orders)", "from flagged0)")}, l as (select * from released qualify segment = max(segment) over (partition by symbol)),
n as (select *, row_number() over (partition by symbol, "index" order by arrival desc) n from l), k as (select * from n where n = 1 and flags & 2 = 0 qualify row_number() over (partition by symbol order by "index" desc) <= 3)
select symbol, arrival, "index", "value", 0 flags, row_number() over (partition by symbol order by "index")::bigint as "position" from k""")
def tx_time_series_list(spark, d):
    return transactions.time_series_list(flagged(spark, d), ["symbol"], "index", F.lit(4), most=3)


# Chains and profiles.


@query(f"""with {INSTRUMENTS}, o as (select *, unnest(case when product = '' then [underlying] when underlying = product then [product] else [product, underlying] end) chain from inst where "type" = 'OPTION' and cfi[1:2] in ('OC', 'OP') and expiration <> 0)
select chain, {FIELDS}, 'OX' || substr(cfi, 3) cfi, array_to_string(list_transform(list_sort(list(distinct strike)), lambda x: x::bigint), ',') strikes,
 coalesce(string_agg(symbol, ',' order by strike, symbol) filter (where cfi[1:2] = 'OC'), '') calls, coalesce(string_agg(symbol, ',' order by strike, symbol) filter (where cfi[1:2] = 'OP'), '') puts from o group by all""")
def option_chains(spark, d):
    return chains.chains(instruments(spark, d)).withColumn("strikes", F.array_join(F.transform("strikes", lambda x: x.cast("long").cast("string")), ","))


@query(f"""with {INSTRUMENTS}, s as (select distinct underlying, strike from inst), r as (select *, row_number() over (partition by underlying order by strike) - 1 i, count(*) filter (where strike < 1200) over (partition by underlying) a from s)
select underlying, strike from r where i >= greatest(a - 3, 0) and i < greatest(a - 3, 0) + 6""")
def strikes_around(spark, d):
    return chains.strikes_around(instruments(spark, d), ["underlying"], 1200.0, 6)


@query("""with u as (select p_brand symbol, p_partkey arrival, case when p_partkey % 4 = 0 then '' else p_type end a, case when p_partkey % 3 = 0 then '' else p_name end b from part)
select symbol, min(arrival) as "first", coalesce(max_by(a, arrival) filter (where a <> ''), '') a, coalesce(max_by(b, arrival) filter (where b <> ''), '') b from u group by symbol""")
def profiles_merged(spark, d):
    k = F.col("p_partkey")
    u = table(spark, d, "part").select(F.col("p_brand").alias("symbol"), k.alias("arrival"), F.when(k % 4 == 0, "").otherwise(F.col("p_type")).alias("a"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("b"))
    return profiles.merged(u, "arrival", ["a", "b"])


@query("""select symbol, field, n from (select p_brand symbol, count(distinct nullif(p_type, '')) a, count(distinct nullif(p_size::varchar, '')) b from part group by 1) unpivot (n for field in (a, b)) where n > 1""")
def profiles_conflicts(spark, d):
    u = table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("a"), F.col("p_size").cast("string").alias("b"))
    return profiles.conflicts(u, ["a", "b"])


@query(f"with {INSTRUMENTS} select symbol, \"type\" from inst where symbol not in (select symbol from inst where \"type\" = 'FUTURE')")
def profiles_excluded(spark, d):
    p = instruments(spark, d)
    return profiles.excluded(p, p.where("type = 'FUTURE'")).select("symbol", "type")


@query(f"with {INSTRUMENTS} select underlying, expiration, cfi, strike, count(*) n, min(symbol) symbol from inst where \"type\" = 'OPTION' group by underlying, expiration, cfi, strike having count(*) > 1")
def profiles_repeated(spark, d):
    return profiles.repeated(instruments(spark, d).where("type = 'OPTION'"), ["underlying", "expiration", "cfi", "strike"])


@query("""with u as (select user_id::varchar symbol, case when event_type = 'error' then 'REMOVED' else event_type end "type", event_id from events)
select symbol, "type", event_id from u qualify row_number() over (partition by symbol order by event_id desc) = 1 and "type" <> 'REMOVED'""")
def profiles_collected(spark, d):
    u = events(spark, d).select(F.col("user_id").cast("string").alias("symbol"), F.when(F.col("event_type") == "error", "REMOVED").otherwise(F.col("event_type")).alias("type"), "event_id")
    return profiles.collected(u, "event_id")


@query(f"""with {INSTRUMENTS}, f as (select * from inst where product <> ''), g as (select product, min_by(underlying, arrival) filter (where underlying <> '') underlying, min(description) a, max(description) b from f group by product)
select product, underlying, regexp_replace(substr(a, 1, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: substr(a, 1, k) = substr(b, 1, k)))::bigint), '[ \\t\\n,;:/-]+$', '') description from g""")
def profiles_products(spark, d):
    return profiles.products(instruments(spark, d), "arrival", ["underlying"])


@query(f"""with {INSTRUMENTS} select symbol, case when "type" = 'FUTURE' then 1 when "type" = 'OPTION' then 2 else 3 end::bigint type_rank, row_number() over (partition by "type" order by product, underlying, last_trade, strike, symbol)::bigint place from inst""")
def profiles_sorted(spark, d):
    return profiles.sorted_profiles(instruments(spark, d), ["FUTURE", "OPTION"]).select("symbol", "type_rank", "place")


@query(f"with {INSTRUMENTS} select underlying, count(distinct nullif(expiration_style, '')) + 1 styles from (select underlying, expiration_style from inst union all select underlying, 'Quarterlys' from inst) where expiration_style <> 'Quarterlys' group by 1 having count(distinct nullif(expiration_style, '')) + 1 > 1")
def profiles_mixed_styles(spark, d):
    i = instruments(spark, d).select("underlying", "expiration_style")
    return profiles.mixed_styles(i.union(i.select("underlying", F.lit("Quarterlys"))))


@query(f"with {INSTRUMENTS} select underlying, strike, count(*) n, min(symbol) symbol from inst where \"type\" = 'OPTION' and option_type <> 'FLEX' group by underlying, strike having count(*) > 1")
def profiles_repeated_options(spark, d):
    return profiles.repeated_options(instruments(spark, d).where("type = 'OPTION'"), ["underlying", "strike"], F.col("option_type") == "FLEX")


@query(f"with {INSTRUMENTS} select symbol, \"type\" from inst where not (strike > 1200 and product = '')")
def profiles_deleted(spark, d):
    return profiles.deleted(instruments(spark, d), (F.col("strike") > 1200) & (F.col("product") == "")).select("symbol", "type")


@query(f"""with {INSTRUMENTS} select symbol, case when additional_underlyings <> '' then 'XY' else underlying end underlying, case when additional_underlyings <> '' then 7.5::double else spc end spc,
 case when additional_underlyings <> '' then underlying || ' ' || spc::bigint || ';SE 50' else '' end additional_underlyings from inst""")
def profiles_primary(spark, d):
    return profiles.primary(instruments(spark, d), F.lit("XY")).select("symbol", "underlying", "spc", "additional_underlyings")


@query(f"""with {INSTRUMENTS} select symbol, case when underlying = 'Brand#11' then 'NEW' else underlying end underlying,
 case when additional_underlyings = '' or underlying <> 'Brand#11' then additional_underlyings else 'NEW 20;SE 50;XY 7.5' end additional_underlyings from inst""")
def profiles_renamed(spark, d):
    return profiles.renamed(instruments(spark, d), "Brand#11", "NEW").select("symbol", "underlying", "additional_underlyings")


@query(f"""with {INSTRUMENTS}, h as (select *, strike > 1000 and opol <> 'BATO' hit from inst) select symbol, case when hit then 'BATO' else opol end opol, case when not hit then exchanges when exchanges = opol then 'BATO'
 else array_to_string(list_sort(list_append(list_filter(string_split(exchanges, ';'), lambda x: x <> '' and x <> opol), 'BATO')), ';') end exchanges from h""")
def profiles_with_opol(spark, d):
    i = instruments(spark, d)
    return profiles.with_opol(i, i.where("strike > 1000").select("symbol"), "BATO").select("symbol", "opol", "exchanges")


@query(f"""with {INSTRUMENTS}, s as (select *, substr(mmy, greatest(length(mmy) - 5, 1)) || cfi[2] || strike::bigint suffix from inst) select p, case when "type" = 'OPTION' then substr(symbol, 1, length(symbol) - 2) || suffix else symbol end symbol from (select *, symbol p from s)""")
def profiles_long_suffix(spark, d):
    i = instruments(spark, d)
    return profiles.long_suffix(i.withColumn("p", F.col("symbol"))).select("p", "symbol")


@query(f"""with {INSTRUMENTS}, c as (select *, case when "type" = 'FUTURE' then 2.0::double else 4.0::double end conv, substr(exchange_data, 5)::double old from inst)
select symbol s0, case when "type" = 'FUTURE' then case when mmy <> '' then 'Made,Mar-2024,there' when expiration > 0 then 'Made,Jan-1970,there' else 'Made,,there' end else description end description,
 50.0::double multiplier, 'a;b;' || conv::bigint exchange_data, strike * case when "type" = 'OPTION' then 0.5::double else 1 end strike from c where old <> conv""")
def profiles_exchange_product(spark, d):
    i = instruments(spark, d).withColumn("s0", F.col("symbol"))
    i = i.where(F.get(F.split("exchange_data", ";"), F.lit(2)).cast("double") != F.when(F.col("type") == "FUTURE", 2.0).otherwise(4.0))
    return profiles.exchange_product(i, F.lit("Made,,there"), F.lit(50.0), F.lit(2.0), F.lit(4.0), F.lit(0.5)).select("s0", "description", "multiplier", "exchange_data", "strike")


@query(f"""with {INSTRUMENTS} select 'underlying' field, count(*) filter (where underlying = 'Brand#11') n from inst union all select 'spc', 0 union all select '*', count(*) filter (where underlying = 'Brand#11') from inst""")
def profiles_counted_changes(spark, d):
    return profiles.counted_changes(instruments(spark, d), lambda t: profiles.renamed(t, "Brand#11", "NEW"), ["underlying", "spc"])


# Analysis.


@query("select user_id, count(*) n from events group by user_id order by n desc, user_id limit 10")
def top_symbols(spark, d):
    return analysis.top(events(spark, d), "user_id", 10)


@query("select event_type, coalesce(user_id, -1) user_id, count(*) n, sum(value) total from (select event_type, user_id, floor(value) as \"value\" from events) group by grouping sets ((event_type, user_id), (event_type), ())")
def totals_by_level(spark, d):
    return analysis.totals(events(spark, d).withColumn("value", F.floor("value").cast("double")), "event_type", "user_id", "value").withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


@query("""with a as (select event_type, user_id, ts, row_number() over (partition by event_type, user_id order by ts) k from events where event_id % 5 <> 0),
b as (select event_type, user_id, ts, row_number() over (partition by event_type, user_id order by ts) k from events where event_id % 7 <> 0)
select event_type, count(a.ts) received1, count(b.ts) received2, count(b.ts - a.ts) matched, sum(epoch_us(b.ts) - epoch_us(a.ts))::bigint delay_us from a full join b using (event_type, user_id, k) group by event_type""")
def streams_compared(spark, d):
    e = events(spark, d).select("event_type", "user_id", "ts", "event_id")
    return analysis.compared(e.where("event_id % 5 <> 0"), e.where("event_id % 7 <> 0"), ["event_type"], ["user_id"], "ts")


@query()
def streams_aligned(spark, d):
    e = events(spark, d).select("user_id", "event_type", "event_id")
    return analysis.aligned(e.where("event_id % 5 <> 0"), e.where("event_id % 7 <> 0"), "user_id", "event_type", "event_id")


@query("select event_id, ts, user_id, event_type, value from events where ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint % 1000000 >= 100000")
def dropped_rows(spark, d):
    return analysis.dropped(events(spark, d), "event_id", 100_000)


@query("""with a as (select event_type, user_id, floor(value / 10) v, ts, row_number() over (partition by event_type, user_id, floor(value / 10) order by ts) k from events where event_id % 5 <> 0),
b as (select event_type, user_id, floor(value / 10) v, ts, row_number() over (partition by event_type, user_id, floor(value / 10) order by ts) k from events where event_id % 7 <> 0),
j as (select event_type, user_id, count(a.ts) received1, count(b.ts) received2, count(b.ts - a.ts) matched, sum(epoch_us(b.ts) - epoch_us(a.ts))::bigint delay_us from a full join b using (event_type, user_id, v, k) group by all),
g as (select event_type, user_id, sum(received1)::bigint received1, sum(received2)::bigint received2, sum(matched)::bigint matched, sum(delay_us)::bigint delay_us from j group by grouping sets ((event_type, user_id), (event_type), ()))
select coalesce(event_type, '') event_type, coalesce(user_id, -1) user_id, received1, received2, matched, delay_us, 100.0::double * (received1 - matched) / nullif(received1, 0) dropped1, 100.0::double * (received2 - matched) / nullif(received2, 0) dropped2, delay_us::double / nullif(matched, 0) mean_delay_us from g""")
def streams_compared_totals(spark, d):
    e = events(spark, d).select("event_type", "user_id", "ts", "event_id", F.floor(F.col("value") / 10).alias("v"))
    out = analysis.compared_totals(e.where("event_id % 5 <> 0"), e.where("event_id % 7 <> 0"), "event_type", "user_id", ["v"], "ts")
    return out.withColumns({"event_type": F.coalesce("event_type", F.lit("")), "user_id": F.coalesce("user_id", F.lit(-1))})


@query("""with e as (select event_type, user_id::varchar s, length(event_type || ',' || user_id) b from events), c as (select event_type, s, count(*) n, sum(b) b from e group by all)
select event_type record, 'OTHER' category, sum(n)::bigint n, count(*) symbols, sum(b)::bigint bytes, sum(n * length(s))::bigint symbol_bytes, round_even((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 10000.0::double, 0) / 10000.0::double symbol_bits from c group by event_type""")
def tape_field_statistics(spark, d):
    e = events(spark, d).select("event_type", F.col("user_id").cast("string").alias("s"))
    return to4(analysis.field_statistics(e, "event_type", "s", F.lit("OTHER")), "symbol_bits")


@query("select '<event><event_id>' || event_id || '</event_id><event_type>' || event_type || '</event_type></event>' line from events")
def events_as_xml(spark, d):
    return analysis.as_xml(events(spark, d).select("event_id", "event_type"))


@query("select event_id, ts, timestamp '2030-01-01' + to_microseconds(((epoch_us(ts) - epoch_us(timestamp '2024-01-05')) / 2)::bigint) replay_ts from events where ts >= timestamp '2024-01-05'")
def feed_replayed(spark, d):
    return tapes.replayed(events(spark, d).select("event_id", "ts").where(F.col("event_id") >= 0), "2024-01-05 00:00:00", speed=2.0, begin="2030-01-01 00:00:00")


@query("select event_id, ts, user_id, event_type, value from events where event_type in ('click', 'view') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-02-01' and user_id in (select o_custkey from orders)")
def feed_extracted(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return tapes.extracted(events(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("symbol")), ["click", "view"], at("2024-01-05"), at("2024-02-01"), "event_type", "user_id")


# Filters.

NAMES = "names as (select p_partkey k, case p_partkey % 9 when 0 then '/ES' || p_size when 1 then '$IDX' || p_size when 2 then '.' || upper(p_brand) when 3 then './ES' || p_size when 4 then '=A-B' || p_size when 5 then 'EUR/USD' when 6 then 'IBM' || p_size || '&Q' when 7 then 'SPY{=5m,price=bid}' else upper(replace(p_brand, '#', '')) end s from part)"


def names(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    s = (
        F.when(k % 9 == 0, F.concat(F.lit("/ES"), size)).when(k % 9 == 1, F.concat(F.lit("$IDX"), size)).when(k % 9 == 2, F.concat(F.lit("."), F.upper("p_brand"))).when(k % 9 == 3, F.concat(F.lit("./ES"), size)).when(k % 9 == 4, F.concat(F.lit("=A-B"), size))
        .when(k % 9 == 5, "EUR/USD").when(k % 9 == 6, F.concat(F.lit("IBM"), size, F.lit("&Q"))).when(k % 9 == 7, "SPY{=5m,price=bid}").otherwise(F.upper(F.replace("p_brand", F.lit("#"), F.lit(""))))
    )
    return table(spark, d, "part").select(k.alias("k"), s.alias("s"))


@query(f"with {NAMES} select k, s from names where (regexp_full_match(s, 'IBM.*') or regexp_full_match(s, '\\.[A-K].*') or regexp_full_match(s, '.*S.*')) and not regexp_full_match(s, '/.*')")
def filter_glob(spark, d):
    s = F.col("s")
    return names(spark, d).where((filters.glob(s, "IBM*") | filters.glob(s, ".[A-K]*") | filters.glob(s, "*S*")) & filters.glob(s, "!/*"))


@query(f"with {NAMES}, c as (select *, regexp_replace(s, '^(=[+-]?([0-9.]+[*])?)?[^A-Za-z0-9]*', '') c from names) select k, s from c where c >= 'B' and c < 'IBM3'")
def filter_range(spark, d):
    return names(spark, d).where(filters.ranged(F.col("s"), "B", "IBM3"))


@query(f"""with {NAMES}, h as (select *, list_reduce(list_prepend(0::bigint, list_transform(string_split(s, ''), lambda c: unicode(c)::bigint)), lambda a, x: (a * 31 + x) % 4294967296) h from names)
select k, s, (((h::hugeint * 3026425037) % 4294967296) // 268435456)::bigint g from h""")
def filter_hash(spark, d):
    return names(spark, d).withColumn("g", filters.hash_group(F.col("s"), 16).cast("long"))


@query(f"""with {NAMES} select k, s, case when regexp_full_match(s, '[A-Z]{{3,4}}/[A-Z]{{3}}([#{{:].*)?') then 'fx' when s[1] = '/' then 'fut' when s[1] = '$' then 'ind' when s[1] = '=' then 'spread' when s[1:2] = './' then 'futopt' when s[1] = '.' then 'bsopt' else 'OTHER' end category from names""")
def filter_category(spark, d):
    return names(spark, d).withColumn("category", filters.category(F.col("s")))


@query(f"with {NAMES} select k, s from names where regexp_full_match(s, '/[A-Z0-9]{{1,3}}([{{:].*)?') or regexp_full_match(s, '[^/.=].*') or regexp_full_match(s, '\\.[^/].*')")
def filter_named(spark, d):
    return names(spark, d).where(filters.of_class(F.col("s"), "prod") | filters.of_class(F.col("s"), "bs") | filters.of_class(F.col("s"), "csopt"))


@query("select event_id, event_type from events where event_type like 'c%' or event_type like '%ch%'")
def filter_record(spark, d):
    e = events(spark, d).select("event_id", "event_type")
    up = F.upper("event_type")
    return e.where(filters.record_glob(up, ":C*") | filters.record_glob(up, "*\\QCH\\E*"))


@query(f"with {NAMES} select k, s from names where regexp_replace(regexp_replace(s, '\\{{[^}}]*\\}}$', ''), '&[A-Z]$', '') in ('SPY', 'IBM1', 'IBM5', 'EUR/USD')")
def filter_listed(spark, d):
    ref = spark.createDataFrame([("SPY",), ("IBM1&N",), ("IBM5",), ("EUR/USD",)], "symbol string")
    return filters.listed(names(spark, d), ref, "s")


@query(f"with {INSTRUMENTS} select distinct underlying, {FIELDS}, cfi, dense_rank() over (partition by underlying order by {FIELDS}, cfi)::bigint place from inst where \"type\" = 'OPTION'")
def series_sorted(spark, d):
    series = instruments(spark, d).where("type = 'OPTION'").select("underlying", *chains.SERIES).distinct()
    return chains.series_order(series, ["underlying"])


@query("""select event_type, count(*) n, count(distinct user_id) symbols, min(value) value_min, max(value) value_max, count(*) filter (where value is null) value_missing, count(*) filter (where value = 0) value_zero from events group by event_type""")
def tape_described(spark, d):
    return analysis.described(events(spark, d), "event_type", "user_id", ["value"])


@query(f"""with {NAMES} select case when k % 3 = 0 then 'Trade' else 'Quote' end record, case when regexp_full_match(s, '[A-Z]{{3,4}}/[A-Z]{{3}}([#{{:].*)?') then 'fx' when s[1] = '/' then 'fut' when s[1] = '$' then 'ind' when s[1] = '=' then 'spread' when s[1:2] = './' then 'futopt' when s[1] = '.' then 'bsopt' else 'OTHER' end category, count(distinct s) symbols from names group by all""")
def subscription_totals(spark, d):
    return analysis.subscription_totals(names(spark, d).withColumn("r", F.when(F.col("k") % 3 == 0, "Trade").otherwise("Quote")), "r", "s", filters.category(F.col("s")))


@query("select event_id, ts + interval '90 seconds' ts from events")
def feed_delayed(spark, d):
    return feed.delayed(events(spark, d).select("event_id", "ts"), "ts", 90)


@query("select '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' line from events")
def events_as_json(spark, d):
    return analysis.as_json(events(spark, d).select("event_id", "event_type"))


# Scalars.


@query(f"""with {NAMES} select k, regexp_replace(regexp_replace(s, '\\{{[^}}]*\\}}$', ''), '&[A-Z]$', '') base, regexp_extract(s, '&([A-Z])$', 1) exchange, case when s like '%price=bid%' then 'bid' end price,
 case when s like '%{{%' then 'SPY{{=5m,price=ask}}' else s || '{{price=ask}}' end changed, case when s like '%{{%' then 'SPY{{=5m}}' else s end removed from names""")
def symbol_parts(spark, d):
    s = F.col("s")
    return names(spark, d).select("k", symbols.base_symbol(s).alias("base"), symbols.exchange_code(s).alias("exchange"), symbols.attribute(s, "price").alias("price"), symbols.with_attribute(s, "price", "ask").alias("changed"), symbols.with_attribute(s, "price", None).alias("removed"))


@query("select event_id, (ts::date - date '1970-01-01')::bigint day_id, strftime(ts, '%Y%m%d')::bigint ymd, isodow(ts)::bigint dow, (date_trunc('month', ts)::date + 14)::date::varchar mid, last_day(ts::date)::varchar as \"last\", (ts::date + (3 - isodow(ts))::int)::date::varchar wednesday from events")
def day_functions(spark, d):
    ts = F.col("ts")
    return events(spark, d).select("event_id", times.day_id(ts).alias("day_id"), times.yyyymmdd(times.day_id(ts)).alias("ymd"), times.day_of_week(ts).alias("dow"), times.with_day_of_month(ts, 15).cast("string").alias("mid"), times.with_day_of_month(ts, -1).cast("string").alias("last"), times.with_day_of_week(ts, 3).cast("string").alias("wednesday"))


@query("select event_id, (x - ((x % 7 + 7) % 7)) // 7 q, ((x % 7 + 7) % 7)::bigint r, ((x - ((x % 1000000 + 1000000) % 1000000)) // 1000000)::bigint ms, ((x % 1000000 + 1000000) % 1000000)::bigint nanos from (select event_id, (event_id - 500) * 1152921504606847 x from events where event_id < 8000) union all select event_id, null, null, null, null from events where event_id >= 8000")
def floor_division(spark, d):
    x = F.when(F.col("event_id") < 8000, (F.col("event_id") - 500) * F.lit(1152921504606847))
    ms, nanos = times.split_nanos(x)
    return events(spark, d).select("event_id", times.floor_div(x, 7).alias("q"), times.floor_mod(x, 7).alias("r"), ms.alias("ms"), nanos.alias("nanos"))


@query("""select event_id, case when event_id % 4 = 3 then date_trunc('day', ts)::timestamp when event_id % 4 = 1 then date_trunc('second', ts)::timestamp - interval '90 minutes' else date_trunc('second', ts)::timestamp end parsed, epoch_us(ts) // 1000000 * 1000 millis,
 strftime(ts, '%Y%m%d-%H%M%S') || 'Z' formatted from events""")
def time_formats(spark, d):
    ts, k = F.col("ts"), F.col("event_id") % 4
    text = F.when(k == 0, F.date_format(ts, "yyyyMMdd-HHmmss")).when(k == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))).when(k == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyyMMdd"))
    e = events(spark, d).select("event_id", "ts", text.alias("t"))
    again = times.parsed((F.unix_seconds(ts.cast("timestamp")) * 1000).cast("string"))
    return e.select("event_id", times.parsed(F.col("t")).alias("parsed"), F.unix_millis(again.cast("timestamp")).alias("millis"), times.formatted(ts, zone="Z").alias("formatted"))


@query("""select event_id, (ts::date - (((ts::date - date '1970-01-05') % 14 + 14) % 14)::int)::date::varchar w, (date_trunc('month', ts)::date - to_months(((year(ts) - 1970) * 12 + month(ts) - 1)::int % 5))::date::varchar m, make_date(year(ts) - (year(ts) - 1970) % 4, 1, 1)::varchar y,
 (make_date(year(ts) - (year(ts) - 1970) % 4, 1, 1) + interval '4 years')::date::varchar y_end from events""")
def day_ranges(spark, d):
    day = F.to_date("ts")
    text = lambda c: c.cast("string")
    return events(spark, d).select("event_id", text(times.week_range(day, 2)["first"]).alias("w"), text(times.month_range(day, 5)["first"]).alias("m"), text(times.year_range(day, 4)["first"]).alias("y"), text(times.year_range(day, 4)["end"]).alias("y_end"))


@query("""with c as (select p_partkey k, p_size n, p_partkey % 6 u from part)
select k, 'IBM&Q{{=' || case when n = 1 then '' else n::varchar end || ['m', 'h', 'd', 't', 'mo', 'v'][u + 1] || ',aa=zz' || case when u < 3 then ',pl=0.5' else '' end || ',price=' || case when u % 2 = 0 then 'bid' else 'mark' end || ',tho=true}}' normal, case when n = 1 then '' else n::varchar end || ['m', 'h', 'd', 't', 'mo', 'v'][u + 1] period,
 n * [60000, 3600000, 86400000, 0, 2592000000, 0][u + 1] millis, 'IBM' base, 'Q' exchange, case when u % 2 = 0 then 'bid' else 'mark' end price, true tho, 'm' alignment, case when u < 3 then 0.5::double end "level" from c""".replace("{{", "{").replace("}}", "}"))
def candle_symbols(spark, d):
    u = (F.col("p_partkey") % 6).cast("int")
    unit = F.get(F.array(*[F.lit(x) for x in ("min", "Hours", "day", "Tick", "month", "VOL")]), u)
    symbol = F.concat(F.lit("IBM&Q{tho=TRUE,price="), F.when(u % 2 == 0, "b").otherwise("MA"), F.when(u < 3, ",pl=0.50").otherwise(""), F.lit(",dt=,aa=zz,="), F.col("p_size").cast("string"), unit, F.lit("}"))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), symbol.alias("s")).withColumn("p", candles.parts(F.col("s")))
    return t.select("k", candles.normal(F.col("s")).alias("normal"), "p.period", candles.period_millis(F.col("p.period")).alias("millis"), "p.base", "p.exchange", "p.price", "p.tho", "p.alignment", "p.level")


@query("""with c as (select p_partkey k, (p_partkey % 5) - 2 a, p_size % 4 b from part)
select k, case when a = 0 and b = 0 then '' when a = 0 and b = 1 then 'BB' when b = 0 and a = 1 then 'AA'
 when a = 0 then '=' || b || '*BB' when b = 0 then '=' || case when a < 0 then '-' else '' end || case when abs(a) = 1 then '' else abs(a) || '*' end || 'AA'
 when a > b or a = b then '=' || case when a = 1 then '' else a || '*' end || 'AA+' || case when b = 1 then '' else b || '*' end || 'BB'
 else '=' || case when b = 1 then '' else b || '*' end || 'BB' || case when a < 0 then '-' else '+' end || case when abs(a) = 1 then '' else abs(a) || '*' end || 'AA' end spread from c""")
def spread_symbols(spark, d):
    leg = lambda name, q: F.struct(F.lit(name).alias("symbol"), q.cast("double").alias("quantity"))
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("k"), symbols.spread_symbol(F.array(leg("AA", k % 5 - 2), leg("BB", size % 4))).alias("spread"))


@query("""select p_partkey k, ceil(p_retailprice) ceiling, floor(p_retailprice) "floor", round_even(p_retailprice / 8, 0) half_even, trunc(p_retailprice) "down", floor(p_retailprice / 100 + 0.5::double) * 100 hundreds, p_retailprice + p_size "sum", greatest(p_retailprice, p_size::double) "max" from part""")
def decimal_rounding(spark, d):
    c, n = F.col("p_retailprice"), F.col("p_size").cast("double")
    two = lambda x: F.rint(x * 1e4) / 1e4
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), prices.whole(c, "CEILING").alias("ceiling"), prices.whole(c, "FLOOR").alias("floor"), prices.whole(c / 8, "HALF_EVEN").alias("half_even"), prices.whole(c, "DOWN").alias("down"), prices.scaled(c, -2).alias("hundreds"), two(prices.combined("sum", c, n)).alias("sum"), prices.combined("max", c, n).alias("max"))


@query("select p_partkey k, (p_partkey * 5) / 100.0::double value, true same from part")
def decimal_codec(spark, d):
    x = (F.col("p_partkey") * 5) / F.lit(100.0)
    code = prices.tiny_decimal(x)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), x.alias("value"), (prices.from_tiny_decimal(code) == x).alias("same"))

@query("""with p as (select p_partkey, p_partkey / 8.0::double price from part), i as (select *, case when price <= 50 then 0.25::double else 0.5::double end inc from p)
select p_partkey, price, inc, floor(price / inc) * inc "down", case when price < 50 then ceil(price / 0.25::double) * 0.25::double else ceil(price / 0.5::double) * 0.5::double end up, case when inc = 0.25 then 2 else 1 end "precision" from i""")
def price_increments(spark, d):
    text = "0.25 50; 0.5"
    c = F.col("price")
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") / F.lit(8.0)).alias("price"))
    return p.select("p_partkey", "price", prices.increment(c, text).alias("inc"), prices.rounded(c, text, -1).alias("down"), prices.rounded(c, text, 1).alias("up"), prices.precision(c, text).alias("precision"))


@query("""with l as (select p_partkey k, array_to_string(list_sort(list_distinct(string_split(p_type || ' ' || p_mfgr0, ' '))), ';') l from (select *, substr(p_name, 1, 3) p_mfgr0 from part))
select k, l, list_contains(string_split(l, ';'), 'STEEL') has, case when list_contains(string_split(l, ';'), 'MM') then l else array_to_string(list_concat(list_filter(string_split(l, ';'), lambda x: x <= 'MM'), list_concat(['MM'], list_filter(string_split(l, ';'), lambda x: x > 'MM'))), ';') end added,
 array_to_string(list_filter(string_split(l, ';'), lambda x: x <> 'STEEL'), ';') removed from l""")
def list_items(spark, d):
    words = F.split(F.concat_ws(" ", "p_type", F.substring("p_name", 1, 3)), " ")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.array_sort(F.array_distinct(words)), ";").alias("l"))
    c = F.col("l")
    return t.select("k", "l", lists.has_item(c, "STEEL").alias("has"), lists.add_item(c, "MM").alias("added"), lists.remove_item(c, "STEEL").alias("removed"))


@query("""select p_partkey k, case when p_brand in ('Brand#11', 'Brand#12', 'Brand#1') then 'first' when p_brand like '%3' then 'brand' else 'rest' end chosen, regexp_full_match(p_brand, 'Brand#[1-3].*') liked, regexp_replace(p_name, '[aeiou]', '_') replaced from part""")
def profile_expressions(spark, d):
    t = table(spark, d, "part")
    chosen = lists.choose(F.col("p_brand"), {("Brand#11", "Brand#12", "Brand#1"): F.lit("first")}, F.when(F.col("p_brand").endswith("3"), "brand").otherwise("rest"))
    return t.select(F.col("p_partkey").alias("k"), chosen.alias("chosen"), lists.like(F.col("p_brand"), "Brand#[1-3].*").alias("liked"), lists.replace_first(F.col("p_name"), "[aeiou]", "_").alias("replaced"))


@query("""select event_id, value / nullif(event_id % 3, 0) quotient_some, case when event_id % 3 = 0 then case when value > 0 then 'inf' when value < 0 then '-inf' else 'nan' end end quotient_none, (ts::date - date '2024-01-01')::double "days", (ts::date + 10)::varchar later, event_type || 'x' joined, (value::bigint)::varchar "text" from events""")
def field_arithmetic(spark, d):
    n, day = (F.col("event_id") % 3).cast("double"), F.to_date("ts")
    q = fields.arithmetic("/", F.col("value"), n, ("number", "number"))
    none = F.when(n == 0, F.when(F.isnan(q), "nan").when(q > 0, "inf").otherwise("-inf"))
    return events(spark, d).select("event_id", F.when(n != 0, q).alias("quotient_some"), none.alias("quotient_none"), fields.arithmetic("-", day, F.lit("2024-01-01").cast("date"), ("date", "date")).alias("days"), fields.arithmetic("+", day, F.lit(10.0), ("date", "number")).cast("string").alias("later"), fields.arithmetic("+", F.col("event_type"), F.lit("x"), ("string", "string")).alias("joined"), fields.cast(F.rint("value"), "number", "string").alias("text"))


@query("select p_partkey k, case when p_partkey % 13 = 0 then 50.0::double else 0 end se, case when p_partkey % 13 = 0 then 3::bigint else 0 end n from part")
def additional_underlyings(spark, d):
    c = F.col("additional_underlyings")
    return instruments(spark, d).select(F.col("arrival").alias("k"), lists.shares(c, F.lit("SE")).alias("se"), F.size(lists.underlyings(c)).cast("long").alias("n"))


@query("""with c as (select c_custkey, upper(substr(c_mktsegment, 1, 4)) s, substr(c_mktsegment, 1, 1) l, ['A', 'E', 'B', 'X'][(c_custkey % 4 + 1)::int] x from customer)
select c_custkey, case c_custkey % 3 when 0 then 'Equities' when 1 then 'Listed options' else 'Futures' end category, case c_custkey % 3 when 0 then 'Common/Ordinary shares' when 1 then 'Call options' else 'Financial futures' end "group",
 case c_custkey % 3 when 0 then case x when 'E' then 'Enhanced voting' end when 1 then case x when 'A' then 'American' when 'E' then 'European' when 'B' then 'Bermudan' end else case x when 'B' then 'Baskets' when 'A' then 'Agriculture' when 'E' then 'Extraction resources' end end attribute1,
 (ascii(s) * 16777216 + ascii(s[2]) * 65536 + ascii(s[3]) * 256 + ascii(s[4]))::bigint source_id, s source_name, case c_custkey % 3 when 0 then 'UNDEFINED' when 1 then 'BUY' else 'SELL' end side from c""")
def code_functions(spark, d):
    k = F.col("c_custkey")
    letter = F.get(F.array(*[F.lit(x) for x in "AEBX"]), (k % 4).cast("int"))
    cfi = F.concat(F.when(k % 3 == 0, "ES").when(k % 3 == 1, "OC").otherwise("FF"), letter, F.lit("XXX"))
    t = table(spark, d, "customer").select("c_custkey", codes.cfi(cfi).alias("c"), codes.source_id(F.upper(F.substring("c_mktsegment", 1, 4))).alias("source_id"))
    return t.select("c_custkey", "c.category", "c.group", "c.attribute1", "source_id", codes.source_name(F.col("source_id")).alias("source_name"), codes.named((k % 3).cast("string"), codes.SIDES).alias("side"))


@query("""select event_id, case when event_type = 'view' then 'seen' else event_type end event_type, case when event_type = 'click' then event_id::double else value end as "value", case when event_type = 'error' then ts + interval '90 seconds' else ts end ts from events""")
def field_replacement(spark, d):
    e = events(spark, d)
    e = fields.set_field(e, F.col("event_type") == "click", "value", "event_id")
    e = fields.shift_time(e, F.col("event_type") == "error", "ts", 90)
    e = fields.set_value(e, F.col("event_type") == "view", "event_type", "seen")
    return fields.visible(e, [(False, "user.*")])


DEFINITION = "tz=UTC;hd=20240115;sd=20240116;sds=ec0300;td=12345;0=p05000830r08301530a15301900"
KIND = """case when isodow(ts) > 5 or ts::date = date '2024-01-15' then 'NO_TRADING' when ts::time >= time '05:00' and ts::time < time '08:30' then 'PRE_MARKET'
 when ts::time >= time '08:30' and ts::time < case when ts::date = date '2024-01-16' then time '12:30' else time '15:30' end then 'REGULAR' when ts::time >= time '15:30' and ts::time < time '19:00' then 'AFTER_MARKET' else 'NO_TRADING' end"""


def event_days(spark, d):
    return events(spark, d).select(F.to_date("ts").alias("day")).distinct()


@query(f"select event_id, ts, {KIND} kind from events")
def calendar_sessions(spark, d):
    return calendar.session_of(events(spark, d).select("event_id", "ts"), calendar.sessions_on(event_days(spark, d), DEFINITION))


@query("""with d as (select distinct ts::date as "day" from events), m as (select "day", isodow("day") < 6 and "day" <> date '2024-01-15' trading from d), o as (select *, sum(trading::int) over (order by "day")::bigint o from m),
n as (select *, max("day") filter (where trading) over (order by "day" rows between unbounded preceding and 1 preceding) previous, min("day") filter (where trading) over (order by "day" rows between 1 following and unbounded following) as "next" from o)
select n."day"::varchar as "day", n.trading, t."day"::varchar next2, n.previous::varchar previous, n."next"::varchar as "next" from n left join (select * from o where trading) t on t.o = n.o + 2""")
def calendar_days(spark, d):
    days = calendar.marked_days(event_days(spark, d), DEFINITION)
    out = calendar.trading_day(days.select("day", "trading"), days, "day", 2, "next2").join(calendar.neighbours(days, F.col("trading")), "day")
    return out.select(F.col("day").cast("string").alias("day"), "trading", *[F.col(c).cast("string").alias(c) for c in ("next2", "previous", "next")])


@query("""with d as (select distinct ts::date as "day" from events), s as (select "day" + interval '510 minutes' o, "day" + case when "day" = date '2024-01-16' then interval '750 minutes' else interval '930 minutes' end c from d where isodow("day") < 6 and "day" <> date '2024-01-15'),
e as (select event_id, ts from events), f as (select event_id, o, c, case when ts < o then epoch_us(o) - epoch_us(ts) when ts >= c then epoch_us(ts) - epoch_us(c) + 1 else 0 end far from e join s on ts between o - interval '6 days' and c + interval '6 days')
select event_id, o near_open, c near_close from f qualify row_number() over (partition by event_id order by far, o) = 1""")
def calendar_nearest(spark, d):
    sessions = calendar.sessions_on(event_days(spark, d), DEFINITION)
    return calendar.nearest_session(events(spark, d).select("event_id", "ts"), sessions, kinds=("REGULAR",)).select("event_id", "near_open", "near_close")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
