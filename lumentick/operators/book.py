"""Order books of rows (symbol, side, scope, exchange, market_maker, price, size, time, seq, index)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .contracts import ticker_last

SCOPES = ("COMPOSITE", "REGIONAL", "AGGREGATE", "ORDER")
#: Scopes that each preset of the scope filter lets through.
PRESETS = {
    "ALL": SCOPES, "COMPOSITE": SCOPES[:1], "REGIONAL": SCOPES[1:2], "AGGREGATE": SCOPES[2:3], "ORDER": SCOPES[3:], "COMPOSITE_REGIONAL": SCOPES[:2],
    "COMPOSITE_REGIONAL_AGGREGATE": SCOPES[:3],
}


def is_buy(side: str = "side") -> Column:
    return F.col(side) == "BUY"


def book(rows: DataFrame, preset: str = "ALL", lot: float = 1.0) -> DataFrame:
    """Rows with a size (or of COMPOSITE scope) in the preset's scopes; sizes of other scopes than ORDER in lots.

    Anything that is not BUY is in the SELL book.
    """
    sized = F.col("size").isNotNull() & ~F.isnan("size") & (F.col("size") != 0)
    kept = rows.where((sized | (F.col("scope") == "COMPOSITE")) & F.col("scope").isin(*PRESETS[preset]))
    size = F.when(F.col("scope") == "ORDER", F.col("size")).otherwise(F.col("size") * F.lit(lot))
    return kept.withColumn("side", F.when(is_buy(), "BUY").otherwise("SELL")).withColumn("size", size).withColumn("market_maker", F.coalesce("market_maker", F.lit("")))


def visible(rows: DataFrame) -> DataFrame:
    """Hides what finer rows show: AGGREGATE under ORDER of the same exchange and maker, REGIONAL under either of
    its exchange, COMPOSITE under anything else visible."""
    side = ["symbol", "side"]
    order, fine = F.col("scope") == "ORDER", F.col("scope").isin("ORDER", "AGGREGATE")
    has_order = F.max(order).over(Window.partitionBy(*side, "exchange", "market_maker"))
    has_fine = F.max(fine).over(Window.partitionBy(*side, "exchange"))
    has_other = F.max(F.col("scope") != "COMPOSITE").over(Window.partitionBy(*side))
    hidden = ((F.col("scope") == "AGGREGATE") & has_order) | ((F.col("scope") == "REGIONAL") & has_fine) | ((F.col("scope") == "COMPOSITE") & has_other)
    return rows.withColumn("__h", hidden).where(~F.col("__h")).drop("__h")


def _order() -> list[Column]:
    order = F.col("scope") == "ORDER"
    rank = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.col("scope"))
    return [
        F.when(is_buy(), -F.col("price")).otherwise(F.col("price")), order.cast("int"), F.when(order, F.col("time")), F.when(order, F.col("seq")), F.when(order, F.col("index")), F.col("size").desc(), F.col("time"), F.col("seq"), rank,
        F.col("exchange"), F.col("market_maker").asc_nulls_first(), F.col("index"),
    ]


def sorted_book(rows: DataFrame) -> DataFrame:
    """Adds ``level``, the row's place on its side of the symbol's book."""
    return rows.withColumn("level", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(*_order())).cast("long"))


def best(rows: DataFrame) -> DataFrame:
    """Best bid and offer of each symbol, and whether they don't cross."""
    number = ~F.isnan("price")
    bid, ask = F.max(F.when(is_buy() & number, F.col("price"))), F.min(F.when(~is_buy() & number, F.col("price")))
    return rows.groupBy("symbol").agg(bid.alias("bid"), ask.alias("ask"), F.coalesce(bid < ask, F.lit(False)).alias("valid"))


def price_for_size(rows: DataFrame, size: float) -> DataFrame:
    """The average price at which ``size`` fills from the top of each side; over what is there if it is less."""
    w = Window.partitionBy("symbol", "side").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    t = rows.withColumn("__before", F.coalesce(F.sum("size").over(w), F.lit(0.0)))
    take = F.greatest(F.least(F.col("size"), F.lit(size) - F.col("__before")), F.lit(0.0))
    t = t.withColumn("__take", take).groupBy("symbol", "side").agg(F.sum("__take").alias("filled"), F.sum(F.col("__take") * F.col("price")).alias("__v"))
    return t.select("symbol", "side", "filled", F.try_divide("__v", "filled").alias("price"))


#: Ids of the order sources that synthetic orders have, by scope: for bids, for offers, and unitary ones for both.
SOURCES = {"COMPOSITE": (1, 2, 7), "REGIONAL": (3, 4, 8), "AGGREGATE": (5, 6, 9)}


def from_quotes(quotes: DataFrame, scope: str = "COMPOSITE") -> DataFrame:
    """A BUY and a SELL row of each quote (symbol, exchange, bid, bid_size, ask, ask_size, time, seq)."""
    sides = F.array(F.struct(F.lit("BUY").alias("side"), F.col("bid").alias("price"), F.col("bid_size").alias("size")), F.struct(F.lit("SELL").alias("side"), F.col("ask").alias("price"), F.col("ask_size").alias("size")))
    return quotes.select("symbol", "exchange", "time", "seq", F.lit(scope).alias("scope"), F.explode(sides).alias("s")).select("symbol", "exchange", "time", "seq", "scope", "s.side", "s.price", "s.size")


def synthetic(quotes: DataFrame, scope: str = "COMPOSITE", unitary: bool = False, market_maker: str = "market_maker") -> DataFrame:
    """``from_quotes`` with the orders' ``source`` and ``index``: source << 48 | exchange << 32 and, of a market maker, up to four characters.

    A unitary source has both sides; bit 47 of the index marks the bid.
    """
    maker = F.coalesce(F.col(market_maker), F.lit("")) if market_maker in quotes.columns else F.lit("")
    code = F.aggregate(F.filter(F.split(F.substring(maker, 1, 4), ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a * 256 + F.ascii(x))
    t = from_quotes(quotes.withColumn("exchange", F.struct(F.col("exchange").alias("x"), maker.alias("m"), code.alias("k"))), scope)
    bid, ask, both = SOURCES[scope]
    source = F.lit(both) if unitary else F.when(is_buy(), bid).otherwise(ask)
    side = F.when(is_buy(), 1).otherwise(0) if unitary else F.lit(0)
    exchange = F.coalesce(F.ascii("exchange.x"), F.lit(0))
    index = F.shiftleft(source.cast("long"), 48) + F.shiftleft(side.cast("long"), 47) + F.shiftleft(exchange.cast("long"), 32) + F.col("exchange.k")
    return t.select("symbol", F.col("exchange.x").alias("exchange"), F.col("exchange.m").alias("market_maker"), "time", "seq", "scope", "side", "price", "size", source.cast("long").alias("source"), index.alias("index"))


#: What a full order book's rows do; all but the first two groups leave the book itself alone.
ACTIONS = {"adds": ("NEW", "REPLACE", "MODIFY", "PARTIAL"), "removes": ("DELETE", "EXECUTE"), "reports": ("TRADE", "BUST")}


def by_actions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The book after all actions: each key's last row that touches the book, unless that removes it.

    PARTIAL carries the size that is left. TRADE and BUST report, and don't touch the book.
    """
    touching = rows.where(F.coalesce(F.col("action"), F.lit("NEW")).isin(*ACTIONS["adds"], *ACTIONS["removes"]))
    return ticker_last(touching, keys, order).where(~F.coalesce(F.col("action"), F.lit("NEW")).isin(*ACTIONS["removes"]))


def best_adjacent(rows: DataFrame, open_: Column | None = None) -> DataFrame:
    """Best bid and offer with sizes, and whether they are sound: no two rows of one price, no SELL below a BUY, and ``open_`` (within a session)."""
    one = F.struct("price", "size")
    number = ~F.isnan("price") & F.col("price").isNotNull()
    t = rows.where(number).groupBy("symbol").agg(
        F.max(F.when(is_buy(), one)).alias("b"), F.min(F.when(~is_buy(), one)).alias("a"), F.count("*").alias("n"), F.count_distinct("price").alias("prices"), *([F.min(open_).alias("o")] if open_ is not None else [])
    )
    sound = F.coalesce((F.col("n") == F.col("prices")) & (F.coalesce(F.col("b.price") < F.col("a.price"), F.lit(True))), F.lit(False))
    sound = sound if open_ is None else sound & F.coalesce(F.col("o"), F.lit(False))
    return t.select("symbol", F.col("b.price").alias("bid"), F.col("b.size").alias("bid_size"), F.col("a.price").alias("ask"), F.col("a.size").alias("ask_size"), sound.alias("valid"))


CORRECTED = "symbol {kind}, arrival long, index long, side string, price double, size double, time long, correction boolean"


def _corrector(keep: int, flip: int):
    """For one symbol's AGGREGATE rows in order of arrival: what passes, and removals that go before it."""
    stored: dict[int, tuple] = {}  # index: (side, price, size, time); a negative size is held back

    def flips(a: tuple, b: tuple) -> bool:
        bid, ask = (a, b) if a[0] == "BUY" else (b, a)
        return a[0] != b[0] and bid[1] >= ask[1]

    def stale(index: int, other: tuple, key: int, new: tuple, age: int) -> bool:
        """``age`` 1: the other is newer than the new row in a way that bars it, -1: the other way round."""
        later = (lambda gap: other[3] > new[3] + gap) if age > 0 else (lambda gap: other[3] <= new[3] - gap)
        slot = index != key and other[2] > 0 and other[:2] == new[:2] and later(0)
        return slot or later(keep) or (flips(other, new) and later(flip))

    def accept(key: int, new: tuple) -> tuple[list[tuple[int, tuple]], bool]:
        """The removals, and whether the row passes."""
        side, price, size, time = new
        if not size or size != size:
            stored.pop(key, None)
            return [], True
        if any(stale(i, x, key, new, 1) for i, x in stored.items()):
            old = stored.get(key)
            stored[key] = (side, price, -size, time)
            return ([(key, (side, price, 0.0, time))] if old and old[2] > 0 else []), False
        old = stored.get(key)
        if old and old[2] < 0 and old[:2] == (side, price) and old[3] >= time:
            return [], False
        gone = []
        for i, x in stored.items():
            if stale(i, x, key, new, -1):
                stored[i] = (x[0], x[1], -x[2], x[3])
                gone.append((i, (x[0], x[1], 0.0, x[3])))
        stored[key] = new
        return gone, True

    return accept


def corrected(rows: DataFrame, keep_ms: int = 86_400_000, flip_ms: int = 60_000) -> DataFrame:
    """AGGREGATE rows (symbol, arrival, index, side, price, size, time in ms) without stale ones, and size-0 removals (``correction``) of what they outdate.

    A row is held back when a newer one stands at its price, when any is newer by ``keep_ms``, or when a
    newer one by ``flip_ms`` crosses it; older ones in the same ways are removed. Spark sorts a symbol; it
    passes through its task in batches, with the symbol's open rows as state. Other scopes pass as they are.
    """
    kind = rows.schema["symbol"].dataType.simpleString()
    names = ["symbol", "arrival", "index", "side", "price", "size", "time"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            symbol, accept, begun = None, None, False
            for b in batches:
                for s, a, i, side, price, size, time in zip(*(b.column(c).to_pylist() for c in names)):
                    if not begun or s != symbol:
                        symbol, accept, begun = s, _corrector(keep_ms, flip_ms), True
                    removals, passes = accept(i, (side, price, size, time))
                    yield from ((s, a, k, x[0], x[1], x[2], x[3], True) for k, x in removals)
                    if passes:
                        yield s, a, i, side, price, size, time, False

        out = made()
        while some := list(islice(out, 10_000)):
            cols = list(zip(*some))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=[*names, "correction"])

    aggregate = rows.where("scope = 'AGGREGATE'").select("symbol", F.col("arrival").cast("long").alias("arrival"), F.col("index").cast("long").alias("index"), F.when(is_buy(), "BUY").otherwise("SELL").alias("side"), F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"), F.col("time").cast("long").alias("time"))
    kinds = [to_arrow_type(rows.schema["symbol"].dataType), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    kinds.append(pa.bool_())
    done = aggregate.repartition("symbol").sortWithinPartitions("symbol", "arrival").mapInArrow(run, CORRECTED.format(kind=kind))
    other = rows.where(F.coalesce(F.col("scope") != "AGGREGATE", F.lit(True))).select(*[F.col(c) if c == "symbol" else F.col(c).cast(done.schema[c].dataType).alias(c) for c in names], F.lit(False).alias("correction"))
    return done.unionByName(other)


def outliers(rows: DataFrame, tiers: list[tuple[float, float]]) -> DataFrame:
    """Adds ``outlier``: the price is further from the side's best than the first tier (best below a limit, share) allows."""
    w = Window.partitionBy("symbol", "side")
    top = F.when(is_buy(), F.max("price").over(w)).otherwise(F.min("price").over(w))
    share = F.lit(tiers[-1][1])
    for limit, s in reversed(tiers):
        share = F.when(top < limit, F.lit(s)).otherwise(share)
    return rows.withColumn("outlier", F.abs(F.col("price") - top) > top * share)


def snapshot_ended(index: Column, special_source: Column, exchange: Column) -> Column:
    """The end of a snapshot in old files: index zero, in a plain source or without exchange."""
    return (index.bitwiseAND(F.lit(0xFFFFFFFF)) == 0) & (~special_source | exchange.isNull() | (exchange == ""))
