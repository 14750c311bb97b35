"""Candle symbols such as ``IBM&Q{=5m,a=s,dt=all,pl=0.1,price=bid,tho=true}``: their parts, their normal form, their periods.

Without an attribute a candle is of single ticks, of last prices, of all sessions, aligned to midnight,
without price levels. Values that name nothing give null parts, and stay as they are in the normal form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import base_symbol, bound, exchange_code, listed, pairs, value_of, with_pairs

#: Period types in their order, with their short names and milliseconds (0: no time; months and years roundly).
TYPES = {
    "TICK": ("t", 0), "SECOND": ("s", 1_000), "MINUTE": ("m", 60_000), "HOUR": ("h", 3_600_000), "DAY": ("d", 86_400_000), "WEEK": ("w", 604_800_000), "MONTH": ("mo", 2_592_000_000), "OPTEXP": ("o", 2_592_000_000),
    "YEAR": ("y", 31_536_000_000), "VOLUME": ("v", 0), "PRICE": ("p", 0), "PRICE_MOMENTUM": ("pm", 0), "PRICE_RENKO": ("pr", 0),
}
#: Prices and alignments.
PRICES, ALIGNMENTS = ("last", "bid", "ask", "mark", "s"), ("m", "s")
NUMBER = r"^[0-9.eE+-]*"


def period_type(c: Column) -> Column:
    """The short name of a type given by its short name, by the beginning of its name, or by its name and an s; null for others."""

    def named(both: Column) -> Column:
        out, x, upper = F.lit(None).cast("string"), both["x"], both["upper"]
        for name, (short, _) in reversed(TYPES.items()):
            begins = (F.length(x) > 0) & F.lit(name).startswith(upper)
            out = F.when(begins | (x.endswith("s") & (upper == name + "S")), short).otherwise(out)
        return F.when(x.isin(*[short for short, _ in TYPES.values()]), x).otherwise(out)

    return bound(bound(c, lambda x: F.struct(x.alias("x"), F.upper(x).alias("upper"))), named)


def period_value(c: Column) -> Column:
    """The number before the type; 1 without one."""
    text = F.regexp_extract(c, NUMBER, 0)
    return F.when(text == "", 1.0).otherwise(text.try_cast("double"))


def _plain(x: Column) -> Column:
    """A number without a point where it is whole."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("long").cast("string")).otherwise(x.cast("string"))


def period(c: Column) -> Column:
    """The shortest spelling of a period: ``15Minutes`` and ``15min`` give ``15m``, ``1day`` gives ``d``; null if it is none."""

    def spelt(p: Column) -> Column:
        return F.when(p["value"] == 1, p["kind"]).otherwise(F.concat(_plain(p["value"]), p["kind"]))

    return bound(bound(c, lambda x: F.struct(period_value(x).alias("value"), period_type(F.regexp_replace(x, NUMBER, "")).alias("kind"))), spelt)


def period_millis(c: Column) -> Column:
    """Milliseconds of a period; 0 where it is not a time, null where it is no period."""
    table = F.create_map(*[x for short, millis in TYPES.values() for x in (F.lit(short), F.lit(millis).cast("long"))])
    millis = F.try_element_at(table, period_type(F.regexp_replace(c, NUMBER, "")))
    return (period_value(c) * millis).cast("long")


def _beginning(c: Column, names: tuple[str, ...]) -> Column:
    """The name that ``c`` is, or the first that it begins."""

    def named(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(names):
            out = F.when((F.length(x) > 0) & F.lit(name).startswith(F.lower(x)), name).otherwise(out)
        return F.when(x.isin(*names), x).otherwise(out)

    return bound(c, named)


def _level(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), _plain(x))


def normal(c: Column) -> Column:
    """With each attribute in its shortest spelling; an empty data type goes. What is no valid value stays."""

    def shortest(e: Column) -> Column:
        key, value = e["key"], e["value"]
        small = F.lower(value)
        found = F.when(key == "price", _beginning(value, PRICES)).when(key == "tho", F.when(small == "true", "true")).when(key == "", period(value)).when(key == "a", F.when(small.isin(*ALIGNMENTS), small)).when(key == "pl", _level(value))
        return F.struct(key.alias("key"), F.coalesce(found, value).alias("value"))

    return with_pairs(c, F.filter(F.transform(pairs(c), shortest), lambda e: (e["key"] != "dt") | (e["value"] != "")))


def parts(c: Column) -> Column:
    """base, exchange, period, price, tho, alignment, level (null: none) and data_type of a candle symbol."""

    def found(all_: Column) -> Column:
        step, price, align = (F.coalesce(value_of(all_, k), F.lit(v)) for k, v in (("", "t"), ("price", "last"), ("a", "m")))
        return F.struct(
            base_symbol(c).alias("base"), exchange_code(c).alias("exchange"), period(step).alias("period"), _beginning(price, PRICES).alias("price"), (F.lower(F.coalesce(value_of(all_, "tho"), F.lit(""))) == "true").alias("tho"),
            bound(F.lower(align), lambda x: F.when(x.isin(*ALIGNMENTS), x)).alias("alignment"), value_of(all_, "pl").try_cast("double").alias("level"), F.coalesce(value_of(all_, "dt"), F.lit("")).alias("data_type"),
        )

    return bound(listed(c), found)
