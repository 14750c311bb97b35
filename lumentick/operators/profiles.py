"""Instrument profiles: merge, exclusion, checks, products, live collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentick.functions import lists

from .contracts import ticker_last


def merged(rows: DataFrame, order: str, fields: list[str], symbol: str = "symbol") -> DataFrame:
    """One row a symbol: of each field the last non-empty value in ``order``; ``first`` is the symbol's first place."""
    some = lambda f: F.when((F.col(f) != ""), F.struct(F.col(order), F.col(f)))
    return rows.groupBy(symbol).agg(F.min(order).alias("first"), *[F.coalesce(F.max(some(f))[f], F.lit("")).alias(f) for f in fields])


def conflicts(rows: DataFrame, fields: list[str], symbol: str = "symbol") -> DataFrame:
    """Fields in which a symbol has several different non-empty values."""
    out = rows.groupBy(symbol).agg(*[F.count_distinct(F.nullif(F.col(f), F.lit(""))).alias(f) for f in fields])
    return out.unpivot([symbol], fields, "field", "n").where("n > 1")


def excluded(rows: DataFrame, other: DataFrame, symbol: str = "symbol") -> DataFrame:
    return rows.join(other.select(symbol).distinct(), symbol, "left_anti")


def collected(updates: DataFrame, arrival: str, symbol: str = "symbol", removed: str = "REMOVED") -> DataFrame:
    """The instruments alive after all updates."""
    return ticker_last(updates, [symbol], [arrival]).where(F.col("type") != removed)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of equal parameters with more than one symbol."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("symbol").alias("symbol")).where("n > 1")


def common_prefix(names: Column) -> Column:
    """The common prefix of an array of strings without separators at its end: that of its least and its greatest."""
    a, b = F.array_min(names), F.array_max(names)
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))
    return F.regexp_replace(F.substr(a, F.lit(1), F.array_max(same)), r"[\s,;:/\-]+$", "")


#: Fields of a product that are taken from its futures, besides underlying: the first non-empty value of each.
PRODUCT_FIELDS = ("country", "opol", "exchange_data", "exchanges", "currency", "cfi", "icb", "sic", "trading_hours")


def products(futures: DataFrame, order: str, fields: list[str] | None = None) -> DataFrame:
    """One product a group of futures: each field's first non-empty value, descriptions cut to what they share.

    Without ``fields`` those of ``PRODUCT_FIELDS`` that the futures have.
    """
    fields = [f for f in PRODUCT_FIELDS if f in futures.columns] if fields is None else fields
    some = lambda f: F.col(f).cast("string") != "" if dict(futures.dtypes)[f] == "string" else F.col(f) != 0
    first = lambda f: F.coalesce(F.min(F.when(some(f), F.struct(F.col(order), F.col(f))))[f], F.lit("").cast(futures.schema[f].dataType))
    t = futures.where(F.col("product") != "").groupBy("product").agg(*[first(f).alias(f) for f in fields], F.min("description").alias("__a"), F.max("description").alias("__b"))
    return t.withColumn("description", common_prefix(F.array("__a", "__b"))).drop("__a", "__b")


def mixed_styles(options: DataFrame, style: str = "expiration_style", underlying: str = "underlying") -> DataFrame:
    """Underlyings whose options have several different non-empty exercise styles."""
    return options.groupBy(underlying).agg(F.count_distinct(F.nullif(F.col(style), F.lit(""))).alias("styles")).where("styles > 1")


def repeated_options(options: DataFrame, keys: list[str], flexible: Column) -> DataFrame:
    """``repeated`` without flexible options, which may share all parameters."""
    return repeated(options.where(~F.coalesce(flexible, F.lit(False))), keys)


def generated(spark, n: int, lengths: tuple[int, int] = (1, 5), triangular: bool = False, seed: int = 1) -> DataFrame:
    """``n`` different random symbols of capital letters; lengths even in a range, or with a peak in its middle."""
    low, high = lengths
    size = F.floor(F.rand(seed) * (high - low + 1)) + low if not triangular else F.rint((F.rand(seed) + F.rand(seed + 1)) / 2 * (high - low)) + low
    # The number itself, in base 26 behind the random letters, keeps symbols apart.
    letter = lambda x: F.char(F.lit(65) + x % 26)
    h = F.xxhash64("id", F.lit(seed))
    head = F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda k: letter(F.pmod(F.xxhash64(h, k), F.lit(26)).cast("int"))), "")
    tail = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: letter(F.pmod(F.floor(F.col("id") / F.pow(F.lit(26.0), k)), F.lit(26)).cast("int"))), "")
    return spark.range(n).select(F.concat(head, tail).alias("symbol"))


def sorted_profiles(rows: DataFrame, types: list[str]) -> DataFrame:
    """Adds ``place``: by type (in the order given, then by name), product, underlying, last trade, strike and symbol."""
    known = F.array(*[F.lit(x) for x in types])
    at = F.array_position(known, F.col("type"))
    # Numbered per type, so that no task holds the whole table; a type's rows follow those of the types before.
    w = Window.partitionBy("type").orderBy("product", "underlying", "last_trade", "strike", "symbol")
    return rows.withColumn("type_rank", F.when(at > 0, at).otherwise(F.lit(len(types) + 1)).cast("long")).withColumn("place", F.row_number().over(w).cast("long"))


# Statements that rewrite profiles, as functions from DataFrame to DataFrame.


def deleted(rows: DataFrame, condition: Column) -> DataFrame:
    """Without the rows that the condition holds for."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def primary(rows: DataFrame, symbol: Column) -> DataFrame:
    """Where ``symbol`` is one of the additional underlyings, it changes places with the underlying, shares per contract with it."""
    map_ = lists.underlyings(F.col("additional_underlyings"))
    hit = (F.col("underlying") != symbol) & F.map_contains_key(map_, symbol)
    others = F.filter(F.map_entries(map_), lambda e: (e["key"] != symbol) & (e["key"] != F.col("underlying")))
    rest = F.concat(others, F.array(F.struct(F.col("underlying").alias("key"), F.col("spc").cast("double").alias("value"))))
    made = {
        "additional_underlyings": F.when(hit, lists.entries_text(rest)).otherwise(F.col("additional_underlyings")),
        "underlying": F.when(hit, symbol).otherwise(F.col("underlying")), "spc": F.when(hit, F.try_element_at(map_, symbol)).otherwise(F.col("spc")),
    }
    # In two steps, so that no name means a column that the same step makes.
    t = rows.withColumn("__made", F.struct(*[c.alias(k) for k, c in made.items()]))
    return t.withColumns({k: F.col("__made")[k] for k in made}).drop("__made")


def renamed(rows: DataFrame, old: str, new: str) -> DataFrame:
    """An underlying's new name, also among the additional ones."""
    map_ = lists.underlyings(F.col("additional_underlyings"))
    hit = F.map_contains_key(map_, F.lit(old))
    rest = F.map_concat(F.map_filter(map_, lambda k, v: ~k.isin(old, new)), F.create_map(F.lit(new), F.try_element_at(map_, F.lit(old))))
    return rows.withColumns({
        "underlying": F.when(F.col("underlying") == old, new).otherwise(F.col("underlying")),
        "additional_underlyings": F.when(hit, lists.underlyings_text(rest)).otherwise(F.col("additional_underlyings")),
    })


def with_opol(rows: DataFrame, symbols: DataFrame, opol: str) -> DataFrame:
    """Another primary exchange for the listed symbols, in ``opol`` and in the ``exchanges`` list."""
    marked = rows.join(symbols.select(F.trim("symbol").alias("symbol"), F.lit(True).alias("__hit")).distinct(), "symbol", "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("opol") != opol)
    items = F.filter(F.split("exchanges", ";"), lambda x: (x != "") & (x != F.col("opol")))
    text = F.array_join(F.array_sort(F.concat(items, F.array(F.lit(opol)) if opol else F.array().cast("array<string>"))), ";")
    return marked.withColumns({"exchanges": F.when(hit, F.when(F.col("exchanges") == F.col("opol"), opol).otherwise(text)).otherwise(F.col("exchanges")), "opol": F.when(hit, opol).otherwise(F.col("opol"))}).select(*rows.columns)


def _short(c: Column) -> Column:
    """A number with six places at most, without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), r"0+$", ""), r"\.$", "")


def long_suffix(rows: DataFrame) -> DataFrame:
    """Equity options' symbols with month, side and strike in full: ``.IBM`` and the last six of mmy, C or P, the strike."""
    s = F.col("symbol")
    fits = (F.col("type") == "OPTION") & (F.length(s) >= 4) & s.startswith(".") & (F.substring(s, 2, 1) != "/")
    suffix = F.concat(F.substring("mmy", -6, 6), F.substring("cfi", 2, 1), _short(F.col("strike")))
    return rows.withColumn("symbol", F.when(fits & ~s.endswith(suffix), F.concat(F.substr(s, F.lit(1), F.length(s) - 2), suffix)).otherwise(s))


def exchange_product(rows: DataFrame, description: Column, multiplier: Column, future: Column, option: Column, strike: Column) -> DataFrame:
    """An exchange's product data on its profiles: description, multiplier, and conversions of prices and strikes.

    ``exchange_data`` has three items, the last the conversion so far. Descriptions have ``,,`` where a
    future's month goes (products lose it). Price increments are scaled from the old conversion to the
    new one. A conversion of 0 changes nothing.
    """
    kind, data = F.col("type"), F.split("exchange_data", ";")
    comma = F.instr(description, ",,")
    month = F.coalesce(F.when(F.length("mmy") == 6, F.date_format(F.try_to_date(F.concat("mmy", F.lit("01")), "yyyyMMdd"), "MMM-yyyy")), F.when(F.col("expiration") > 0, F.date_format(F.date_from_unix_date(F.col("expiration").cast("int")), "MMM-yyyy")))
    cut = lambda middle: F.concat(F.substr(description, F.lit(1), comma), middle, F.substr(description, comma + 1, F.length(description)))
    text = F.when(comma == 0, description).when(kind == "PRODUCT", F.concat(F.substr(description, F.lit(1), comma - 1), F.substr(description, comma + 1, F.length(description)))).when(month.isNull(), description).otherwise(cut(month))
    old, new = F.get(data, F.lit(2)).try_cast("double"), F.when(kind == "FUTURE", future).when(kind == "OPTION", option)
    dated = kind.isin("FUTURE", "OPTION")
    converts = F.coalesce(dated & (new != 0) & (new != old), F.lit(False))
    step = lambda x: F.array_join(F.transform(F.split(F.trim(x), " +"), lambda v, i: F.when(i == 0, _short(v.try_cast("double") * old / new)).otherwise(_short(v.try_cast("double") * old / new))), " ")
    moved = F.coalesce((kind == "OPTION") & (strike != 0) & (strike != 1), F.lit(False))
    struck = lists.canonical(F.col("strike") * strike)
    named = F.concat(F.regexp_replace(F.substring_index("symbol", ":", 1), r"[0-9.-]*$", ""), _short(struck), F.regexp_extract("symbol", r"(:.*)$", 1))
    return rows.withColumns({
        "description": F.when(kind.isin("PRODUCT", "FUTURE") & (description != ""), text).otherwise(F.col("description")),
        "multiplier": F.when(dated & (multiplier != 0), multiplier).otherwise(F.col("multiplier")),
        "exchange_data": F.when(converts, F.concat_ws(";", data[0], data[1], _short(new))).otherwise(F.col("exchange_data")),
        "price_increments": F.when(converts, F.array_join(F.transform(F.split("price_increments", ";"), step), "; ")).otherwise(F.col("price_increments")),
        "symbol": F.when(moved, named).otherwise(F.col("symbol")), "strike": F.when(moved, struck).otherwise(F.col("strike")),
    })


def counted_changes(rows: DataFrame, statement: Callable[[DataFrame], DataFrame], fields: list[str]) -> DataFrame:
    """How many rows a statement changed in each field, and in all of them together (field ``*``).

    A row takes its former values along, so rows of one symbol stay apart, and the symbol may change too.
    """
    t = statement(rows.withColumn("__before", F.struct(*fields)))
    differs = {f: ~F.col("__before")[f].eqNullSafe(F.col(f)) for f in fields}
    any_ = F.lit(False)
    for x in differs.values():
        any_ = any_ | x
    out = t.agg(F.array(*[F.struct(F.lit(f).alias("field"), F.count_if(x).alias("n")) for f, x in (differs | {"*": any_}).items()]).alias("each"))
    return out.select(F.inline("each"))
