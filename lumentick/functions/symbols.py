"""Parts of symbols such as ``SPY&N{=5m,price=bid}``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that it names several times, computed once a row."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def base_symbol(c: Column) -> Column:
    """Without exchange code and attributes."""
    return F.regexp_replace(F.regexp_replace(c, r"\{[^}]*\}$", ""), r"&[A-Z]$", "")


def exchange_code(c: Column) -> Column:
    """The letter after ``&``, or an empty string."""
    return F.regexp_extract(c, r"&([A-Z])(?:\{[^}]*\})?$", 1)


def with_exchange(c: Column, code: str) -> Column:
    """With another exchange code; an empty one removes it."""
    attributes = F.regexp_extract(c, r"(\{[^}]*\})$", 1)
    return F.concat(base_symbol(c), F.lit(f"&{code}" if code else ""), attributes)


def listed(c: Column) -> Column:
    """The attributes as an array of (key, value), as written; the one without a name has an empty key."""
    inner = F.regexp_extract(c, r"\{([^}]*)\}$", 1)
    return F.transform(F.filter(F.split(inner, ","), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_replace(x, "^[^=]*=?", "").alias("value")))


def pairs(c: Column) -> Column:
    """The same, the first of each key."""
    first = lambda all_, keys: F.filter(all_, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return bound(listed(c), lambda all_: bound(F.transform(all_, lambda x: x["key"]), lambda keys: first(all_, keys)))


def value_of(found: Column, key: str) -> Column:
    """The first value of a key in an array of (key, value); null without it."""
    return F.get(F.filter(found, lambda x: x["key"] == key), F.lit(0))["value"]


def attributes(c: Column) -> Column:
    """A map of the attributes; of a repeated key the first one counts."""
    return F.map_from_entries(pairs(c))


def attribute(c: Column, key: str) -> Column:
    """An attribute's value; null without it."""
    return value_of(listed(c), key)


def with_attribute(c: Column, key: str, value: str | Column | None) -> Column:
    """With an attribute set (None removes it); attributes stay in the order of their keys."""
    rest = F.filter(pairs(c), lambda x: x["key"] != key)
    if value is not None:
        rest = F.concat(rest, F.array(F.struct(F.lit(key).alias("key"), (F.lit(value) if isinstance(value, str) else value).alias("value"))))
    return with_pairs(c, rest)


def with_pairs(c: Column, found: Column) -> Column:
    """With other attributes, an array of (key, value), in the order of their keys."""
    text = F.array_join(F.transform(F.array_sort(found), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    head = F.regexp_replace(c, r"\{[^}]*\}$", "")
    return bound(text, lambda t: F.when(t == "", head).otherwise(F.concat(head, F.lit("{"), t, F.lit("}"))))


def spread_symbol(legs: Column) -> Column:
    """``=A+2*B-C`` of an array of (symbol, quantity): larger quantities first, then by symbol (backwards for negative ones).

    Legs of quantity 0 are left out; a single leg of quantity 1 is the symbol itself; no legs give an empty symbol.
    """

    def place(x: Column, y: Column) -> Column:
        by_name = F.when(x["symbol"] < y["symbol"], -1).when(x["symbol"] > y["symbol"], 1).otherwise(0)
        return F.when(x["quantity"] > y["quantity"], -1).when(x["quantity"] < y["quantity"], 1).otherwise(F.when(x["quantity"] < 0, -by_name).otherwise(by_name))

    def leg(x: Column) -> Column:
        size = F.abs(x["quantity"])
        number = F.when((size == F.floor(size)) & (size < 2**31), size.cast("long").cast("string")).otherwise(size.cast("string"))
        return F.concat(F.when(x["quantity"] < 0, "-").otherwise("+"), F.when(size == 1, "").otherwise(F.concat(number, F.lit("*"))), x["symbol"])

    some = F.array_sort(F.filter(legs, lambda x: x["quantity"] != 0), place)
    text = F.concat(F.lit("="), F.regexp_replace(F.array_join(F.transform(some, leg), ""), r"^\+", ""))
    one = F.get(some, F.lit(0))
    return F.when(F.size(some) == 0, "").when((F.size(some) == 1) & (one["quantity"] == 1), one["symbol"]).otherwise(text)


def exchanges(pattern: str) -> str:
    """The exchange codes A to Z that a character class (brackets may be left out) holds; others are an error."""
    if not pattern:
        return ""
    cls = re.compile(pattern if pattern[0] in "[\\" else f"[{pattern}]")
    found = [chr(k) for k in range(128) if cls.fullmatch(chr(k))]
    if wrong := [x for x in found if not "A" <= x <= "Z"]:
        raise ValueError(f"no exchange codes: {', '.join(wrong)}")
    return "".join(found)


def option_suffix(c: Column) -> Column:
    """The root of an option symbol padded to six characters before its 15 last ones."""
    n = F.length(c)
    return F.concat(F.rpad(F.substr(c, F.lit(1), n - 15), 6, " "), F.right(c, F.lit(15)))
