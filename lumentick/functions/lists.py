"""Fields that hold sorted lists with ``;`` between items, and other profile expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _items(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")


def _checked(item: str) -> str:
    if ";" in item:
        raise ValueError(f"an item can't hold a semicolon: {item!r}")
    return item


def has_item(c: Column, item: str) -> Column:
    """Whether the list holds the item; an empty item is in no list."""
    return F.array_contains(_items(c), F.lit(_checked(item))) if item else F.lit(False)


def add_item(c: Column, item: str) -> Column:
    """With the item before the first larger one, once."""
    _checked(item)
    items = _items(c)
    at = F.array_position(F.transform(items, lambda x: x > item), F.lit(True)).cast("int")
    at = F.when(at > 0, at).otherwise(F.size(items) + 1)
    return F.when(has_item(c, item) | F.lit(item == ""), F.coalesce(c, F.lit(""))).otherwise(F.array_join(F.array_insert(items, at, F.lit(item)), ";"))


def remove_item(c: Column, item: str) -> Column:
    return F.array_join(F.array_remove(_items(c), F.lit(_checked(item))), ";")


def like(c: Column, pattern: str) -> Column:
    """Whether the whole value matches a regular expression."""
    return F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))


def replace_first(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", "$1" + by)


def canonical(c: Column, digits: int = 14) -> Column:
    """A number rounded to 14 significant digits."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    unit = F.pow(F.lit(10.0), F.abs(places))
    near = F.when(places >= 0, F.rint(c * unit) / unit).otherwise(F.rint(c / unit) * unit)
    # Beyond these powers of ten a scale is no number any more, and a value is left as it is.
    return F.when((c == 0) | F.isnan(c) | (F.abs(c) < 1e-290) | (F.abs(c) > 1e300), c).otherwise(near)


def choose(selector: Column, cases: dict[tuple[str, ...], Column], default: Column) -> Column:
    """The value of the first case that names the selector."""
    out = default
    for names, value in reversed(list(cases.items())):
        out = F.when(selector.isin(*names), value).otherwise(out)
    return out


def underlyings(c: Column) -> Column:
    """``SE 50;FSLR 20`` as a map from symbol to shares per contract; of a repeated symbol the first counts."""
    pairs = F.filter(F.split(F.coalesce(c, F.lit("")), r";\s*"), lambda x: x != "")
    named = F.transform(pairs, lambda x: F.struct(F.substring_index(x, " ", 1).alias("k"), F.substring_index(x, " ", -1).try_cast("double").alias("v")))
    keys = F.transform(named, lambda x: x["k"])
    return F.map_from_entries(F.filter(named, lambda x, i: F.array_position(keys, x["k"]) == i + 1))


def underlyings_text(c: Column) -> Column:
    """The text of such a map, by symbol; whole numbers without a point."""
    return entries_text(F.map_entries(c))


def entries_text(c: Column) -> Column:
    """The same of an array of (key, value)."""
    number = lambda v: F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))
    return F.array_join(F.transform(F.array_sort(c), lambda e: F.concat(e["key"], F.lit(" "), number(e["value"]))), ";")


def shares(c: Column, symbol: Column) -> Column:
    """Shares of ``symbol`` among additional underlyings; 0 without it."""
    return F.coalesce(F.try_element_at(underlyings(c), symbol), F.lit(0.0))
