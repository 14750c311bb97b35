"""Symbol and record filters as Column conditions; combine them with &, | and ~."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .symbols import base_symbol

#: The multiplier of the hash groups.
HASH_FACTOR = 0xB46394CD

#: Symbol classes by pattern, over whole symbols.
CLASSES = {
    "fx": r"[A-Z]{3,4}/[A-Z]{3}([#{:].*)?",
    "prod": r"/[A-Z0-9]{1,3}([{:].*)?",
    "fut": r"/.*",
    "ind": r"\$.*",
    "spread": r"=.*",
    "futopt": r"\./.*",
    "bsopt": r"\.[^/].*",
    "bs": r"[^/.=].*",
    "opt": r"\..*",
    "cs": r"[^.].*",
    "csopt": r"\.[^/].*",
}


def glob(c: Column, pattern: str) -> Column:
    """``*`` stands for any text (two of them at most), ``[A-K]`` for a character class; ``!`` first negates.

    Text between ``\\Q`` and ``\\E`` stands for itself. The wildcard symbol passes every pattern.
    """
    negated = pattern.startswith("!")
    body = pattern[1:] if negated else pattern
    parts = re.findall(r"\\Q.*?\\E|\[[^\]]+\]|\*|[^\[*\\]+|.", body, re.S)
    stars = [k for k, p in enumerate(parts) if p == "*"]
    if len(stars) > 2 or stars[1:] == [k + 1 for k in stars[:1]]:
        raise ValueError(f"{pattern!r}: at most two separate * are allowed")
    if re.match(r"[a-z]", body):
        raise ValueError(f"{pattern!r}: leading lower-case letters are reserved")
    java = ""
    for p in parts:
        if p in ("[", "\\"):
            raise ValueError(f"{pattern!r}: an open class or quote")
        if p == "*":
            java += ".*"
        elif p[0] == "[":
            # Letters, digits and ranges keep their meaning; marks of the regular expression's classes don't.
            java += "[" + re.sub(r"([\[\\&~|])", r"\\\1", p[1:-1]) + "]"
        else:
            java += "".join("\\" + x if not x.isalnum() and x.isascii() else x for x in (p[2:-2] if p.startswith("\\Q") else p))
    found = c.rlike(f"^(?s:{java})$")
    return (c == "*") | (~found if negated else found)


def record_glob(record: Column, pattern: str) -> Column:
    """A pattern of record names; the colon that marks it is optional."""
    return glob(record, pattern.removeprefix(":"))


def java_hash(c: Column) -> Column:
    """The 32-bit string hash s[0]*31^(n-1) + ... over UTF-16 units, as an unsigned number."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    high = lambda x: F.lit(0xD800) + F.call_function("div", x - F.lit(0x10000), F.lit(0x400))
    units = F.flatten(F.transform(codes, lambda x: F.when(x > 0xFFFF, F.array(high(x), F.lit(0xDC00) + (x - F.lit(0x10000)) % 0x400)).otherwise(F.array(x))))
    return F.aggregate(units, F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % F.lit(1 << 32))


def hash_group(c: Column, n: int) -> Column:
    """The group 0 to n-1 of a symbol, ``n`` a power of two."""
    shift = 32 - (n.bit_length() - 1)
    h, high, low = java_hash(c), HASH_FACTOR >> 16, HASH_FACTOR & 0xFFFF
    product = ((h * F.lit(high) % F.lit(1 << 32)) * F.lit(1 << 16) + h * F.lit(low)) % F.lit(1 << 32)
    return F.shiftrightunsigned(product, shift)


def ranged(c: Column, low: str = "", high: str = "") -> Column:
    """low <= symbol < high, after an optional spread prefix and leading marks; an empty bound is none."""
    core = F.regexp_extract(c, r"^(?:=[+-]?(?:[0-9.]+\*)?)?[^A-Za-z0-9]*(.*)$", 1)
    ok = F.lit(True)
    if low:
        ok = ok & (core >= low)
    if high:
        ok = ok & (core < high)
    return ok


def of_class(c: Column, name: str) -> Column:
    return c.rlike(f"^{CLASSES[name]}$")


def category(c: Column) -> Column:
    """The first class that a symbol is in, in a fixed order."""
    out = F.lit("OTHER")
    for name in reversed(("fx", "fut", "ind", "spread", "futopt", "bsopt")):
        out = F.when(of_class(c, name), name).otherwise(out)
    return out


def composite(record: Column) -> Column:
    """Records without a regional suffix."""
    return ~record.contains("&")


def regional(record: Column) -> Column:
    return record.rlike("&[A-Z]$")


def listed(rows: DataFrame, symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Rows whose base symbol is in a reference list."""
    base = symbols.select(base_symbol(F.col("symbol")).alias("__base")).distinct()
    return rows.join(base, base_symbol(F.col(symbol)) == F.col("__base"), "left_semi")


def stripe(c: Column, n: int) -> Column:
    """The stripe of a symbol among ``n`` by hash, for repartitioning."""
    return hash_group(c, n)


def range_stripe(c: Column, bounds: list[str]) -> Column:
    """The stripe of a symbol among ranges cut at ascending ``bounds``."""
    out = F.lit(0)
    for b in bounds:
        out = out + (~ranged(c, "", b)).cast("int")
    return out
