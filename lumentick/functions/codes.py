"""Codes: instrument classes, order sources, event flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ISO 10962 categories.
CFI_CATEGORIES = {
    "E": "Equities", "C": "Collective investment vehicles", "D": "Debt instruments", "R": "Entitlements", "O": "Listed options", "F": "Futures", "S": "Swaps", "H": "Non-listed and complex listed options",
    "I": "Spot", "J": "Forwards", "K": "Strategies", "L": "Financing", "T": "Referential instruments", "M": "Others",
}


def cfi_category(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CFI_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring(c, 1, 1)), F.lit("Unknown"))


def source_id(c: Column) -> Column:
    """Up to four characters, eight bits each."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a * 256 + F.ascii(x))


def source_name(c: Column) -> Column:
    """The characters of a source id."""
    parts = F.filter(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.call_function("shiftright", c, s).bitwiseAND(F.lit(255))), lambda x: x > 0)
    return F.array_join(F.transform(parts, lambda x: F.char(x)), "")


def has_flag(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask)) != 0


#: Groups of the categories that market data has most, by the first two letters.
CFI_GROUPS = {
    "ES": "Common/Ordinary shares", "EP": "Preferred/Preference shares", "EC": "Common/Ordinary convertible shares", "EF": "Preferred/Preference convertible shares", "EL": "Limited partnership units", "ED": "Depositary receipts on equities",
    "CI": "Standard (vanilla) investment funds/mutual funds", "CH": "Hedge funds", "CB": "Real estate investment trusts (REIT)", "CE": "Exchange traded funds (ETF)", "DB": "Bonds", "DC": "Convertible bonds", "DT": "Medium-term notes",
    "DY": "Money market instruments", "RA": "Allotment (bonus) rights", "RS": "Subscription rights", "RW": "Warrants", "OC": "Call options", "OP": "Put options", "FF": "Financial futures", "FC": "Commodities futures", "TC": "Currencies", "TI": "Indices",
}
#: The four attributes of some groups, by position and letter.
CFI_ATTRIBUTES = {
    "O": ({"A": "American", "E": "European", "B": "Bermudan"}, {"B": "Baskets", "S": "Stock-Equities", "D": "Debt instruments", "T": "Commodities", "C": "Currencies", "I": "Indices", "O": "Options", "F": "Futures", "W": "Swaps", "N": "Interest rates", "M": "Others"},
          {"P": "Physical", "C": "Cash", "N": "Non-deliverable", "E": "Elect at exercise"}, {"S": "Standardized", "N": "Non-standardized"}),
    "F": ({"B": "Baskets", "S": "Stock-Equities", "D": "Debt instruments", "C": "Currencies", "I": "Indices", "O": "Options", "F": "Futures", "W": "Swaps", "N": "Interest rates", "V": "Stock dividend", "A": "Agriculture", "E": "Extraction resources", "M": "Others"},
          {"P": "Physical", "C": "Cash", "N": "Non-deliverable"}, {"S": "Standardized", "N": "Non-standardized"}, {}),
    "E": ({"V": "Voting", "N": "Non-voting", "R": "Restricted voting", "E": "Enhanced voting"}, {"T": "Restrictions", "U": "Free"}, {"F": "Fully paid", "O": "Nil paid", "P": "Partly paid"}, {"B": "Bearer", "R": "Registered", "N": "Bearer/Registered", "M": "Others"}),
}


def named(c: Column, table: dict[str, str], other: str | None = None) -> Column:
    """A code's name; ``other`` for codes that the table lacks."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c) if table else F.lit(None).cast("string")
    return found if other is None else F.coalesce(found, F.lit(other))


def coded(c: Column, table: dict[str, str]) -> Column:
    """A name's code."""
    return named(c, {v: k for k, v in table.items()})


def cfi(c: Column) -> Column:
    """category, group and the four attributes' names of a CFI code; X and unknown letters have none."""
    parts = [cfi_category(c).alias("category"), named(F.substring(c, 1, 2), CFI_GROUPS).alias("group")]
    for k in range(4):
        out = F.lit(None).cast("string")
        for category, tables in CFI_ATTRIBUTES.items():
            out = F.when(F.substring(c, 1, 1) == category, named(F.substring(c, 3 + k, 1), tables[k])).otherwise(out)
        parts.append(out.alias(f"attribute{k + 1}"))
    return F.struct(*parts)


def described_cfi(c: Column) -> Column:
    """The names of a CFI code in one text: ``Listed options; Call options; American; ...``."""
    d = cfi(c)
    return F.concat_ws("; ", *[d[x] for x in ("category", "group", "attribute1", "attribute2", "attribute3", "attribute4")])


#: Codes of sides, scopes, price types, trading statuses and order actions.
SIDES = {"0": "UNDEFINED", "1": "BUY", "2": "SELL"}
SCOPES = {"0": "COMPOSITE", "1": "REGIONAL", "2": "AGGREGATE", "3": "ORDER"}
PRICE_TYPES = {"0": "REGULAR", "1": "INDICATIVE", "2": "PRELIMINARY", "3": "FINAL"}
TRADING_STATUSES = {"0": "UNDEFINED", "1": "HALTED", "2": "ACTIVE"}
SHORT_SALE = {"0": "UNDEFINED", "1": "ACTIVE", "2": "INACTIVE"}
ACTIONS = {"0": "UNDEFINED", "1": "NEW", "2": "REPLACE", "3": "MODIFY", "4": "DELETE", "5": "PARTIAL", "6": "EXECUTE", "7": "TRADE", "8": "BUST"}
DIRECTIONS = {"0": "UNDEFINED", "1": "DOWN", "2": "ZERO_DOWN", "3": "ZERO", "4": "ZERO_UP", "5": "UP"}
