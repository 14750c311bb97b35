"""Field visibility and replacement."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def visible(df: DataFrame, rules: list[tuple[bool, str]]) -> DataFrame:
    """Only the fields whose last matching rule (shown, pattern) shows them; without one they are shown."""
    return df.select(*[c for c in df.columns if next((show for show, p in reversed(rules) if re.fullmatch(p, c)), True)])


def set_field(df: DataFrame, records: Column, target: str, source: str) -> DataFrame:
    return df.withColumn(target, F.when(records, F.col(source)).otherwise(F.col(target)))


def set_value(df: DataFrame, records: Column, target: str, value) -> DataFrame:
    return df.withColumn(target, F.when(records, F.lit(value)).otherwise(F.col(target)))


def shift_time(df: DataFrame, records: Column, target: str, seconds: float) -> DataFrame:
    return df.withColumn(target, F.when(records, F.col(target) + F.make_dt_interval(secs=F.lit(seconds))).otherwise(F.col(target)))


def set_time(df: DataFrame, records: Column, targets: list[str], at=None) -> DataFrame:
    """Time fields set to one time: a constant, or now, the same for all rows of a query."""
    now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    value = now if at is None else F.lit(at)
    return df.withColumns({c: F.when(records, value.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in targets})


def shift_day(df: DataFrame, records: Column, target: str, days: int) -> DataFrame:
    return df.withColumn(target, F.when(records, F.date_add(target, days)).otherwise(F.col(target)))


def set_day(df: DataFrame, records: Column, targets: list[str], day=None) -> DataFrame:
    """Day fields set to a constant day, or to today."""
    value = F.current_date() if day is None else F.lit(day)
    return df.withColumns({c: F.when(records, value.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in targets})


def retain(df: DataFrame, fields: list[str]) -> DataFrame:
    """All text fields but those given are made empty."""
    return df.select(*[F.lit("").alias(c) if t == "string" and c not in fields else F.col(c) for c, t in df.dtypes])


def projected(df: DataFrame, fields: dict[str, Column | str], defaults: dict[str, object] | None = None) -> DataFrame:
    """An event's fields from a record's: each a column's name or an expression; nulls of ``defaults``' fields get these values."""
    out = df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in (defaults or {}).items()})


def shaped(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Only the fields of a scheme, in its order: unknown ones are skipped, absent ones null or defaulted."""
    defaults = defaults or {}
    at = lambda f: F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
    return df.select(*[at(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def arithmetic(kind: str, a: Column, b: Column, types: tuple[str, str]) -> Column:
    """``a kind b`` of profile fields: number and date, ``+ - * / %``; division by zero as doubles do it.

    date - date is a number of days, date + number and number + date are dates, string + string joins;
    every other mix is an error.
    """
    if types == ("number", "number"):
        a, b = a.cast("double"), b.cast("double")
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        by_zero = F.when((a == 0) | F.isnan(a), nan).otherwise(F.signum(a) * inf)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)), "%": lambda: F.when(b == 0, nan).otherwise(F.try_mod(a, b))}[kind]()
    if types == ("string", "string") and kind == "+":
        return F.concat(a, b)
    if types == ("date", "date") and kind == "-":
        return F.date_diff(a, b).cast("double")
    if types == ("date", "number") and kind in "+-":
        return F.date_add(a, (b if kind == "+" else -b).cast("int"))
    if types == ("number", "date") and kind == "+":
        return F.date_add(b, a.cast("int"))
    raise TypeError(f"{types[0]} {kind} {types[1]}")


def cast(c: Column, source: str, target: str) -> Column:
    """Between boolean, date (days since 1970), number and string; text that is no value gives null."""
    if source == target:
        return c
    if target == "string":
        return F.when(c, "true").otherwise("false") if source == "boolean" else F.date_format(c, "yyyy-MM-dd") if source == "date" else F.regexp_replace(c.cast("double").cast("string"), r"\.0$", "")
    if target == "boolean":
        return F.lower(c) == "true" if source == "string" else c.cast("double") != 0 if source == "number" else c.isNotNull()
    if target == "date":
        return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyyMMdd")) if source == "string" else F.date_from_unix_date(c.cast("int"))
    return c.try_cast("double") if source == "string" else F.unix_date(c).cast("double") if source == "date" else c.cast("double")
