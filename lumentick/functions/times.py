"""Days, times and periods."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_id(c: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(c.cast("date")).cast("long")


def yyyymmdd(day: Column) -> Column:
    """The number yyyymmdd of a day id."""
    return F.date_format(F.date_from_unix_date(day.cast("int")), "yyyyMMdd").cast("long")


def floor_div(a: Column, b: int) -> Column:
    """The quotient rounded down, exact for all longs."""
    a, b = (a, b) if b > 0 else (-a, -b)
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b)).cast("long")


def floor_mod(a: Column, b: int) -> Column:
    """a - b * floor(a / b): of the sign of ``b``."""
    return F.pmod(a, F.lit(b)).cast("long") if b > 0 else -F.pmod(-a, F.lit(-b)).cast("long")


def split_millis(millis: Column) -> tuple[Column, Column]:
    """Whole seconds (towards the past) and 0 to 999 milliseconds."""
    return floor_div(millis, 1000), floor_mod(millis, 1000)


def split_nanos(nanos: Column) -> tuple[Column, Column]:
    """Whole milliseconds (towards the past) and 0 to 999,999 nanoseconds."""
    return floor_div(nanos, 1_000_000), floor_mod(nanos, 1_000_000)


def joined_nanos(millis: Column, nanos: Column) -> Column:
    return millis * F.lit(1_000_000) + nanos


_DATE, _CLOCK, _ZONE = r"(\d{4})-?(\d{2})-?(\d{2})", r"(\d{2}):?(\d{2})(?::?(\d{2})(?:\.(\d{1,9}))?)?", r"([Zz]|[+-]\d{2}(?::?\d{2})?)?"
_WHOLE, _DAYTIME = f"^{_DATE}(?:[Tt -]{_CLOCK})? ?{_ZONE}$", f"^{_CLOCK} ?{_ZONE}$"
_AGO = r"^-[Pp]?(?=[0-9Tt])(?:(\d+)[Dd])?[Tt]?(?:(\d+)[Hh])?(?:(\d+)[Mm])?(?:(\d+(?:\.\d+)?)[Ss]?)?$"


def parsed(c: Column, zone: str = "UTC", now: Column | None = None) -> Column:
    """A time (UTC, without zone) of text, or null:

    ``yyyyMMdd`` or ``yyyy-MM-dd``, alone or with ``HH:mm[:ss[.f]]`` or ``HHmm[ss[.f]]`` after T, a hyphen or a
    space; a time alone (of today); each with ``Z``, ``+hh``, ``+hhmm`` or ``+hh:mm``, else in ``zone``;
    ``-`` and a period (before now); nine digits and more of epoch milliseconds; ``0``, the zero time.
    """
    now = (F.current_timestamp() if now is None else now.cast("timestamp"))
    part = lambda p, k, v: F.coalesce(F.nullif(F.regexp_extract(c, p, k), F.lit("")), v if isinstance(v, Column) else F.lit(v))
    utc = lambda t: F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))

    def at(day: Column, p: str, k: int) -> Column:
        z = F.upper(F.regexp_extract(c, p, k + 4))
        z = F.when(z == "", F.lit(f" {zone}")).when(z == "Z", "+00:00").otherwise(F.rpad(F.concat(F.substring(z, 1, 3), F.lit(":"), F.regexp_replace(F.substring(z, 4, 9), ":", "")), 6, "00"))
        text = F.concat(day, F.lit(" "), part(p, k, "00"), F.lit(":"), part(p, k + 1, "00"), F.lit(":"), part(p, k + 2, "00"), F.lit("."), F.substring(part(p, k + 3, "0"), 1, 6), z)
        return F.when(c.rlike(p), utc(text.try_cast("timestamp")))

    date = F.concat_ws("-", *[F.regexp_extract(c, _WHOLE, k) for k in (1, 2, 3)])
    today = F.date_format(F.convert_timezone(F.current_timezone(), F.lit(zone), now.cast("timestamp_ntz")), "yyyy-MM-dd")
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, _AGO, k), F.lit("")).try_cast("double"), F.lit(0.0))
    ago = number(1) * 86400 + number(2) * 3600 + number(3) * 60 + number(4)
    past = F.when(c.rlike(_AGO), utc(F.timestamp_micros((F.unix_micros(now) - F.rint(ago * 1e6)).cast("long"))))
    millis = F.when(c.rlike(r"^-?\d{9,}$") | (c == "0"), utc(F.timestamp_millis(c.try_cast("long"))))
    return F.coalesce(millis, at(date, _WHOLE, 4), at(today, _DAYTIME, 1), past)


def formatted(c: Column, form: str = "yyyyMMdd-HHmmss", millis: bool = False, zone: str = "") -> Column:
    """A time as text, with milliseconds and the text of a zone on request; a null is ``0``."""
    return F.coalesce(F.concat(F.date_format(c, form + (".SSS" if millis else "")), F.lit(zone)), F.lit("0"))


def week_range(day: Column, n: int = 1) -> Column:
    """first and end (exclusive) of the ``n`` weeks, counted from Monday 1970-01-05, that hold a day."""
    return _range(day, F.date_sub(day, floor_mod(F.unix_date(day) - 4, 7 * _counted(n)).cast("int")), lambda first: F.date_add(first, 7 * n))


def month_range(day: Column, n: int = 1) -> Column:
    """first and end (exclusive) of the ``n`` months, counted from January 1970, that hold a day."""
    back = floor_mod((F.year(day) - 1970) * 12 + F.month(day) - 1, _counted(n)).cast("int")
    return _range(day, F.add_months(F.trunc(day, "MM"), -back), lambda first: F.add_months(first, n))


def year_range(day: Column, n: int = 1) -> Column:
    """first and end (exclusive) of the ``n`` years, counted from 1970, that hold a day."""
    return _range(day, F.make_date(F.year(day) - floor_mod(F.year(day) - 1970, _counted(n)).cast("int"), F.lit(1), F.lit(1)), lambda first: F.add_months(first, 12 * n))


def _counted(n: int) -> int:
    if not 0 < n <= 1000:
        raise ValueError(f"from 1 to 1000 periods, not {n}")
    return n


def _range(day: Column, first: Column, end) -> Column:
    return F.struct(first.alias("first"), end(first).alias("end"))


def period(text: str) -> timedelta | None:
    """An ISO-8601 duration, case and the letters P, T and a last S optional; ``inf`` is None."""
    if text.strip().lower() == "inf":
        return None
    m = re.fullmatch(r"P?(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S?)?", text.strip().upper())
    if not m or not any(m.groups()):
        raise ValueError(f"not a period: {text!r}")
    d, h, mi, s = (float(x or 0) for x in m.groups())
    return timedelta(days=d, hours=h, minutes=mi, seconds=s)


def day_of_week(c: Column) -> Column:
    """1 for Monday to 7."""
    return (F.weekday(c) + 1).cast("long")


def with_day_of_week(c: Column, day: int) -> Column:
    """The day of the same week."""
    return F.date_add(c.cast("date"), F.lit(day) - (F.weekday(c) + 1))


def with_day_of_month(c: Column, day: int) -> Column:
    """The day of the same month; a negative one counts from its end (-1 is the last)."""
    d = c.cast("date")
    return F.date_add(F.last_day(d), day + 1) if day < 0 else F.date_add(F.trunc(d, "MM"), day - 1)
