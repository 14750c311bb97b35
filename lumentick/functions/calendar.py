"""Trading calendars as tables of days and sessions, from short definitions.

``tz=America/New_York;hd=20200101,20200120;sd=20201127;sds=ec0300;td=12345;0=p04000930r09301600a16002000``:
time zone, holidays, short days and their early close, trading weekdays (1 Monday), and the sessions
of a day: letters p, r, a with pairs of hhmm.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"p": "PRE_MARKET", "r": "REGULAR", "": "REGULAR", "a": "AFTER_MARKET"}
DAYS = "day date, trading boolean, short boolean"
SESSIONS = "day date, kind string, open timestamp_ntz, close timestamp_ntz"


def definition(text: str) -> dict[str, str]:
    out = {}
    for part in filter(None, text.split(";")):
        *keys, value = part.split("=")
        out |= dict.fromkeys(keys, value)
    if "tz" not in out:
        raise ValueError("a calendar needs a time zone")
    return out


def _dates(text: str) -> set[str]:
    """Comma-separated days; ``-`` takes one out, ``*`` keeps only it."""
    out: set[str] = set()
    for item in filter(None, text.split(",")):
        out = out - {item[1:]} if item[0] == "-" else out & {item[1:]} if item[0] == "*" else out | {item}
    return out


def _sessions(text: str) -> list[tuple[str, int, int]]:
    """(kind, from, to) in minutes of the day."""
    out = []
    for letter, times in re.findall(r"([pra]?)((?:\d{8})+)", text):
        for k in range(0, len(times), 8):
            a, b = times[k : k + 4], times[k + 4 : k + 8]
            out.append((KINDS[letter if k == 0 else "r"], int(a[:2]) * 60 + int(a[2:]), int(b[:2]) * 60 + int(b[2:])))
    return out


def calendar(spark: SparkSession, text: str, first: date, last: date) -> tuple[DataFrame, DataFrame]:
    """Days and sessions (in UTC) of a range; there are as many rows as days, and few sessions a day."""
    d = definition(text)
    zone, holidays, shorts = ZoneInfo(d["tz"]), _dates(d.get("hd", "")), _dates(d.get("sd", ""))
    weekdays = {int(x) for x in d.get("td", "12345")}
    early = re.search(r"ec(\d{2})(\d{2})", d.get("sds", ""))
    cut = int(early[1]) * 60 + int(early[2]) if early else 0
    days, sessions = [], []
    at = first
    while at <= last:
        key = at.strftime("%Y%m%d")
        trading, short = at.isoweekday() in weekdays and key not in holidays, key in shorts
        days.append((at, trading, short))
        plan = _sessions(d.get(str(at.isoweekday()), d.get("0", ""))) if trading else []
        for kind, a, b in plan:
            b = max(a, b - cut) if short and kind == "REGULAR" else b
            utc = [(datetime(at.year, at.month, at.day, tzinfo=zone) + timedelta(minutes=x)).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for x in (a, b)]
            sessions.append((at, kind, *utc))
        at += timedelta(days=1)
    return spark.createDataFrame(days, DAYS), spark.createDataFrame(sessions, SESSIONS)


def sessions_on(days: DataFrame, text: str) -> DataFrame:
    """Sessions (in UTC) of each row of ``days`` (day), by Column functions: as lazy as the days themselves."""
    d = definition(text)
    minutes = int((m := re.search(r"ec(\d{2})(\d{2})", d.get("sds", ""))) and m[1] or 0) * 60 + int(m and m[2] or 0)
    marked = marked_days(days, text)
    number = F.weekday("day") + 1
    plan = lambda x: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in _sessions(x)]) if _sessions(x) else F.array().cast("array<struct<kind:string,a:int,b:int>>")
    chosen = plan(d.get("0", ""))
    for k in range(1, 8):
        if str(k) in d:
            chosen = F.when(number == k, plan(d[str(k)])).otherwise(chosen)
    t = marked.where("trading").select("day", "short", F.explode(chosen).alias("s"))
    end = F.when(F.col("short") & (F.col("s.kind") == "REGULAR"), F.greatest(F.col("s.a"), F.col("s.b") - minutes)).otherwise(F.col("s.b"))
    at = lambda x: F.convert_timezone(F.lit(d["tz"]), F.lit("UTC"), F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=x))
    return t.select("day", F.col("s.kind").alias("kind"), at(F.col("s.a")).alias("open"), at(end).alias("close"))


def marked_days(days: DataFrame, text: str) -> DataFrame:
    """(day, trading, short) of each row of ``days`` (day)."""
    d = definition(text)
    key = F.date_format("day", "yyyyMMdd")
    inside = lambda x: key.isin(*x) if x else F.lit(False)
    trading = (F.weekday("day") + 1).isin(*[int(x) for x in d.get("td", "12345")]) & ~inside(sorted(_dates(d.get("hd", ""))))
    return days.select("day", trading.alias("trading"), inside(sorted(_dates(d.get("sd", "")))).alias("short"))


def session_of(rows: DataFrame, sessions: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the ``kind`` of the session that holds their time, NO_TRADING outside all and for a null time.

    A day's few sessions are gathered into one row, so that each row meets one day and stays one row.
    """
    t = sessions.select(F.explode(F.array_distinct(F.array(F.to_date("open"), F.to_date("close")))).alias("__day"), "kind", F.col("open").alias("o"), F.col("close").alias("c"))
    plan = t.groupBy("__day").agg(F.array_sort(F.collect_list(F.struct("o", "c", "kind"))).alias("__all"))
    at = F.col(ts)
    found = F.get(F.filter("__all", lambda x: (at >= x["o"]) & (at < x["c"])), F.lit(0))["kind"]
    return rows.withColumn("__day", F.to_date(ts)).join(plan, "__day", "left").select(*rows.columns, F.coalesce(found, F.lit("NO_TRADING")).alias("kind"))


def nearest_session(rows: DataFrame, sessions: DataFrame, ts: str = "ts", kinds: tuple[str, ...] = ("PRE_MARKET", "REGULAR", "AFTER_MARKET")) -> DataFrame:
    """Rows with ``near_open`` and ``near_close`` of the session of these kinds that holds the time or is nearest to it; the earlier of two as near.

    Sessions of the week around are compared: they are few whatever the rows.
    """
    t = sessions.where(F.col("kind").isin(*kinds)).select(F.explode(F.sequence(F.date_sub(F.to_date("open"), 7), F.date_add(F.to_date("close"), 7))).alias("__day"), F.struct(F.col("open").alias("o"), F.col("close").alias("c")).alias("s"))
    plan = t.groupBy("__day").agg(F.array_sort(F.collect_list("s")).alias("__all"))
    at = F.col(ts)
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    far = lambda x: F.when(at < x["o"], micros(x["o"]) - micros(at)).when(at >= x["c"], micros(at) - micros(x["c"]) + 1).otherwise(F.lit(0).cast("long"))
    best = F.array_min(F.transform("__all", lambda x: F.struct(far(x).alias("far"), x["o"].alias("o"), x["c"].alias("c"))))
    return rows.withColumn("__day", F.to_date(ts)).join(plan, "__day", "left").withColumn("__s", best).select(*rows.columns, F.col("__s.o").alias("near_open"), F.col("__s.c").alias("near_close"))


def trading_ordinal(days: DataFrame) -> DataFrame:
    """Days with ``ordinal``: the number of trading days up to and with each."""
    return days.withColumn("ordinal", F.sum(F.col("trading").cast("long")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def trading_day(rows: DataFrame, days: DataFrame, day: str, n: int, name: str = "trading_day") -> DataFrame:
    """Adds the n-th trading day after (or before) ``day``; 0 is the day itself or the last one before it."""
    numbers = trading_ordinal(days)
    here = numbers.select(F.col("day").alias(day), F.col("ordinal").alias("__o"))
    there = numbers.where("trading").select((F.col("ordinal") - n).alias("__o"), F.col("day").alias(name))
    return rows.join(here, day, "left").join(there, "__o", "left").drop("__o")


def neighbours(days: DataFrame, chosen: Column) -> DataFrame:
    """Each day with the nearest chosen day before and after it."""
    w = Window.orderBy("day")
    picked = F.when(chosen, F.col("day"))
    before = F.last(picked, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(picked, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return days.select("day", before.alias("previous"), after.alias("next"))
