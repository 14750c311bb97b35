"""Option chains of instrument profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a series of options has in common, in the order in which series are sorted.
SERIES = ["expiration", "last_trade", "multiplier", "spc", "additional_underlyings", "mmy", "option_type", "expiration_style", "settlement_style", "cfi"]


def series_fields(profiles: DataFrame) -> list[str]:
    """Those fields of a series that a table has."""
    return [c for c in SERIES if c in profiles.columns]


def chains(profiles: DataFrame) -> DataFrame:
    """Series of each underlying and product: sorted strikes, and symbols of calls and puts by strike.

    Takes profiles (symbol, type, cfi, underlying, product, expiration, strike, multiplier): options whose
    CFI begins with OC or OP, with an expiration and a finite strike. A series is told by all fields of
    ``SERIES`` that the profiles have; its CFI has X as second letter.
    """
    right = F.substring("cfi", 1, 2)
    options = profiles.where((F.col("type") == "OPTION") & right.isin("OC", "OP") & (F.col("expiration") != 0) & F.col("strike").isNotNull() & ~F.isnan("strike") & (F.abs("strike") < float("inf")))
    names = F.array_distinct(F.filter(F.array("product", "underlying"), lambda x: x.isNotNull() & (x != "")))
    t = options.withColumn("chain", F.explode(names)).withColumn("call", right == "OC").withColumn("cfi", F.concat(F.lit("OX"), F.substring("cfi", 3, 10)))
    of = lambda want: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("call") == want, F.struct("strike", "symbol")))), lambda x: x["symbol"]), ",")
    return t.groupBy("chain", *series_fields(t)).agg(F.array_sort(F.collect_set("strike")).alias("strikes"), of(True).alias("calls"), of(False).alias("puts"))


def strikes_around(strikes: DataFrame, keys: list[str], strike: float, n: int) -> DataFrame:
    """The ``n`` strikes around a price: from half of them below its insertion point, as far as there are."""
    w = Window.partitionBy(*keys)
    t = strikes.select(*keys, "strike").distinct().withColumn("i", F.row_number().over(w.orderBy("strike")) - 1).withColumn("at", F.count_if(F.col("strike") < strike).over(w))
    first = F.greatest(F.col("at") - n // 2, F.lit(0))
    return t.where((F.col("i") >= first) & (F.col("i") < first + n)).select(*keys, "strike")


def series_order(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place``: the series' order within ``keys``, by the fields of ``SERIES`` in turn."""
    return series.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*series_fields(series))).cast("long"))
