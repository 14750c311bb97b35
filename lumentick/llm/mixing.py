"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: The sources' weights, repeating in the order of their names.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def _source_key() -> Column:
    """Never null: a null source is a source of its own, apart from any name."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``target`` of each row of (src, source, source_size): weighted shares, each at most ``most`` times its size.

    In ascending order of cap / weight a source is capped while its cap is below its share of what
    the capped ones before it leave; this is where repeated resharing of the excess ends. There is one
    row a source, so the windows over the whole (already summed) table are small.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(named) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), number + 1)
    t = by_source.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = Window.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap") * F.col("w_from") <= (F.col("total") - F.col("before")) * F.col("w"))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("w_left", F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("w"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - F.col("cap_sum")) * F.col("w") / F.nullif(F.col("w_left"), F.lit(0.0)))
    return t.select("src", "source_size", target.alias("target"))


def _sized(docs: DataFrame, *carried: Column) -> DataFrame:
    """The sampling order of each row: size class and hash are plain strings, so that SQL elsewhere gives the same."""
    bits = F.bin("size")
    rows = docs.select(
        F.col("doc_id"), F.col("source"), _source_key().alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), *carried,
    )
    return rows.withColumn("class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4)))


def _digits(n: int) -> int:
    """Leading digits of the hash that split a size class, so that a group stays small."""
    digits = 0
    while n > 2000 * 16**digits and digits < 5:
        digits += 1
    return digits


def _sampled(rows: DataFrame, slim: DataFrame, seed: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``rows`` with source_size, target and copies; ``slim`` has the same rows' (src, source, class, h, size), stored."""
    digits = _digits(slim.count())

    def grouped(t: DataFrame) -> DataFrame:
        return t.withColumn("g", F.substring("h", 1, digits) if digits else F.lit(""))

    groups = stored(grouped(slim).groupBy("src", "class", "g").agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("size")), "groups")
    goal = targets(groups.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, share, most)
    classes = groups.groupBy("src", "class").agg(F.sum("n").alias("n"))
    by_class = Window.partitionBy("src").orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("src", "class", F.coalesce(F.sum("n").over(by_class), F.lit(0)).alias("class_at")).join(goal, "src")
    by_group = Window.partitionBy("src", "class").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    at = groups.select("src", "class", "g", F.coalesce(F.sum("n").over(by_group), F.lit(0)).alias("group_at")).join(classes, ["src", "class"])
    inside = Window.partitionBy("src", "class", "g").orderBy("h", "doc_id", "size")
    numbered = grouped(rows).withColumn("i", F.row_number().over(inside) - 1).join(at, ["src", "class", "g"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("src")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    first = (F.col("class_at") + F.col("group_at") + F.col("i")).cast("double")
    crossed = F.floor((first + F.lit(1.0)) * rate + offset) - F.floor(first * rate + offset)
    return numbered.withColumn("copies", F.least(F.greatest(crossed, F.lit(0)), F.ceil(F.lit(float(most)))).cast("long"))


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs``.

    Within a source every document is expected ``target / source_size`` times. The rows are ordered by
    size class (powers of two in eight parts, larger first), then by the id's hash; the expected copies
    are summed up in that order from one random offset, and a document is emitted once for each whole
    number that its share crosses. So each size class has its due share, and the words taken come near
    the target.

    The prefix sum has two levels: rows are counted by (source, size class, leading digits of the hash),
    these few counts are summed up within a source, and only then rows are numbered inside their small
    group; no task ever holds a whole source.

    Defined results: null and empty texts have size 0 and take nothing; a null source is a source; null
    ids are sampled as any other; repeated rows are rows of their own; an empty table gives an empty result.
    """
    rows = stored(_sized(docs), "sizes")
    out = _sampled(rows, rows, seed, weights, share, most)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def resampled(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, each as often as it has copies, all columns as they are."""
    slim = stored(_sized(docs), "sizes")
    rows = _sized(docs, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    out = _sampled(rows, slim, seed, weights, share, most).where("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("__row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
with d as (select doc_id, source, coalesce('=' || source, '') src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5(coalesce(doc_id::varchar, '')) h from documents),
s as (select src, min(source) source, sum(size)::bigint source_size from d group by src),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w, source_size * 2.0::double cap from s),
p as (select *, (sum(source_size) over ())::double * 1.5::double total, coalesce(sum(cap) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0) before, sum(w) over (order by cap / w, src rows between current row and unbounded following) w_from from w),
c as (select *, cap * w_from <= (total - before) * w capped from p),
t as (select src, source_size, case when capped then cap else (total - coalesce((select sum(cap) from c where capped), 0)) * w / (select sum(w) from c where not capped) end target from c),
r as (select d.*, t.source_size, t.target, (row_number() over (partition by d.src order by lpad(length(bin(size))::varchar, 2, '0') || substr(bin(size), 1, 4) desc, h, doc_id, size) - 1)::double i,
  (('0x' || substr(md5('mix|' || d.src), 1, 8))::bigint)::double / 4294967296.0::double u, case when t.source_size > 0 then t.target / t.source_size else 0 end rate from d join t using (src)),
k as (select *, least(greatest(floor((i + 1) * rate + u) - floor(i * rate + u), 0), 2)::bigint copies from r)
select doc_id, source, size, source_size, target, copies, copies * size taken from k
"""
