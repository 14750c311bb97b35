"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Each window of a benchmark item is looked up by its rarest term in the corpus. The postings of these
terms (document, position) are intersected with the window's second-rarest term at its relative
offset; what remains is an alignment (document, item, offset) with the postings around it, and these
are intersected with the item's own positions, offset-adjusted. Runs of matching positions as long as
a window are exact occurrences; the general search also gives proximity matches, where only a part of
a window's terms stands within a given distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before lowering: A-Z belong to them, as they will be a-z.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a term table that are broadcast at most; beyond, the joins shuffle.
BROADCAST_ROWS = 200_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), 0), F.array().cast("array<string>"))


def items_index(benchmark: DataFrame) -> DataFrame:
    """item_key, item_id, ipos, n, term of each word of each distinct item; ``folded`` is a coarser key of the term."""
    items = benchmark.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("item_key"), _words().alias("w"))
    items = items.select("item_id", "item_key", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "word"))
    return items.select("item_id", "item_key", "n", "ipos", ascii_lower(F.col("word")).alias("term"), F.lower("word").alias("folded"))


def search(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """Two tables: every row of ``docs`` as (doc_id, row, n_words), and the exact phrase matches as
    (doc_id, row, item_id, item_key, begin, length) for each maximal run of matching words.

    A phrase match covers ``window`` consecutive words of an item at least, or the whole of a shorter one.
    """
    items = stored(items_index(benchmark), "items")
    vocabulary = _bounded(items.select("folded").distinct())

    # The corpus frequency of the test terms, counted before the shuffle.
    token = docs.select(F.explode(_words()).alias("word")).select(F.lower("word").alias("folded"))
    frequency = token.join(vocabulary, "folded").groupBy("folded").agg(F.count("*").alias("f"))
    terms = stored(items.join(frequency, "folded", "left").withColumn("f", F.coalesce("f", F.lit(0))), "terms")

    # For each window its two rarest terms; windows with a term that the corpus lacks can't occur.
    length = F.least(F.col("n"), F.lit(window))
    starts = F.sequence(F.greatest(F.col("ipos") - window + 1, F.lit(0)), F.least(F.col("ipos"), F.col("n") - length))
    windows = terms.select("item_key", "n", F.explode(starts).alias("at"), F.struct("f", "ipos", "term", "folded").alias("t"))
    windows = windows.groupBy("item_key", "at").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rare, second = F.col("t")[0], F.coalesce(F.get("t", F.lit(1)), F.col("t")[0])
    anchors = windows.where(rare["f"] > 0).select(
        rare["folded"].alias("folded"), "item_key", rare["ipos"].alias("ipos"), rare["term"].alias("term"), (second["ipos"] - rare["ipos"]).alias("shift"), second["folded"].alias("other")
    ).distinct()
    # A row with the empty term meets the mark behind each document's last word, and so keeps its length.
    mark = docs.sparkSession.range(1).select(F.lit("").alias("folded"), F.lit(None).cast("long").alias("item_key"), F.lit(0).alias("ipos"), F.lit("").alias("term"), F.lit(0).alias("shift"), F.lit("").alias("other"))
    anchors = _bounded(stored(anchors.unionByName(mark), "anchors"))

    postings = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _words().alias("words"))
    postings = postings.select("doc_id", "row", "words", F.posexplode(F.array_append("words", F.lit(""))).alias("pos", "word"))
    met = (
        postings.withColumn("folded", F.lower("word"))
        .join(anchors, "folded")
        .where(F.col("item_key").isNull() | ((ascii_lower(F.col("word")) == F.col("term")) & (F.lower(F.get("words", F.col("pos") + F.col("shift"))) == F.col("other"))))
    )
    low = F.greatest(F.col("pos") - window + 1, F.lit(0))
    near = F.when(F.col("item_key").isNotNull(), F.slice("words", low + 1, F.lit(2 * window - 1)))
    met = stored(met.select("doc_id", "row", "item_key", "pos", (F.col("pos") - F.col("ipos")).alias("shift"), low.alias("low"), near.alias("near")), "met")

    every = met.where("item_key is null").select("doc_id", "row", F.col("pos").cast("long").alias("n_words"))
    around = met.where("item_key is not null").select("doc_id", "row", "item_key", "shift", "low", F.posexplode("near").alias("k", "word"))
    around = around.select("doc_id", "row", "item_key", "shift", (F.col("low") + F.col("k")).alias("p"), (F.col("low") + F.col("k") - F.col("shift")).alias("ipos"), ascii_lower(F.col("word")).alias("term"))
    same = around.join(_bounded(terms.select("item_id", "item_key", "n", "ipos", "term")), ["item_key", "ipos", "term"]).select("doc_id", "row", "item_id", "item_key", "n", "shift", "p").distinct()
    run = Window.partitionBy("row", "doc_id", "item_key", "shift").orderBy("p")
    runs = same.withColumn("island", F.col("p") - F.row_number().over(run)).groupBy("row", "doc_id", "item_id", "item_key", "n", "shift", "island").agg(F.min("p").alias("begin"), F.count("*").alias("length"))
    runs = runs.where(F.col("length") >= F.least(F.col("n"), F.lit(window)))
    return every, runs.select("doc_id", "row", "item_id", "item_key", "begin", "length")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``.

    A document is contaminated when its words inside occurring windows are at least one in ``share``.

    Defined results: null and empty texts have no words and no hits; empty or null items occur nowhere;
    items of equal text count each on their own; repeated documents are rows of their own with equal
    results; a null item_id counts in n_items under no name; an empty ``benchmark`` hits nothing.
    """
    every, runs = search(docs, benchmark, window)
    runs = stored(runs, "runs")
    key = ["row", F.coalesce("doc_id", F.lit(-1)).alias("__id")]
    hit = runs.select(*key, F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("length").cast("int") - 1)).alias("p")).distinct().groupBy("row", "__id").agg(F.count("*").alias("n_hit"))
    names = runs.select(*key, "item_id").distinct().groupBy("row", "__id").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list(F.col("item_id").cast("string")))).alias("items"))
    out = every.withColumn("__id", F.coalesce("doc_id", F.lit(-1))).join(hit.join(names, ["row", "__id"]), ["row", "__id"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), "row",
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are.

    The contaminated rows' keys are broadcast if they are at most ``broadcast_rows``; else the join shuffles.
    """
    bad = stored(contaminated(docs, benchmark, window, share).where("contaminated").select("row", F.coalesce("doc_id", F.lit(-1)).alias("id")).distinct(), "contaminated")
    bad = bad.select(F.col("row").alias("__row"), F.col("id").alias("__id"))
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == bad["__row"]) & (F.coalesce(docs["doc_id"], F.lit(-1)) == bad["__id"])
    return docs.join(F.broadcast(bad) if bad.count() <= broadcast_rows else bad, same, "left_anti")


def proximity(docs: DataFrame, benchmark: DataFrame, distance: int = 20) -> DataFrame:
    """(doc_id, item_id, begin, end) where the two rarest known terms of an item stand within ``distance`` words.

    The positional lists of the rarer term are met with those of the other inside the same document.
    """
    items = items_index(benchmark)
    vocabulary = _bounded(items.select("folded").distinct())
    token = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(_words()).alias("pos", "word"))
    postings = stored(token.withColumn("folded", F.lower("word")).join(vocabulary, "folded").select("doc_id", "row", "pos", ascii_lower(F.col("word")).alias("term")), "postings")
    frequency = postings.groupBy("term").agg(F.count("*").alias("f"))
    ranked = items.select("item_id", "item_key", "term").distinct().join(frequency, "term").groupBy("item_id", "item_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("f", "term"))), 1, 2).alias("t")).where(F.size("t") == 2)
    first = postings.join(ranked.select("item_id", "item_key", F.col("t")[0]["term"].alias("term"), F.col("t")[1]["term"].alias("other")), "term")
    # Positions meet only in the same or the next stretch of ``distance`` words, so a long document makes no pairs beyond.
    step = F.floor(F.col("pos") / F.lit(distance))
    left = first.select("doc_id", "row", "item_id", "other", F.col("pos").alias("p"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    right = postings.select("row", F.col("term").alias("other"), F.col("pos").alias("q"), step.alias("step"))
    near = left.join(right, ["row", "other", "step"]).where(F.abs(F.col("p") - F.col("q")) <= distance)
    return near.select("doc_id", "item_id", F.least("p", "q").alias("begin"), F.greatest("p", "q").alias("end")).distinct()


ORACLE_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select item_id, w, least(13, len(w)) l from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark) where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') g from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i from iw)),
dg as (select doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') g from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from dw, (select distinct l from win))),
occ as (select distinct doc_id, i, l, item_id from dg join win using (l, g)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from occ) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) items from (select distinct doc_id, item_id::varchar s from occ) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw left join hit using (doc_id) left join its using (doc_id)
"""
