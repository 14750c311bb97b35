"""Joins, mixing, decontamination, pages and archives against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lumentick.llm import decontam, jaccard, mixing, warc
from lumentick.llm.html import extract, rendered

from . import reference


def test_jaccard_components(docs, rows, none):
    want = reference.components(rows)
    got = jaccard.components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = sorted(r["doc_id"] for r in jaccard.representatives(docs.where("doc_id is not null").select("doc_id", "text").distinct()).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if i == c)
    assert jaccard.components(none).collect() == []


def test_every_boundary_gives_the_same_candidates():
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") for _ in range(18)]
    texts = [" ".join(base[rng.randrange(5) : rng.randrange(9, 19)]) for _ in range(60)]
    s, b = jaccard.shingles(pa.array(texts))
    sets = [s[b[k] : b[k + 1]] for k in range(len(texts))]

    def keys(x, small):
        n = len(x)
        p = n - jaccard.required(n, 75) + 1
        out = set()
        if n <= small:
            i, j = np.triu_indices(min(p + 1, n), 1)
            out |= {("two", x[a], x[c]) for a, c in zip(i, j)}
        if n > small or n >= jaccard.required(small + 1, 75):
            out |= {("one", y) for y in x[:p]}
        return out

    linked = [(a, c) for a in range(60) for c in range(a) if len(sets[a]) > 1 and jaccard._linked(sets[a], sets[c], 75) and set(sets[a]) != set(sets[c])]
    assert linked
    for small in (1, 3, 5, 8, 20):
        assert all(keys(sets[a], small) & keys(sets[c], small) for a, c in linked)


def test_gaps_round_trip():
    x = np.array([0, 0, 1, 65534, 65535, 200000, 200000, 10**9])
    assert jaccard._from_gaps(jaccard._small_gaps(np.diff(x, prepend=0))).tolist() == x.tolist()


def test_decontamination(spark, docs, rows, none):
    long = rows[10][1].split()
    items = [(1, " ".join(long[100:140])), (2, "a b c"), (3, "A b c d e f g h"), (4, None), (5, "--"), (6, " ".join(long[130:150])), (6, " ".join(long[130:150])), (7, "not in any text at all"), (11, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    distinct = sorted(set(items), key=repr)
    want = sorted((repr(i), *reference.contamination(t, distinct)) for i, t, *_ in rows)
    got = decontam.contaminated(docs, bench).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted((i, a, b, c, sha(d)) for i, a, b, c, d in want)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)
    bad = {r["doc_id"] for r in got if r["contaminated"]}
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in clean.collect()) == sorted(repr(i) for i, *_ in rows if i not in bad)
    assert decontam.contaminated(none, bench).collect() == []
    assert not any(r["n_hit"] for r in decontam.contaminated(docs, bench.where("item_id < 0")).collect())
    near = decontam.proximity(docs, bench.where("item_id = 3"), 5).collect()
    assert {r["doc_id"] for r in near} >= {19, 20}


def test_mixing(docs, rows, none):
    got = mixing.mixed(docs).collect()
    size = {}
    for i, t, _, s in rows:
        size[s] = size.get(s, 0) + len(reference.words(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        free -= over
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    emitted = mixing.resampled(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(none).collect() == [] and mixing.resampled(none).collect() == []


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    data = [(i, "w " * rng.randrange(1, 200), rng.choice(["hot", "hot", "x", "y"])) for i in range(3000)]
    taken, target = {}, {}
    for r in mixing.mixed(spark.createDataFrame(data, "doc_id long, text string, source string")).collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] / target[s] - 1) < 0.01 for s in target)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">One</a><li>Two<ul><li>in a<li>in b</ul><li>Three</ul></nav><!-- no --><div style="display: none">no</div><p hidden>no</p>
<h1>Head  &amp; line</h1><p>First<br>second <b>bold</b>text<p>Next &lt;x&gt;<table><caption>Cap</caption><tr><th>A<th>Name<tr><td>1<td>Ann<tr><td>22<td>Bo</table>after
<ol start=3><li>x<li>y</ol><pre>  a\n   b</pre>"""
TEXT = """- One
- Two
  - in a
  - in b
- Three

Head & line

First
second boldtext

Next <x>

Cap
A   Name
1   Ann
22  Bo

after

3. x
4. y

  a
   b"""


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p class="hidden md:block">a</p>', "a"), ('<p title="the hidden valley">a</p>', "a"), ('<p style="overflow: hidden !important">a</p>', "a"), ('<p data-style="display:none">a</p>', "a"), ("<p hidden>a</p>b", "b"), ('<p HIDDEN="">a</p>b', "b"), ('<p style="color:red; Display : none !important">a</p>b', "b"), ("<p style=visibility:hidden>a</p>b", "b"), ("<p id=x/hidden>a</p>", "a"),
        ("<textarea>\na &lt; b\n c</textarea>", "a < b\n c"), ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"), ("<svg><title>t</title>no<text>one</text><text>t<tspan>wo</tspan></text></svg>", "one\ntwo"),
        ("x <select><option>a<option selected>b<option>c</select> y", "x b y"), ("<select><option disabled>a</option><option>b</option></select>", "b"), ("<select><option hidden selected>pick</option><option>b</option></select>", "pick"), ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<head><title>T</title><span>a</span> b<p>c", "a b\n\nc"), ("<head><title>T</title>a <b>b</b>", "a b"), ("<head><title>T</title> <a href=x>a</a>", "a"), ("<head><noscript>n</noscript><template>t<span>u</span></template></head>a", "a"),
    ],
)
def test_html_shows_what_browsers_show(html, text):
    assert extract(html) == text


def test_html_layout():
    assert extract(PAGE) == TEXT
    assert extract(None) == extract("") == extract("<p hidden>x") == ""
    assert extract("plain  text") == "plain text"
    assert extract("x < y <a") == "x < y"
    assert extract("<script>never ends") == ""
    assert extract("<td>a<td>b</table></p>c") != ""
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert extract('<p title="a>b">q</p>') == "q"


@pytest.mark.parametrize("unit", ["<div><p>x", "<ul><li>x", "<table><tr><td>x", "<blockquote>x", "<b>x", "<dl><dd>x<ol><li>x"])
def test_deep_pages_keep_their_text_and_take_linear_time(unit):
    from time import perf_counter

    from lumentick.llm.html import extract

    page = unit * (300_000 // len(unit))
    begun = perf_counter()
    assert extract(page).count("x") == page.count("x")
    assert perf_counter() - begun < 20


def test_rendered_rows(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (None, "u", "", 3), (1, "u", PAGE, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((repr(r["page_id"]), r["text"], r["n_chars"]) for r in rendered(df).collect())
    assert got == sorted([("1", TEXT, len(TEXT)), ("1", TEXT, len(TEXT)), ("2", "", 0), ("None", "", 0)])
    assert rendered(df.where("page_id = 99")).collect() == []


def test_archives(spark):
    rng = random.Random(1)
    big, other = ["<p>" + "".join(rng.choice("abcdef é\r\n") for _ in range(1500)) for _ in range(2)]
    pages = [(1, "http://a/\r\nx", big), (2, None, big), (3, "http://b", other), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", big), (8, "u", big)]
    pages += [(100 + i, f"http://x/{i}", "<p>" + "word " * rng.randrange(300)) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.archived(df).collect()
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, x in pages if (x or "") == (h or "") and j is not None]
        revisit = len(data) >= 1000 and i != max(same)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert warc.archived(df.where("page_id = -1")).collect() == []
    more = df.selectExpr("*", "7 digest", "8 part", "9 bytes")
    several = warc.write(more).union(warc.write(more.where("page_id < 5")))
    assert warc.read(several).rdd.getNumPartitions() == several.count() > 1
    assert warc.read(several).count() == len(pages) + 4


def test_travel_filter_lets_every_possible_size_pass(spark):
    from pyspark.sql import functions as F

    need, beyond = lambda n, m: -(-75 * (n + m) // 175), lambda n, m: -(-75 * max(n, m) // 100) - 1
    rows = [(n, low, high, shared, any(shared + beyond(n, m) >= need(n, m) for m in range(low, high + 1))) for n in range(8, 30) for low in range(-(-75 * n // 100), 100 * n // 75 + 1) for high in range(low, 100 * n // 75 + 1) for shared in range(4)]
    df = spark.createDataFrame(rows, "n long, low long, high long, shared long, want boolean")
    assert df.where(F.col("want") & ~jaccard._overlaps(F.col("low"), F.col("high"), 75)).collect() == []
    assert (10, 11, 12, 1, True) in rows


def test_clean_keeps_columns_with_clashing_names(spark):
    from lumentick.llm import decontam

    item = " ".join(f"word{chr(97 + k)}" for k in range(14))
    docs = spark.createDataFrame([(1, item, 5, 6), (2, "clean text", 7, 8), (None, None, 1, 2)], "doc_id long, text string, __row long, __id long")
    got = decontam.clean(docs, spark.createDataFrame([("i1", item)], "item_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(2, "clean text", 7, 8), (None, None, 1, 2)]
