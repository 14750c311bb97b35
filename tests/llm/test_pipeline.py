"""The pipeline's stages keep the columns, and each does what its operator says."""

import random
import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa

from lumentick.llm import binfmt, tokens

from . import reference
from .conftest import sentence


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    items = [(i, sentence(rng, 30)) for i in range(4)]
    rows = []
    for i in range(240):
        t = ". ".join(sentence(rng, 12).capitalize() for _ in range(5))
        if i % 10 == 3:
            t = rows[i - 1][1] + " tail"
        elif i % 12 == 5:
            t = t + " " + items[i % 4][1]
        elif i % 6 == 4:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, "en", rng.choice("abcd"), len(t)))
    labels = [(r[0], 0 if "!! " in r[1] else 1, 0) for r in rows if r[0] % 2 == 0 or "!! " in r[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    (n1, good), (n2, distinct), (n3, unseen), (n4, weighted), (n5, encoded) = corpus_pipeline.STAGES
    a = good(spark, docs, str(tmp_path))
    got = {r["doc_id"] for r in a.collect()}
    assert got == {r[0] for r in rows if "!! " not in r[1]} and a.columns == columns
    b = distinct(spark, a, str(tmp_path))
    want = reference.components([r for r in rows if r[0] in got])
    left = {r["doc_id"] for r in b.collect()}
    assert left == {i for i, (_, c) in want.items() if i == c} and b.columns == columns
    c = unseen(spark, b, str(tmp_path))
    clean = {r["doc_id"] for r in c.collect()}
    hit = {r[0]: reference.contamination(r[1], items) for r in rows if r[0] in left}
    assert clean == {i for i, h in hit.items() if not (h[1] and 20 * h[1] >= h[0])} and clean < left and c.columns == columns
    d = weighted(spark, c, str(tmp_path))
    assert d.columns == columns and {r["doc_id"] for r in d.collect()} <= clean
    e = encoded(spark, d, str(tmp_path))
    assert e.count() == d.count()


def test_token_records_leave_workers_small():
    """The last stage runs in workers that earlier stages have filled: no Python objects stay for known forms."""
    t = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join("".join("aeiouxyz"[(k >> 3 * j) & 7] for j in range(6)) for k in range(40_000))
    cache = {}
    binfmt.encode_batch(pa.array(["a"]), t, cache, np.dtype("<u2"))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        n = len(binfmt.encode_batch(pa.array([text]), t, cache, np.dtype("<u2"))[0])
        held = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert n >= 40_000 and held < 2_000_000
