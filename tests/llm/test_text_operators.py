"""Token counts, token records, quality rules, the classifier and the language model against plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lumentick.llm import binfmt, lm, quality, rules, tokens

from . import reference


def keyed(df, *columns):
    return sorted(((r["doc_id"] is None, r["doc_id"], *[r[c] for c in columns]) for r in df.collect()), key=repr)


def test_token_counts_are_those_of_the_library(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokens.load(path)
    out = tokens.token_counts(docs, path, huge=3000, chunk=1000, overlap=100)
    want = sorted(((i is None, i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows), key=repr)
    assert keyed(out, "n_bytes", "n_tokens") == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in out.collect())
    assert tokens.token_counts(none, path).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_spliced_chunks_equal_the_whole(seed):
    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(seed)
    parts = ["  ", "\n\n", "<|endoftext|>", "'re", "  ", "aaaa" * 60, "\t", " 9", "word ", " été", "漢字", "!?"]
    for _ in range(40):
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 200)))
        assert tokens.spliced(x, t, rng.randrange(80, 400), rng.randrange(65, 120)) == t.encode(x, add_special_tokens=False).ids


def test_texts_without_boundaries_take_few_encodings():
    t = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    passed = []

    class Counting:
        def encode(self, x, **options):
            passed.append(len(x))
            return t.encode(x, **options)

    for x in ("x" * 200_000, "x" * 60_000 + " word" * 9000, "word " * 9000 + "-" * 90_000 + " end"):
        passed.clear()
        assert tokens.spliced(x, Counting(), 4096, 512) == t.encode(x, add_special_tokens=False).ids
        assert sum(passed) < 5 * len(x)


def test_other_tokenizers_take_whole_texts():
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    texts = ["Two words, and  more", "it's", "", None, "a " * 3000]
    for name, ours in (("byte_bpe_50k.json", tokens), ("word_bpe_49k.json", binfmt)):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        assert ours.divisible(t)
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=True)])
        t.normalizer = normalizers.Replace("words", "w o r d s")
        assert not ours.divisible(t)
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert tokens.count_batch(pa.array(texts), t, {}, 500, 200, 100).tolist() == [len(x) for x in want]
        ids, bounds = binfmt.encode_batch(pa.array(texts), t, {}, np.dtype("<u2"))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_token_records_forms(monkeypatch):
    """Tails of punctuation, letters that become a letter and a mark, special strings, a cache that is full, and texts encoded jointly."""
    t = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    letters = [*"abzESstÄéß×÷ÿĳقñаあ가", "\u0958", "\u0130", "J\u030c", "\u1e9e", "'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>"]
    texts = ["\u0958. x\u0958,", "deep### Deep&&& deep\'s.", "x" * 300 + "!", None, ""]
    texts += ["".join(rng.choice([*letters, *".,#$&|>*!-_12", " ", "\u0301", "\x85"]) for _ in range(30)) for _ in range(600)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for most, joined in ((binfmt.CACHE, 256), (50, 3)):
        monkeypatch.setattr(binfmt, "CACHE", most)
        monkeypatch.setattr(binfmt, "JOINED", joined, raising=False)
        cache, got = {}, []
        for a in range(0, len(texts), 100):
            ids, bounds = binfmt.encode_batch(pa.array(texts[a : a + 100], pa.string()), t, cache, np.dtype("<u2"))
            got += [ids[x:y].tolist() for x, y in zip(bounds, bounds[1:])]
        assert got == want


def test_token_records_ask_and_keep_little():
    """Forms in tails of any punctuation are one, many go to the library together, and little is kept of each."""
    t = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    asked = []

    class Counted:
        def __getattr__(self, name):
            return getattr(t, name)

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return t.encode_batch_fast(texts, **how)

    names = ["".join("aeiouxyz"[(k >> 3 * j) & 7] for j in range(6)) for k in range(20_000)]
    cache = {}
    for tail in ("", ".", "###", "&&&!"):
        binfmt.encode_batch(pa.array([" ".join(x + tail for x in names)]), Counted(), cache, np.dtype("<u2"))
    assert len(asked) < 200 and sum(len(x.split()) for x in asked) < len(names) + 5
    assert sum(x.nbytes for x in cache.values()) < 50 * len(names)


def test_token_records_round_trip(docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokens.load(path)
    manifest = binfmt.write(docs, path)
    got = binfmt.read(manifest).collect()
    ids = {}
    for i, x, *_ in rows:
        ids.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        own = next(x for x in ids[r["doc_id"]] if zlib.crc32(np.array(x, "<u4").tobytes()) == r["ids_crc32"])
        assert (r["start"], r["n_tokens"]) == (start, len(own))
        start += len(own)
    shard = manifest.first()
    several = list(range(shard["n_docs"]))[::-1]
    assert [x.tolist() for _, x in binfmt.fetch(shard["path"], several)][::-1] == [x.tolist() for _, x in binfmt.fetch(shard["path"], several[::-1])]
    assert binfmt.token_records(none, path).collect() == []


def test_damaged_records_are_found():
    data = bytearray(binfmt.framed(b"payload"))
    data[14] ^= 1
    pos = 0

    def read(n):
        nonlocal pos
        pos += n
        return bytes(data[pos - n : pos])

    with pytest.raises(ValueError):
        binfmt.unframed(read)


def test_base_rules(docs, rows, none):
    out = rules.rules(docs)
    want = sorted(((i is None, i, *reference.base_rules(x)) for i, x, *_ in rows), key=repr)
    assert keyed(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert rules.rules(none).collect() == []


def test_rules_of_empty_texts_only(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \n", "de")], "doc_id long, text string, lang string")
    assert sorted((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in rules.rules(df).collect()) == [(i, 0, True, False) for i in (1, 2, 3)]


def test_every_language_has_its_model(spark, monkeypatch):
    rng = random.Random(4)
    words = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)] for k in range(50)}
    data = [(i, " ".join(rng.choice(words[k]) for _ in range(90)), k) for i, k in enumerate(list(words) * 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(2)
    folder = rules.train(df)
    first, last = (rules.opened(folder, f"=l{k}") for k in (0, 49))
    assert first is not None and last is not None and not np.array_equal(first, last)
    assert rules.opened(folder, "=l50") is None
    # The measure of each text from its own model and that of all languages, text by text.
    every = rules.opened(folder, rules.ALL)
    got = {r["doc_id"]: r["log_perplexity"] for r in rules.measured(df, folder).collect()}
    for i, text, k in data[::7]:
        w = rules.Words(pa.array([text]))
        code, rows = rules.grams(w)
        own, at = rules.opened(folder, f"={k}"), rules.segments(w, rows)[0]
        total = 0.0
        for seg in range(at[-1] + 1):
            a, b = (float(t[code[at == seg]].astype(float).sum()) for t in (own, every))
            total += np.logaddexp(a, b) - np.log(2)
        assert np.isclose(got[i], -total / len(text), rtol=1e-5)


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(1)
    code = np.unique(rng.integers(0, rules.N**3, 3000))
    model = rules.kneser_ney(code, rng.integers(1, 9, len(code)).astype(float))
    p = np.exp(model.table().astype(float)).reshape(-1, rules.N).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-3)


def test_ngrams_tell_all_bytes_apart(spark):
    """Capitals, digits and letters beyond ASCII have n-grams of their own."""
    codes = [rules.grams(rules.Words(pa.array([x])))[0].tolist() for x in ("A1 \u0434", "B1 \u0434", "A2 \u0434", "A1 \u4e2d", "A1 \u0634")]
    assert len({tuple(x) for x in codes}) == 5
    texts = ["The Cat Sat On The Mat And The Hat Of Its Own " * 2 + str(k) for k in range(40)] + ["\u043a\u043e\u0442 \u0438 \u0434\u043e\u043c " * 9 + str(k) for k in range(40)]
    folder = rules.train(spark.createDataFrame([(i, " ".join(dict.fromkeys(x.split())) + " a b c d e f g h", "x") for i, x in enumerate(texts)], "doc_id long, text string, lang string"))
    model = rules.opened(folder, "=x")
    for known, other in ((" The", " Xhe"), ("\u043a\u043e\u0442", "\u6f22\u5b57\u6f22")):
        a, b = (model[rules.grams(rules.Words(pa.array([x])))[0]].mean() for x in (known, other))
        assert a > b + 0.5


def test_perplexity_bands_reject_noise(spark):
    rng = random.Random(2)
    normal = [(i, " ".join(rng.choice(["the", "river", "runs", "over", "stones", "and", "moss"]) + str(i % 7) * (rng.random() < 0.02) for _ in range(150)), "en") for i in range(150)]
    noise = [(1000 + i, " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(150)), "en") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in rules.rules(spark.createDataFrame(normal + noise, "doc_id long, text string, lang string")).collect()}
    assert not any(kept[i] for i, *_ in noise)
    assert sum(not kept[i] for i, *_ in normal) == 0 or all(kept[i] or reference.base_rules(t)[4] * 100 > 20 * 150 for i, t, _ in normal)


def test_perplexity_bands_hold_on_both_sides(spark):
    rng = random.Random(3)
    syllables = {"en": "the er ing and tion re on st wh ed ly is".split(), "de": "sch ein ung ich keit ge ver und zu heit au en".split()}
    vocabulary = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(1, 5))) for _ in range(2000)] for k, v in syllables.items()}
    text = lambda k, n=200: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    soup = lambda x: " ".join("".join(rng.sample(w, len(w))) for w in x.split())
    plain = [(i, text(k), k) for i, k in enumerate(["en", "de"] * 150)]
    mixed = [(1000 + i, text("en", 120) + " " + text("de", 80), "en") for i in range(5)]
    stuffed = [(2000 + i, " ".join(w + rng.choice(["%%%", "&&&", "$$$"]) for w in text("en").split()), "en") for i in range(10)]
    shuffled = [(3000 + i, soup(text("en")), "en") for i in range(5)]
    dull = [(4000 + i, " ".join("tion" * rng.randrange(1, 9) for _ in range(200)), "en") for i in range(5)]
    out = {r["doc_id"]: r for r in rules.rules(spark.createDataFrame(plain + mixed + stuffed + shuffled + dull, "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert [i for i, *_ in plain + mixed if not out[i]["kept"]] == []
    assert [i for i, *_ in stuffed + shuffled + dull if out[i]["kept"]] == []


def test_quality_classifier_on_held_out_rows(spark, none):
    rng = random.Random(4)
    words = ["stone", "river", "cloud", "engine", "paper", "window", "garden", "music", "letter", "winter"]
    good = [(i, ". ".join(" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(8)).capitalize() for _ in range(9)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choice(words).upper() + "!!" for _ in range(70)), 0) for i in range(150)]
    d = spark.createDataFrame([x[:2] for x in good + bad] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in good + bad] + [(5000, None), (9999, 1)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.classified(d, labels).collect()}
    assert len(out) == len(good) + len(bad) + 2
    for i, r in out.items():
        assert r["held_out"] == (reference.fold(i, 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(x[2], out[x[0]]["predicted"]) for x in good + bad if out[x[0]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert out[5000]["score"] == out[5001]["score"]
    kept = {r["doc_id"] for r in quality.filtered(d, labels).collect()}
    assert kept == {i for i, r in out.items() if r["predicted"]}
    assert quality.classified(none, labels).collect() == []
    assert quality.classified(d, labels.where("doc_id < 0")).first()["score"] == 0.5


def test_language_model(docs, rows, none):
    out = lm.scores(docs).collect()
    toks = [(i, [*reference.words(x, lower=True), None]) for i, x, *_ in rows]
    c = Counter(w for i, ws in toks if reference.fold(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((repr(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in ws), 4)) for i, ws in toks)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 and np.isfinite(r["score"]) for r in out)
    assert all(r["held_out"] == (reference.fold(r["doc_id"], 7) == 2) for r in out)
    assert lm.scores(none).collect() == []


def small_vocabulary():
    weight = np.array([5.0, 4, 3, 2, 2, 1, 1, 3])
    v = lm.Vocabulary(np.arange(6, dtype="<u8"), np.arange(6), np.full(1 << 16, 6), np.zeros((8, 2)), weight, 7, np.array([0, 8]))
    return v.renumbered(np.array([0, 0, 1, 1, 2, 2, 2, 0]))


@pytest.mark.parametrize("far_apart", [False, True])
def test_probabilities_add_up_to_one(far_apart):
    v = small_vocabulary()
    model = lm.LogBilinear(v)
    if far_apart:
        model.parts[2][:, lm.DIM] = [300, 0, -300]
        model.parts[3][:, lm.DIM] = np.linspace(-200, 200, v.size)
    p = 10 ** model.logs(np.full(v.size, 1), np.full(v.size, 2), np.arange(v.size))
    assert abs(p.sum() - 1) < 1e-5


def test_contrast_equals_the_plain_gradient():
    rng = np.random.default_rng(3)
    h, vectors = np.ones((5, lm.DIM + 1), np.float32), rng.normal(0, 1, (4, lm.DIM + 1)).astype(np.float32)
    h[:, : lm.DIM] = rng.normal(0, 1, (5, lm.DIM))
    noise, own = np.array([0.5, 2.0, 8.0, 1.0], np.float32), np.array([0, 1, 1, 3, 2])
    up, back = lm._contrast(h, vectors, noise, own, np.empty(1 << 10, np.float32))
    # The odds that an output is data, not noise: exp(score) to its noise.
    score = (h @ vectors.T).astype(float)
    g = -noise / (1 + noise * np.exp(-score))
    g[np.arange(5), own] += 1 / (1 + np.exp(score[np.arange(5), own]) / noise[own])
    assert np.allclose(up, g.T @ h, atol=1e-4) and np.allclose(back, g @ vectors[:, : lm.DIM], atol=1e-4)


def test_training_finds_what_follows():
    v = small_vocabulary()
    model = lm.LogBilinear(v)
    scale = [np.ones_like(x) for x in model.parts]
    one, two, c = (np.tile(x, 50) for x in ([1, 3, 5], [0, 2, 4], [3, 6, 1]))
    for _ in range(200):
        model.step(one, two, c, scale, 0.2)
    for x, y, want in ((1, 0, 3), (3, 2, 6), (5, 4, 1)):
        p = model.logs(np.full(v.size, x), np.full(v.size, y), np.arange(v.size))
        assert p.argmax() == want and 10 ** p[want] > 0.5


def test_training_does_not_depend_on_the_size(spark):
    """Twice the same texts, in tasks of their own, move the model as they do once."""
    words = np.random.default_rng(5).choice([f"w{k}" for k in range(40)], 200_000)
    once = lm.grouped(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").coalesce(1), 7, -1)
    _, tails, top = lm.word_statistics(lm.counted(once, 40))
    v = lm.vocabulary(top, tails, 1)
    v = v.renumbered(np.arange(v.size) % 5)
    begin, a, b = lm.LogBilinear(v).parts, lm.train(once, v).parts, lm.train(once.union(once), v).parts
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(a, b)) and not np.allclose(begin[3], a[3], atol=0.01)


def test_words_of_sliced_columns():
    from lumentick.llm.common import Words

    a = pa.array(["skip me", "Abé c", None, "", "  x\ty"]).slice(1)
    w = Words(a, lower=True)
    assert np.diff(w.bounds).tolist() == [2, 0, 0, 2]
    assert [bytes(w.buf[s:e]) for s, e in zip(w.start, w.end)] == ["abé".encode(), b"c", b"x", b"y"]
    assert len(set(w.hashes().tolist())) == 4
