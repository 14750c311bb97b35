"""Quality rules: base counts, and n-gram perplexity bands from a modified Kneser-Ney model.

The n-grams run over the bytes as they are, each a symbol of its own, so a language has at most 256**3 of
them whatever the corpus: Spark counts them over all texts that can teach (see ``train``) and adds the counts up. Tasks fit a model
for each language and store it (log-probabilities and back-off weights in arrays sorted by the n-gram's
hash) in a file of the shared folder; a task that measures texts opens the files of the languages it
meets and keeps a few, so there may be any number of languages. A text is measured by a mixture of its language's model and that of all languages, drawn
anew every few words, so that clean texts that mix languages are no outliers.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, shared_dir, slices, stored

SYMBOLS = b"#*$%&|<>"
#: Symbols: all bytes. 0xFF, which is in no UTF-8 text, stands for what is before a text.
N, BEGIN = 256, 255
#: Models that a task keeps open; languages and n-grams that it counts before it hands their counts on. Bounds of memory alone.
OPEN_MODELS, OPEN_COUNTS, OPEN_GRAMS = 16, 32, 1 << 22
#: Words for which the mixture draws its model.
SEGMENT = 4


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The trigram code that ends at each byte, two begin marks before each text; and each byte's row."""
    c = w.buf.astype(np.uint32)
    rows = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    one, two = np.full(len(c), BEGIN, np.uint32), np.full(len(c), BEGIN, np.uint32)
    one[1:] = c[:-1]
    two[2:] = c[:-2]
    first = w.offsets[:-1][np.diff(w.offsets) > 0]
    one[first] = BEGIN
    two[first] = BEGIN
    second = first + 1
    second = second[(second < len(c))]
    two[second] = BEGIN
    return (two * np.uint32(N) + one) * np.uint32(N) + c, rows


class Opened:
    """log p of trigram codes, as ``opened[codes]``: a row of ``N`` cells for each context of two symbols that is known, before them one for each last symbol alone."""

    def __init__(self, place: np.ndarray, cells: np.ndarray):
        self.place, self.cells = place, cells.ravel()

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        return self.cells[self.place[code // N] * N + code % N]


#: All trigrams equally likely.
EVEN = Opened(np.zeros(N * N, np.int64), np.full((1, N), -np.log(N), np.float32))


@dataclass(frozen=True)
class Ngrams:
    """Log-probabilities by order and back-off weights, each in arrays sorted by the n-gram's hash."""

    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    back_keys: tuple[np.ndarray, ...]
    backs: tuple[np.ndarray, ...]

    def opened(self) -> Opened:
        """The contexts' rows, looked up with back-off."""
        codes = np.arange(N * N)
        pair = self._backed(codes, 2, _lookup(self.keys[0], self.logs[0], codes % N, 1)[1])
        known, weight = _lookup(self.back_keys[1], self.backs[1], codes, 3)
        contexts = np.flatnonzero(known)
        place = codes % N
        place[contexts] = N + np.arange(len(contexts))
        cells = [pair]
        for part in np.array_split(contexts, len(contexts) // 1024 + 1):
            code = (part[:, None] * N + np.arange(N)).ravel()
            found, value = _lookup(self.keys[2], self.logs[2], code, 3)
            cells.append(np.where(found, value, np.repeat(weight[part], N) + pair[code % (N * N)]))
        return Opened(place, np.concatenate(cells).astype(np.float32).reshape(-1, N))

    def _backed(self, gram: np.ndarray, order: int, lower: np.ndarray) -> np.ndarray:
        """log p of n-grams, given that of their ends."""
        found, value = _lookup(self.keys[order - 1], self.logs[order - 1], gram, order)
        seen, back = _lookup(self.back_keys[order - 2], self.backs[order - 2], gram // N, order)
        return np.where(found, value, np.where(seen, back, 0.0) + lower)

    def table(self) -> np.ndarray:
        """log p of every trigram code."""
        return self.opened()[np.arange(N**3)]


def _hash(gram: np.ndarray, order: int) -> np.ndarray:
    return mix(gram.astype(np.uint64) + np.uint64(order << 32))


def _lookup(keys: np.ndarray, values: np.ndarray, gram: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(gram), bool), np.zeros(len(gram))
    h = _hash(gram, order)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, values[at]


def kneser_ney(code: np.ndarray, count: np.ndarray) -> Ngrams:
    """The interpolated modified Kneser-Ney model of trigram counts.

    Lower orders take the number of different symbols before an n-gram; each order discounts counts of
    1, 2 and 3 or more by estimates from its counts of counts.
    """
    order = np.argsort(code)
    known = {3: (code[order].astype(np.int64), count[order].astype(float))}
    known[2] = tuple(np.unique(known[3][0] % N**2, return_counts=True))
    # All symbols have a place in the lowest order.
    known[1] = np.arange(N), np.bincount(known[2][0] % N, minlength=N)
    below, p = np.zeros(1, np.int64), np.full(1, 1.0 / N)
    keys, logs, back_keys, backs = [], [], [], []
    for order in (1, 2, 3):
        gram, c = known[order]
        m = [float((c == k).sum()) for k in (1, 2, 3, 4)]
        y = m[0] / (m[0] + 2 * m[1]) if m[0] else 0.5
        d = [min(max(k - (k + 1) * y * m[k] / m[k - 1], 0.1), k * 0.9) if m[k - 1] else 0.5 for k in (1, 2, 3)]
        cut = np.select([c >= 3, c == 2, c == 1], [d[2], d[1], d[0]], 0.0)
        context, own = np.unique(gram // N, return_inverse=True)
        total = np.bincount(own, weights=c)
        left = np.bincount(own, weights=cut) / total
        q = (c - cut) / total[own] + left[own] * p[np.searchsorted(below, gram % N ** (order - 1))]
        h = _hash(gram, order)
        o = np.argsort(h)
        keys.append(h[o])
        logs.append(np.log(q[o]).astype(np.float32))
        if order > 1:
            h = _hash(context, order)
            o = np.argsort(h)
            back_keys.append(h[o])
            backs.append(np.log(left[o]).astype(np.float32))
        below, p = gram, q
    return Ngrams(tuple(keys), tuple(logs), tuple(back_keys), tuple(backs))


def base_counts(w: Words) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(w.offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(w.offsets))
    white = (w.buf == 32) | ((w.buf >= 9) & (w.buf <= 13))
    chars = np.bincount(rows[~white & ((w.buf & 0xC0) != 0x80)], minlength=n)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.bincount(rows[symbol[w.buf]], minlength=n)
    words = np.diff(w.bounds)

    # Lines with a word: hashed as a whole, all bytes counting.
    breaks = np.flatnonzero(w.buf == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    of = np.searchsorted(w.offsets, start, side="right") - 1
    keep = (of < n) & (start < len(w.buf))
    start, of = start[keep], of[keep]
    # A line ends at the next line feed or with its text.
    k = np.searchsorted(breaks, start)
    stop = np.minimum(np.append(breaks, len(w.buf))[k], w.offsets[of + 1])
    filled = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop, of = start[filled], stop[filled], of[filled]
    h = mix(w.ranges(start, stop) ^ mix(of.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(h, return_index=True)
    lines = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)

    # Five-word windows that a text holds twice or more; the words that they cover.
    h = w.hashes()
    of = np.repeat(np.arange(n), words)
    repeat = np.zeros(n, dtype=np.int64)
    if len(h) >= 5:
        g = np.zeros(len(h) - 4, dtype=np.uint64)
        for i in range(5):
            g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - 4 + i])
        inside = of[4:] == of[:-4]
        at = np.flatnonzero(inside)
        _, back, times = np.unique(mix(g[at] ^ mix(of[at].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        hit = at[times[back] >= 2]
        cover = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 5, -1)
        repeat = np.bincount(of[np.cumsum(cover[:-1]) > 0], minlength=n)
    return words, chars, symbols, lines, repeat


def _failed(n_words, n_repeat_words):
    """The base rules, on columns or arrays."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


#: The key of the model of all languages; a language's key is never empty.
ALL = ""


def _keys(lang: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each row's place in the list of the languages' keys."""
    coded = pc.dictionary_encode(pc.fill_null(lang.cast(pa.string()), ""))
    return np.asarray(coded.indices).astype(np.int64), ["=" + x for x in coded.dictionary.to_pylist()]


def segments(w: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segment of ``SEGMENT`` words that holds each byte, and each segment's row."""
    begun = np.zeros(len(w.buf), dtype=np.int64)
    begun[w.start] = 1
    k = np.maximum(np.cumsum(begun) - w.bounds[rows] - 1, 0) // SEGMENT
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (k[1:] != k[:-1])
    return np.cumsum(first) - 1, rows[first]


def _file(folder: str, key: str) -> tuple[fs.FileSystem, str]:
    where, base = fs.FileSystem.from_uri(folder)
    return where, f"{base}/{hashlib.sha256(key.encode()).hexdigest()}.npz"


def saved(folder: str, key: str, model: Ngrams) -> None:
    """Store a model under its key; a repeated task leaves a finished file, which holds the same, as it is."""
    out = io.BytesIO()
    np.savez(out, **{f"{name}{i}": a for name in ("keys", "logs", "back_keys", "backs") for i, a in enumerate(getattr(model, name))})
    where, name = _file(folder, key)
    own = f"{name}.{TaskContext.get().taskAttemptId()}"
    with where.open_output_stream(own) as f:
        f.write(out.getvalue())
    if where.get_file_info(name).type == fs.FileType.NotFound:
        where.move(own, name)
    else:
        where.delete_file(own)


def opened(folder: str, key: str) -> Opened | None:
    """A stored model; None where no text of the language taught."""
    where, name = _file(folder, key)
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(name) as f, np.load(io.BytesIO(f.read())) as z:
        return Ngrams(*(tuple(z[f"{x}{i}"] for i in range(n)) for x, n in (("keys", 3), ("logs", 3), ("back_keys", 2), ("backs", 2)))).opened()


def train(docs: DataFrame) -> str:
    """The folder of the models: that of all languages, and one for each language.

    They learn from the texts that pass the base rules and hold at most one symbol to ten words: junk
    that is frequent enough would else teach the model to expect it. All texts are measured.
    """

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return code, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def handed(total: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for k, parts in total.items():
            code, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                code, rows = grams(w)
                words, _, symbols, _, repeat = base_counts(w)
                teaches = ~_failed(words, repeat) & (10 * symbols <= words)
                lang, keys = _keys(part.column("lang"))
                for own, of in _by_language(np.where(teaches, lang, -1)[rows]):
                    if keys[of] not in total and len(total) >= OPEN_COUNTS or sum(len(x) for parts in total.values() for x, _ in parts) > OPEN_GRAMS:
                        yield from handed(total)
                        total.clear()
                    parts = total.setdefault(keys[of], [])
                    parts.append(np.unique(code[own], return_counts=True))
                    if len(parts) > 8:
                        parts[:] = [added(parts)]
        yield from handed(total)

    folder = f"{shared_dir(docs.sparkSession)}/models"

    def fit(key: tuple, counts: pa.Table) -> pa.Table:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        # The order of rows must not matter: a repeated task stores the same model.
        c = counts.sort_by("code")
        saved(folder, key[0].as_py(), kneser_ney(c["code"].to_numpy(), c["n"].to_numpy().astype(float)))
        return pa.table({"lang": [key[0].as_py()], "grams": pa.array([len(c)], pa.int64())})

    counts = stored(docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "counts")
    pooled = counts.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "code", "n")
    stored(counts.unionByName(pooled).groupBy("lang").applyInArrow(fit, "lang string, grams long"), "fitted")
    return folder


def _by_language(own: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The places of each number in ``own``, -1 left out."""
    order = np.argsort(own, kind="stable")
    of, first = np.unique(own[order], return_index=True)
    for k, at in zip(of, np.split(order, first[1:])):
        if k >= 0:
            yield at, int(k)


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, log_perplexity double"


def measured(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang and the measures of every row; log_perplexity is a byte's mean, null for an empty text.

    A language without a model is measured by that of all languages; where that is missing too, no text
    passes the base rules, and all trigrams count as equally likely.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Opened | None] = {}

        def table(key: str) -> Opened | None:
            if key not in tables:
                if len(tables) >= OPEN_MODELS:
                    tables.pop(next(iter(tables)))
                tables[key] = opened(folder, key)
            return tables[key]

        every = opened(folder, ALL) or EVEN
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Words(part.column("text"))
                code, rows = grams(w)
                lang, keys = _keys(part.column("lang"))
                pooled = every[code]
                logs = pooled.copy()
                for at, k in _by_language(lang[rows]):
                    if (t := table(keys[k])) is not None:
                        logs[at] = t[code[at]]
                size = np.diff(w.offsets)
                at, of = segments(w, rows)
                both = [np.bincount(at, weights=x, minlength=len(of)) for x in (logs, pooled)]
                total = np.bincount(of, weights=np.logaddexp(*both) - np.log(2), minlength=len(size))
                mean = np.where(size > 0, -total / np.maximum(size, 1), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *[pa.array(x.astype(np.int64)) for x in base_counts(w)], pa.array(size), pa.array(mean, mask=np.isnan(mean))],
                    names=["doc_id", "lang", *[x.split()[0] for x in MEASURES.split(", ")]],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind}, lang string, {MEASURES}")


def rules(docs: DataFrame, fence: float = 4.0, steady: int = 400) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity.

    A language's band: its median log-perplexity, from ``fence`` quartile ranges below the first
    quartile to as many above the third, over the documents that pass the base rules. A short text's
    deviation from the median is damped by sqrt(n / (n + ``steady``)), n its bytes.

    Defined results: null and empty texts have no words and fail the base rules, also where there are no
    others; a null language counts as the empty one; repeated rows get equal results; a null id is kept as
    it is; very long texts are measured whole; an empty table gives an empty result; columns other than
    doc_id, lang and text are not read.
    """
    m = stored(measured(docs, train(docs)), "measures")
    m = m.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words"))).withColumn("key", F.coalesce("lang", F.lit("")))
    middle = m.where("not base_failed").groupBy("key").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("median"))
    damp = F.sqrt(F.col("n_bytes") / (F.col("n_bytes") + F.lit(float(steady))))
    m = m.join(F.broadcast(middle) if middle.count() <= 10_000 else middle, "key", "left").withColumn("z", (F.col("log_perplexity") - F.col("median")) * damp)
    band = m.where("not base_failed").groupBy("key").agg(F.percentile_approx("z", [0.25, 0.75], 10000).alias("q"))
    first, third = F.col("q")[0], F.col("q")[1]
    width = fence * (third - first)
    band = band.select("key", (first - width).alias("low"), (third + width).alias("high"))
    m = m.join(F.broadcast(band) if band.count() <= 10_000 else band, "key", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("z").between(F.col("low"), F.col("high")), F.lit(False))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log_perplexity")
