"""Log-bilinear language model over words, trained by noise-contrastive estimation in numpy, and its scores.

Frequent words have vectors of their own; every other word is foreseen by its ending (its last two
bytes, the commonest ones apart, the others together). A token is foreseen from the two before it,

    h = r1[near] + r2[far],   P(w | h) = P(class of w | h) * P(w | its class, h),

both factors log-bilinear (h . vector + bias) and normalised exactly, by batched matrix products. The
classes are learned from the words' neighbours. Within its ending a rare word has its share of the
words; words that training has not met are one event in each ending, with a share that follows how many
of its words are new (Witten and Bell), as they are one event in the base score. All this is bounded;
the vocabulary is not, and is never in one place: each group of texts sends its distinct words' hashes
to hash ranges, where they are counted over the corpus, and gets back the counts that differ from its own.

Training: each task passes once over its training texts from the common parameters, in steps that begin
small and grow with what it has read; the changes are averaged, each row by how often a task met it.
Nothing is left out, and nothing depends on the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, slices, stored

#: Words with vectors of their own (at most), and their least count.
FREQUENT, LEAST = 12_288, 3
#: Endings that stand for themselves; the others are one.
ENDINGS = 63
#: Classes of words (at most twice as many after large ones are split), and numbers in a vector.
CLASSES, DIM = 111, 24
#: Neighbours on each side by which words are classed: the most frequent words, and all others together.
NEIGHBOURS = 32
#: Distinct words of a hash range, counted once for each group of texts that has them.
RANGE = 200_000
#: Partial sums that one task adds up.
FAN_IN = 64
GROUP_BYTES = 3 << 20
#: Tokens foreseen at once, and scores held at once.
CHUNK, ROOM = 65_536, 1 << 16
#: Tokens of a training step: an eighth of those that its task has read before, within these bounds.
STEP = 256, 16_384
#: Noise in times of the data.
NOISE = 32.0

GROUPS = "gid long, doc_id array<long>, held array<boolean>, size array<int>, words binary, hashes binary, counts binary, tails binary, n_hashes long, n_train long, n_tokens long"
ANSWERS = "gid long, at binary, counts binary, h binary, n binary, tails binary"


def packed(x: np.ndarray, ascends: bool = False) -> bytes:
    """Numbers as compressed bytes: of ascending ones the differences, all first bytes first, then all second ones."""
    if ascends and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: str, ascends: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    x = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=x.dtype) if ascends else x


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as a group is large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def grouped(docs: DataFrame, folds: int, held: int) -> DataFrame:
    """Texts in groups: each word as an index into the group's distinct words, these by ascending hash."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", folds) == held).alias("held"), "text")
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", GROUP_BYTES):
                w = Words(part.column("text"), lower=True)
                u, first, index = np.unique(w.hashes(), return_index=True, return_inverse=True)
                size = np.diff(w.bounds)
                train = ~np.asarray(part.column("held").to_numpy(zero_copy_only=False), dtype=bool)
                count = np.bincount(index[np.repeat(train, size)], minlength=len(u))
                start, long = w.start[first], w.end[first] - w.start[first]
                last = w.buf[start + long - 1].astype(np.uint16) if len(u) else np.zeros(0, np.uint16)
                before = np.where(long > 1, w.buf[np.maximum(start + long - 2, 0)], 0).astype(np.uint16) if len(u) else last
                row = {
                    "gid": n, "doc_id": part.column("doc_id").to_pylist(), "held": (~train).tolist(), "size": size.tolist(), "words": packed(index.astype("<u4")), "hashes": packed(u.astype("<u8"), True),
                    "counts": packed(count.astype("<u4")), "tails": packed((last * np.uint16(256) + before).astype("<u2")),
                    "n_hashes": len(u), "n_train": int(train.sum()), "n_tokens": int(size[train].sum()),
                }
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    return stored(rows.mapInArrow(run, GROUPS), "groups")


def counted(groups: DataFrame, n_hashes: int) -> DataFrame:
    """Counts over the corpus, by hash range.

    Rows with gid >= 0 answer a group: at which of its words the corpus' count is another than its own,
    and that count. Rows with gid -1 hold what a range's training words are: hash, count, tail.
    """
    bits = max(4, int(np.ceil(np.log2(max(n_hashes, 1) / RANGE))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            u, c, e = unpacked(row["hashes"], "<u8", True), unpacked(row["counts"], "<u4"), unpacked(row["tails"], "<u2")
            cut = np.searchsorted(u >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            own = np.flatnonzero(np.diff(cut))
            blob = lambda x, up=False: pa.array([packed(x[cut[i] : cut[i + 1]], up) for i in own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), row["gid"])), pa.array(cut[own].astype(np.int64)), blob(u, True), blob(c), blob(e)], names=["part", "gid", "base", "hashes", "counts", "tails"])

    def add(t: pa.Table) -> pa.Table:
        gids, base = t.column("gid").to_pylist(), t.column("base").to_pylist()
        each = [unpacked(x, "<u8", True) for x in t.column("hashes").to_pylist()]
        u, first, index = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        own = np.concatenate([unpacked(x, "<u4") for x in t.column("counts").to_pylist()])
        c = np.bincount(index, weights=own, minlength=len(u)).astype("<u8")
        e = np.concatenate([unpacked(x, "<u2") for x in t.column("tails").to_pylist()])[first]
        back, cut = c[index], np.concatenate([[0], np.cumsum([len(x) for x in each])])
        at, counts = [], []
        for i in range(len(gids)):
            new, old = back[cut[i] : cut[i + 1]], own[cut[i] : cut[i + 1]]
            other = np.flatnonzero(new != old)
            at.append(packed((other + base[i]).astype("<u4"), True))
            counts.append(packed(new[other]))
        some, none = c > 0, [None] * len(gids)
        rows = [np.array([*gids, -1], np.int64), [*at, None], [*counts, None], [*none, packed(u[some].astype("<u8"), True)], [*none, packed(c[some])], [*none, packed(e[some].astype("<u2"))]]
        return pa.table([pa.array(rows[0]), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=[x.split()[0] for x in ANSWERS.split(", ")])

    sent = groups.select("gid", "hashes", "counts", "tails").mapInArrow(send, "part int, gid long, base long, hashes binary, counts binary, tails binary")
    return stored(sent.groupBy("part").applyInArrow(add, ANSWERS), "answers")


def _level(n: np.ndarray) -> np.ndarray:
    """Counts in eighths of a power of two: the frequent words are whole levels, so that no order of ties matters."""
    return np.floor(8 * np.log2(n) + 1e-9).astype(np.int64)


def word_statistics(answers: DataFrame) -> tuple[dict[int, int], dict[int, np.ndarray], tuple[np.ndarray, ...]]:
    """How many words each level of counts has; types and tokens of each tail; the frequent words' hashes, counts and tails."""
    ranges = answers.where("gid = -1").select("h", "n", "tails")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, types, tokens = np.zeros(600, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for row in _rows(batches):
            n, e = unpacked(row["n"], "<u8").astype(np.int64), unpacked(row["tails"], "<u2")
            level += np.bincount(_level(n[n >= LEAST]), minlength=600)
            types += np.bincount(e, minlength=1 << 16)
            tokens += np.bincount(e, weights=n, minlength=1 << 16).astype(np.int64)
        a, b = np.flatnonzero(level), np.flatnonzero(types)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - a, b])), pa.array(np.concatenate([level[a], types[b]])), pa.array(np.concatenate([a * 0, tokens[b]]))], names=["k", "types", "tokens"])

    levels, tails = {}, {}
    for r in ranges.mapInArrow(tally, "k long, types long, tokens long").groupBy("k").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect():
        if r["k"] < 0:
            levels[-1 - r["k"]] = r["types"]
        else:
            tails[r["k"]] = np.array([r["types"], r["tokens"]], float)
    least, room = 600, FREQUENT
    for k in sorted(levels, reverse=True):
        room -= levels[k]
        if room < 0:
            break
        least = k

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            h, c, e = unpacked(row["h"], "<u8", True), unpacked(row["n"], "<u8"), unpacked(row["tails"], "<u2")
            top = (c >= LEAST) & (_level(np.maximum(c, 1)) >= least)
            yield pa.RecordBatch.from_arrays([pa.array([x[top].tobytes()], pa.binary()) for x in (h, c, e)], names=["h", "n", "tails"])

    got = ranges.mapInArrow(pick, "h binary, n binary, tails binary").collect()
    h, n, e = (np.frombuffer(b"".join(r[x] for r in got), d) for x, d in (("h", "<u8"), ("n", "<u8"), ("tails", "<u2")))
    o = np.argsort(h)
    return levels, tails, (h[o], n[o].astype(np.int64), e[o])


@dataclass(frozen=True)
class Vocabulary:
    """Outputs are numbered class by class; ``bounds`` are the classes' ranges, and one more number marks what is before a text.

    ``hashes`` (ascending) and ``ids`` of the frequent words; ``ending``: the output of each tail of a
    rare word; ``rare``: types and tokens that an output stands for (0 for words); ``weight``: training
    tokens of each output.
    """

    hashes: np.ndarray
    ids: np.ndarray
    ending: np.ndarray
    rare: np.ndarray
    weight: np.ndarray
    end: int
    bounds: np.ndarray

    @property
    def size(self) -> int:
        return len(self.weight)

    def numbered(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's output, and its place among the frequent words (-1: rare)."""
        place = np.full(len(hashes), -1)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            place = np.where(self.hashes[at] == hashes, at, -1)
        return np.where(place >= 0, self.ids[place] if len(self.ids) else 0, self.ending[tails]), place

    def renumbered(self, classes: np.ndarray) -> Vocabulary:
        """Outputs in the order of their classes."""
        order = np.lexsort((-self.weight, classes))
        new = np.empty(self.size, np.int64)
        new[order] = np.arange(self.size)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(classes))])
        return Vocabulary(self.hashes, new[self.ids], new[self.ending], self.rare[order], self.weight[order], int(new[self.end]), bounds)


def vocabulary(top: tuple[np.ndarray, ...], tails: dict[int, np.ndarray], ends: int) -> Vocabulary:
    hashes, counts, own = top
    rest = np.zeros((1 << 16, 2))
    for k, x in tails.items():
        rest[k] = x
    np.subtract.at(rest, own, np.stack([np.ones(len(own)), counts.astype(float)], axis=1))
    best = np.lexsort((np.arange(1 << 16), -rest[:, 1]))[:ENDINGS]
    best = best[rest[best, 1] > 0]
    ending = np.full(1 << 16, len(hashes) + len(best))
    ending[best] = len(hashes) + np.arange(len(best))
    rare = np.zeros((len(hashes) + len(best) + 2, 2))
    np.add.at(rare, ending, rest)
    weight = rare[:, 1].copy()
    weight[: len(hashes)] = counts
    weight[-1] = ends
    return Vocabulary(hashes, np.arange(len(hashes)), ending, rare, weight, len(weight) - 1, np.array([0, len(weight)]))


def _sequence(row: dict, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Of a group: each token's output (words, then END, text by text), the one before and the one before that, and its row."""
    size = np.asarray(row["size"], dtype=np.int64)
    kind, _ = v.numbered(unpacked(row["hashes"], "<u8", True), unpacked(row["tails"], "<u2"))
    rows = np.repeat(np.arange(len(size)), size + 1)
    end = np.cumsum(size + 1) - 1
    is_word = np.ones(len(rows), dtype=bool)
    is_word[end] = False
    c = np.full(len(rows), v.end)
    c[is_word] = kind[unpacked(row["words"], "<u4")]
    one, two = np.full(len(c), v.size), np.full(len(c), v.size)
    one[1:], two[2:] = c[:-1], c[:-2]
    begin = end - size
    one[begin] = two[begin] = v.size
    two[(begin + 1)[size > 0]] = v.size
    return c, one, two, rows


def _added(parts: DataFrame, tasks: int, kind: str) -> list:
    """The sums of arrays (block, task, n) over tasks, at most ``FAN_IN`` of them in one place."""

    def add(t: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, kind) for x in t.column("n").to_pylist())
        return pa.table([t.column("block").slice(0, 1), t.column("task").slice(0, 1), pa.array([n.tobytes()], pa.binary())], names=["block", "task", "n"])

    while True:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("block", "task").applyInArrow(add, "block int, task long, n binary")
        if tasks <= 1:
            return parts.select("block", "n").collect()


def summed(groups: DataFrame, cells: int, of: Callable[[dict], np.ndarray]) -> np.ndarray:
    """How often ``of`` gives each cell, over all groups: tasks count into arrays, which are added up."""
    step = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-cells // step) * step, dtype=np.int64)
        for row in _rows(batches):
            total += np.bincount(of(row), minlength=len(total))
        total = total.reshape(-1, step)
        own, task = np.flatnonzero(total.any(axis=1)), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), task, np.int64)), pa.array([total[x].astype("<i8").tobytes() for x in own], pa.binary())], names=["block", "task", "n"])

    out = np.zeros(-(-cells // step) * step, dtype=np.int64)
    for r in _added(groups.mapInArrow(run, "block int, task long, n binary"), groups.rdd.getNumPartitions(), "<i8"):
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["n"], "<i8")
    return out[:cells]


def classes(neighbours: np.ndarray, weight: np.ndarray, seed: int = 7) -> np.ndarray:
    """Classes of outputs whose neighbours are alike (k-means on the roots of their shares); large ones are split by frequency."""
    n = len(weight)
    k = int(np.clip(round(n**0.5), 1, CLASSES))
    x = np.sqrt(neighbours / np.maximum(neighbours.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    order = np.argsort(-weight, kind="stable")
    centre = x[order[:k]] + np.random.default_rng(seed).normal(0, 1e-4, (k, x.shape[1])).astype(np.float32)
    for _ in range(12):
        own = np.argmax(x @ centre.T - (centre**2).sum(axis=1) / 2, axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    most = max(2 * n // k, 1)
    rank = np.empty(n, np.int64)
    by = np.lexsort((-weight, own))
    rank[by] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    return np.unique(own * (n + 1) + rank // most, return_inverse=True)[1]


class LogBilinear:
    """``r1``, ``r2``: vectors of the nearer and the farther context; ``classes``, ``outputs``: vectors with a bias as their last number."""

    def __init__(self, v: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bounds = v.bounds
        self.of = np.repeat(np.arange(len(v.bounds) - 1), np.diff(v.bounds))
        share = v.weight + 0.5
        total = np.add.reduceat(share, v.bounds[:-1])
        self.noise = [(NOISE * total / total.sum()).astype(np.float32), (NOISE * share / total[self.of]).astype(np.float32)]
        small = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        biased = lambda n, p: np.concatenate([small(n), np.log(p / NOISE)[:, None]], axis=1)
        self.parts = [small(v.size + 1), small(v.size + 1), biased(len(total), self.noise[0]), biased(v.size, self.noise[1])]

    def room(self) -> np.ndarray:
        return np.empty(max(ROOM, int(np.diff(self.bounds).max()), len(self.bounds)), np.float32)

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = np.ones((len(one), DIM + 1), np.float32)
        h[:, :DIM] = self.parts[0][one] + self.parts[1][two]
        return h

    def by_class(self, c: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Each class that outputs ``c`` are of: its number, its range, and where they are."""
        k = self.of[c]
        order = _order(k)
        cut = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=len(self.bounds) - 1))])
        for x in np.flatnonzero(np.diff(cut)):
            yield int(x), int(self.bounds[x]), int(self.bounds[x + 1]), order[cut[x] : cut[x + 1]]

    def logs(self, one: np.ndarray, two: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of each output's probability: two exact normalisations, by matrix products over batches of contexts."""
        out, room = np.empty(len(c)), self.room()
        for a in range(0, len(c), CHUNK):
            part = slice(a, a + CHUNK)
            h, w = self.context(one[part], two[part]), c[part]
            found = _log_share(h, self.parts[2], self.of[w], room)
            for _, lo, hi, at in self.by_class(w):
                if hi - lo > 1:
                    found[at] += _log_share(h[at], self.parts[3][lo:hi], w[at] - lo, room)
            out[part] = found / np.log(10)
        return out

    @np.errstate(over="ignore")
    def step(self, one: np.ndarray, two: np.ndarray, c: np.ndarray, scale: list[np.ndarray], rate: float) -> None:
        """An Adagrad step on the tokens' noise-contrastive objective."""
        order = _order(c)
        one, two, c = one[order], two[order], c[order]
        h = self.context(one, two)
        # A token's own update must not meet the others' gradients: all are taken before any is applied.
        k, room = self.of[c], self.room()
        g, back = _contrast(h, self.parts[2], self.noise[0], k, room)
        up, more = np.zeros_like(self.parts[3]), np.zeros_like(back)
        against, less, inner = _against(self.parts[3], self.noise[1])
        own, cut = c - self.bounds[k], np.searchsorted(k, np.arange(len(self.bounds))).tolist()
        for lo, hi, a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), cut[:-1], cut[1:]):
            if b > a and hi - lo > 1:
                _pulled(h[a:b], against[lo:hi], less[lo:hi], inner[lo:hi], own[a:b], room, up[lo:hi], more[a:b])
        back += more
        todo = [(2, slice(None), g), (3, slice(None), up)]
        for k, x in ((0, one), (1, two)):
            order = _order(x)
            first = np.flatnonzero(np.diff(x[order], prepend=-1))
            todo.append((k, x[order][first], np.add.reduceat(back[order], first, axis=0)))
        for k, rows, g in todo:
            s = scale[k][rows] + g * g
            scale[k][rows] = s
            self.parts[k][rows] += rate * g / np.sqrt(s)


def _pieces(h: np.ndarray, vectors: np.ndarray, room: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Products of contexts and vectors, a few hundred KB at a time in the same memory."""
    n = max(1, len(room) // len(vectors))
    for a in range(0, len(h), n):
        part = h[a : a + n]
        yield slice(a, a + n), np.matmul(part, vectors.T, out=room[: len(part) * len(vectors)].reshape(len(part), len(vectors)))


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of small numbers; those below 2**16 are sorted by digits."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def _log_share(h: np.ndarray, vectors: np.ndarray, own: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The log of the softmax, at ``own``."""
    out, ones = np.empty(len(h), np.float32), np.ones(len(vectors), np.float32)
    # No product exceeds the lengths of its factors.
    longest = float(np.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0)) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0)))
    for part, x in _pieces(h, vectors, room):
        if not longest < 80:  # else no sum of powers leaves the range of float32
            x -= x.max(axis=1)[:, None]
        mine = x[np.arange(len(x)), own[part]]
        out[part] = mine - np.log(np.exp(x, out=x) @ ones)
    return out


def _against(vectors: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_pulled`` takes of outputs: vectors whose products are log noise - score, the noise below zero, vectors without bias."""
    against = -vectors
    against[:, DIM] += np.log(noise)
    return against, -noise, np.ascontiguousarray(vectors[:, :DIM])


def _pulled(h: np.ndarray, against: np.ndarray, less: np.ndarray, inner: np.ndarray, own: np.ndarray, room: np.ndarray, up: np.ndarray, back: np.ndarray) -> None:
    """Adds the gradients for the outputs to ``up``, writes those for the contexts to ``back``."""
    for part, x in _pieces(h, against, room):
        np.exp(x, out=x)
        x += 1
        np.divide(less, x, out=x)
        at, mine = np.arange(len(x)), own[part]
        x[at, mine] += 1 - x[at, mine] / less[mine]
        up += x.T @ h[part]
        np.matmul(x, inner, out=back[part])


def _contrast(h: np.ndarray, vectors: np.ndarray, noise: np.ndarray, own: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients for ``vectors`` and for the contexts. P(data | w) = sigmoid(score - log noise).

    The noise is taken by its expectation: every output of the class counts as often as it would be drawn.
    """
    up, back = np.zeros_like(vectors), np.empty((len(h), DIM), np.float32)
    _pulled(h, *_against(vectors, noise), own, room, up, back)
    return up, back


def train(groups: DataFrame, v: Vocabulary, rate: float = 0.2) -> LogBilinear:
    """One pass over all training tokens. Each task begins with the common parameters and gives back its changes.

    A row's change is the mean over tasks, weighted by how many of a task's tokens moved it.
    """
    model = LogBilinear(v)
    spark, rows = groups.sparkSession, groups.select("held", "size", "words", "hashes", "tails")
    tasks, block = rows.rdd.getNumPartitions(), 1024
    spread = spark.sparkContext.broadcast((v, model.parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, begin = spread.value
        model = LogBilinear(v)
        model.parts = [x.copy() for x in begin]
        scale = [np.ones_like(x) for x in begin]
        met, seen = [np.zeros(len(x)) for x in begin], 0
        for row in _rows(batches):
            c, one, two, own = _sequence(row, v)
            learn = ~np.asarray(row["held"], dtype=bool)[own]
            c, one, two = c[learn], one[learn], two[learn]
            a = 0
            while a < len(c):
                b = a + min(max((seen + a) // 8, STEP[0]), STEP[1])
                model.step(one[a:b], two[a:b], c[a:b], scale, rate)
                a = b
            seen += len(c)
            k = np.bincount(model.of[c], minlength=len(begin[2]))
            for x, n in zip(met, (np.bincount(one, minlength=len(begin[0])), np.bincount(two, minlength=len(begin[1])), len(c), k[model.of])):
                x += n
        task = TaskContext.get().partitionId()
        for k in range(4):
            for b in range(0, len(begin[k]), block):
                n = met[k][b : b + block]
                if n.any():
                    moved = np.concatenate([n[:, None], n[:, None] * (model.parts[k][b : b + block] - begin[k][b : b + block])], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([k << 16 | b // block], pa.int32()), pa.array([task], pa.int64()), pa.array([moved.astype("<f4").tobytes()], pa.binary())], names=["block", "task", "n"])

    for r in _added(rows.mapInArrow(run, "block int, task long, n binary"), tasks, "<f4"):
        x = model.parts[r["block"] >> 16]
        b = (r["block"] & 65535) * block
        moved = np.frombuffer(r["n"], "<f4").reshape(-1, x.shape[1] + 1)
        x[b : b + block] += moved[:, 1:] / np.maximum(moved[:, :1], 1)
    spread.unpersist()
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Learns from the rows whose crc32(doc_id as text) mod ``folds`` is not ``held``.

    Defined results: a null or empty text is one END token; a null id is in the fold of the empty text
    and stays null; repeated rows count each in training and get equal scores; words of equal counts
    are frequent or rare together; without training rows every token is unknown; a very long text is a
    group of its own; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    groups = grouped(docs, folds, held)
    total = groups.agg(F.sum("n_hashes").alias("h"), F.sum("n_train").alias("t"), F.sum("n_tokens").alias("n")).first()
    ends, words = int(total["t"] or 0), int(total["n"] or 0)
    answers = counted(groups, int(total["h"] or 0))
    _, tails, top = word_statistics(answers)
    n, types = words + ends, int(sum(x[0] for x in tails.values())) + (ends > 0)

    v = vocabulary(top, tails, ends)
    near = np.full(v.size + 1, NEIGHBOURS - 1)
    best = np.argsort(-v.weight, kind="stable")[: NEIGHBOURS - 1]
    near[best] = np.arange(len(best))
    step = 2 * NEIGHBOURS

    def met(row: dict) -> np.ndarray:
        """A cell for each training token and its neighbour on either side."""
        c, one, _, own = _sequence(row, v)
        learn = ~np.asarray(row["held"], dtype=bool)[own]
        follows = learn & (one < v.size)
        return np.concatenate([c[learn] * step + near[one[learn]], one[follows] * step + NEIGHBOURS + near[c[follows]]])

    cells = summed(groups.select("held", "size", "words", "hashes", "tails"), v.size * step, met)
    v = v.renumbered(classes(cells.reshape(-1, step), v.weight))
    model = train(groups, v)
    spread = docs.sparkSession.sparkContext.broadcast((v, model.parts))
    floor = float(n + 1 * (types + 1))

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        v, parts = spread.value
        model = LogBilinear(v)
        model.parts = parts
        out = []
        for row in texts.to_pylist():
            c = unpacked(row["counts"], "<u4").astype(float)
            for at, n in zip(found.column("at").to_pylist(), found.column("counts").to_pylist()):
                c[unpacked(at, "<u4", True)] = unpacked(n, "<u8")
            words, tails = unpacked(row["words"], "<u4"), unpacked(row["tails"], "<u2")
            docs_n = len(row["size"])
            token, one, two, rows = _sequence(row, v)
            own = np.repeat(np.arange(docs_n), np.asarray(row["size"], np.int64))
            base = np.bincount(own, weights=np.log10((c + 1) / floor)[words], minlength=docs_n) + np.log10((ends + 1) / floor)
            known = np.bincount(own, weights=(c > 0)[words], minlength=docs_n).astype(np.int64) + (ends > 0)
            kind, place = v.numbered(unpacked(row["hashes"], "<u8", True), tails)
            inside = np.where(place >= 0, 0.0, _within(c, v.rare[kind]))
            score = np.bincount(rows, weights=model.logs(one, two, token), minlength=docs_n) + np.bincount(own, weights=inside[words], minlength=docs_n)
            out.append(pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.asarray(row["size"], np.int64) + 1), pa.array(known), pa.array(base), pa.array(score)], names=[x.split()[0] for x in SCORES.split(", ")]))
        return pa.concat_tables(out)

    found = answers.where("gid >= 0").select("gid", "at", "counts")
    texts = groups.select("gid", "doc_id", "held", "size", "words", "hashes", "counts", "tails")
    out = texts.groupBy("gid").cogroup(found.groupBy("gid")).applyInArrow(run, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _within(c: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """log10 of a rare word's share of its ending; all words with a count of 0 are one event."""
    types, tokens = rare.T
    return np.log10(np.where(c > 0, c, types + 1) / (tokens + types + 1))
