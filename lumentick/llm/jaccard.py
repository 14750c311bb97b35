"""Size-aware heavy-light n-gram Jaccard join, and the components of its links.

A document's set holds its distinct word shingles, as 64-bit hashes; equal sets are one class. All sets
share one order of shingles: those that many documents hold come last. Two sets with a similarity of
the threshold or more share the required number of elements, so

* small sets enumerate all two-element subsets of a prefix that is one longer than needed to meet once;
  sets that are linked have such a subset in common;
* large sets, and the small ones near the boundary, post the elements of their prefix in inverted lists,
  which are scanned.

The boundary is the size with the least estimated cost, from the sizes' histogram and the lists' mean
length. Candidates are never spelt out as pairs of a list. Every set goes to the block of the leader
that it shares most lists with; a block is bounded (large ones are split, the leader is in each part)
and is joined exactly in memory. The links found give components. Then a set that shares a list with
sets of another, larger component in some block travels to that block, and is compared with all of it.
Links inside a component change nothing, so no component is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, dropped, mix, slices, stored

#: Shingles with a place of their own at the end of the order; the list is packed in tasks and broadcast
#: (9 bytes each, 4.5 MB at most). More or fewer change what a join costs, never its result.
LISTED = 500_000
#: Shingles in fewer documents are never listed.
LEAST = 4
#: Sets of more shingles are always large: their subsets would cost more than any list.
SIZES = 256
#: Equal sets that a task knows; beyond, it forgets them and posts a repeated set again.
SEEN = 500_000
#: Cost of a candidate, in keys.
CANDIDATE_COST = 8.0
#: Rows of travelling sets that are broadcast to pick texts; beyond, the join shuffles.
BROADCAST_ROWS = 250_000
#: Sets, and shingles in them, that a block holds (about).
BLOCK_SETS, BLOCK_SHINGLES = 1000, 2_000_000
CHUNK = 4 << 20


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles, each row's ascending, and the rows' bounds in them.

    A row with fewer words than ``width`` has its whole sequence as one shingle.
    """
    w = Words(column, lower=True)
    h = w.hashes()
    words = np.diff(w.bounds)
    g = np.zeros(len(h), dtype=np.uint64)
    for i in range(min(width, len(h))):
        g[: len(h) - i] = mix(g[: len(h) - i] * np.uint64(0x9E3779B97F4A7C15) + h[i:])
    parts, bounds = [], np.zeros(len(words) + 1, dtype=np.int64)
    for k, n in enumerate(words):
        a = w.bounds[k]
        if n >= width:
            s = np.unique(g[a : a + n - width + 1])
        elif n:
            x = np.full(1, n, dtype=np.uint64)
            for y in range(a, a + n):
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[y : y + 1])
            s = x
        else:
            s = g[:0]
        parts.append(s)
        bounds[k + 1] = bounds[k] + len(s)
    return (np.concatenate(parts) if parts else g[:0]), bounds


def required(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` elements with any set that it may link to."""
    return -(-percent * n // 100)


def _small_gaps(gap: np.ndarray) -> bytes:
    """Gaps of a sorted sequence in two bytes each; 0xFFFF adds 65,535 and goes on."""
    more = gap // 65535
    out = np.full(len(gap) + int(more.sum()), 65535, dtype="<u2")
    out[np.cumsum(more + 1) - 1] = gap % 65535
    return out.tobytes()


def _from_gaps(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(x)[x != 65535]


def frequencies(docs: DataFrame, width: int, percent: int, id_bits: int, part_bits: int) -> DataFrame:
    """(id, n, n2): counts of shingles that ``LEAST`` documents or more hold, by the leading bits of the hash.

    Negative ids hold statistics: -1-k of the shingles with counts from 2**k on (their sum and sum of
    squares); -1001-s of the number of sets with s elements.
    """
    rest = id_bits - part_bits

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sizes = [], 0, np.zeros(SIZES + 1, dtype=np.int64)

        def flush():
            x = np.sort(np.concatenate(held))
            cut = np.searchsorted(x >> np.uint64(rest), np.arange((1 << part_bits) + 1))
            own = np.flatnonzero(np.diff(cut))
            low = (x & np.uint64((1 << rest) - 1)).astype(np.int64)
            blobs = [_small_gaps(np.diff(low[cut[k] : cut[k + 1]], prepend=0)) for k in own]
            return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "ids"])

        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                s, bounds = shingles(piece.column("text"), width)
                size = np.diff(bounds)
                sizes += np.bincount(np.minimum(size, SIZES), minlength=SIZES + 1)
                held.append(s >> np.uint64(64 - id_bits))
                n += len(s)
                if n > 6_000_000:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([sizes.astype("<i8").tobytes()], pa.binary())], names=["part", "ids"])

    def add(t: pa.Table) -> pa.Table:
        part, blobs = t.column("part")[0].as_py(), t.column("ids").to_pylist()
        x = np.sort(np.concatenate([_from_gaps(b) for b in blobs]))
        first = np.flatnonzero(np.diff(x, prepend=-1))
        n = np.diff(np.append(first, len(x)))
        many = n >= LEAST
        level = np.floor(np.log2(n)).astype(np.int64)
        k = np.arange(40)
        one, two = np.bincount(level, weights=n, minlength=40)[:40], np.bincount(level, weights=n.astype(float) ** 2, minlength=40)[:40]
        ids = np.concatenate([(np.int64(part) << rest) + x[first[many]], -1 - k])
        return pa.table([pa.array(ids), pa.array(np.concatenate([n[many], one.astype(np.int64)])), pa.array(np.concatenate([n[many] * 0.0, two]))], names=["id", "n", "n2"])

    sent = docs.select("text").mapInArrow(send, "part long, ids binary")
    sent = sent.withColumn("part", F.when(F.col("part") < 0, F.lit(-1) - F.spark_partition_id() % 64).otherwise(F.col("part")))

    def add_any(t: pa.Table) -> pa.Table:
        if t.column("part")[0].as_py() >= 0:
            return add(t)
        total = sum(np.frombuffer(x, "<i8") for x in t.column("ids").to_pylist())
        return pa.table([pa.array(-1001 - np.arange(SIZES + 1)), pa.array(total), pa.array(np.zeros(SIZES + 1))], names=["id", "n", "n2"])

    return stored(sent.groupBy("part").applyInArrow(add_any, "id long, n long, n2 double"), "frequencies")


def packed(count: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with counts from 2**``least`` on, ascending, and the power of two of each count.

    Tasks pack them, so that the driver gets a few byte strings (``LISTED`` bounds them all together).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column("id")).astype("<u8").tobytes()], pa.binary()), pa.array([np.asarray(batch.column("k")).astype(np.int8).tobytes()], pa.binary())], names=["ids", "ks"])

    level = F.floor(F.log2("n") + F.lit(1e-9)).cast("int")
    parts = count.where((F.col("id") >= 0) & (level >= least)).select("id", level.alias("k")).mapInArrow(run, "ids binary, ks binary").collect()
    ids, ks = np.frombuffer(b"".join(r["ids"] for r in parts), "<u8"), np.frombuffer(b"".join(r["ks"] for r in parts), np.int8)
    order = np.argsort(ids)
    return ids[order], ks[order]


def boundary(sizes: np.ndarray, mean_list: float, percent: int) -> int:
    """The largest small size: least total of subsets enumerated below it and list entries scanned above."""
    scan = 1 + CANDIDATE_COST * max(mean_list - 1, 0)
    n = np.arange(len(sizes))
    p = np.array([k - required(k, percent) + 1 for k in n])
    light = sizes * (p + 1) * p / 2
    heavy = sizes * p * scan
    cost = [light[2 : b + 1].sum() + heavy[max(2, required(b + 1, percent)) :].sum() for b in range(1, len(sizes) - 1)]
    return 1 + int(np.argmin(cost))


ENTRIES = "kind int, key long, gid long, idx int, pos int, doc_id long, node binary, n long"


def postings(docs: DataFrame, width: int, percent: int, id_bits: int, ids: np.ndarray, level: np.ndarray, small: int, part_bits: int) -> DataFrame:
    """Kind 0: every row's doc_id, node (128-bit hash of its set) and size n; kind 1: prefix keys that several rows hold.

    Keys are dealt by their leading bits; those that one row alone holds end there. Keys of listed
    shingles are known to be common: they are spread over many parts and pass as they are.
    """
    order = docs.sparkSession.sparkContext.broadcast((ids, level))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, level = order.value
        gid, seen = TaskContext.get().partitionId() << 32, set()
        names = ["part", "gid", "keys", "idx", "pos", "light", "doc_id", "node", "n"]
        for batch in batches:
            for piece in slices(batch, "text", CHUNK):
                s, bounds = shingles(piece.column("text"), width)
                doc_id = piece.column("doc_id").to_pylist()
                rank = np.zeros(len(s), dtype=np.int8)
                if len(ids) and len(s):
                    x = s >> np.uint64(64 - id_bits)
                    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
                    rank = np.where(ids[at] == x, level[at], 0).astype(np.int8)
                one, two = mix(s), mix(s ^ np.uint64(0xA0761D6478BD642F))
                a = np.concatenate([[np.uint64(0)], np.cumsum(one, dtype=np.uint64)])
                b = np.concatenate([[np.uint64(0)], np.cumsum(two, dtype=np.uint64)])
                n = np.diff(bounds)
                node = np.stack([mix((a[bounds[1:]] - a[bounds[:-1]]) + n.astype(np.uint64)), b[bounds[1:]] - b[bounds[:-1]]], axis=1).astype("<u8")
                node = [node[k].tobytes() for k in range(len(n))]
                keys, idx, pos, kind = [], [], [], []

                def put(k, key, at, what):
                    # The last bit tells subsets from elements.
                    keys.append(key & ~np.uint64(1) | np.uint64(what & 1))
                    idx.append(np.full(len(key), k, dtype="<u4"))
                    pos.append(np.minimum(at, 65535).astype("<u2"))
                    kind.append(np.full(len(key), what, dtype=np.uint8))

                for k in range(len(n)):
                    m = int(n[k])
                    if m < 2 or doc_id[k] is None or node[k] in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node[k])
                    own, r = s[bounds[k] : bounds[k + 1]], rank[bounds[k] : bounds[k + 1]]
                    p = m - required(m, percent) + 1
                    if r.any():
                        o = np.argsort(r, kind="stable")[: p + 1]
                        own, r = own[o], r[o]
                    if m <= small:
                        i, j = np.triu_indices(p + 1, 1)
                        put(k, mix(own[i] * np.uint64(0xD6E8FEB86659FD93) + mix(own[j])), i, 1)
                    if m > small or m >= required(small + 1, percent):
                        put(k, own[:p], np.arange(p), 0)
                        kind[-1] |= ((r[:p] > 0) * 2).astype(np.uint8)
                empty = pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - gid]), pa.array([gid]), empty, empty, empty, empty, pa.array([doc_id], pa.list_(pa.int64())), pa.array([node], pa.list_(pa.binary())), pa.array([n.tolist()], pa.list_(pa.int64()))], names=names
                )
                if keys:
                    key, i, at, what = map(np.concatenate, (keys, idx, pos, kind))
                    part = (key >> np.uint64(64 - part_bits)).astype(np.int64)
                    # A common key may have any number of rows: its rows are spread, nothing is done with them together.
                    part = np.where(what & 2, (1 << part_bits) + (gid + np.arange(len(part))) % (1 << part_bits), part)
                    o = np.argsort(part, kind="stable")
                    key, i, at, what, part = key[o], i[o], at[o], what[o], part[o]
                    own, cut = np.unique(part, return_index=True)
                    cut = np.append(cut, len(part))
                    blob = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in range(len(own))], pa.binary())
                    none = pa.nulls(len(own), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), gid)), blob(key.astype("<u8")), blob(i), blob(at), blob(what), none, pa.nulls(len(own), pa.list_(pa.binary())), none], names=names)
                gid += 1

    kinds = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("gid", pa.int64()), ("idx", pa.int32()), ("pos", pa.int32()), ("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int64())])

    def meet(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        if part < 0:
            out = []
            for r in t.to_pylist():
                m = len(r["n"])
                out.append(pa.table([pa.array(np.zeros(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(np.full(m, r["gid"])), pa.array(np.arange(m, dtype=np.int32)), pa.nulls(m, pa.int32()), pa.array(r["doc_id"], pa.int64()), pa.array(r["node"], pa.binary()), pa.array(r["n"], pa.int64())], schema=kinds))
            return pa.concat_tables(out)
        blobs = {k: t.column(k).to_pylist() for k in ("keys", "idx", "pos", "light")}
        key, i, at, what = (np.frombuffer(b"".join(blobs[k]), d) for k, d in (("keys", "<u8"), ("idx", "<u4"), ("pos", "<u2"), ("light", np.uint8)))
        gid = np.repeat(np.array(t.column("gid")), [len(x) // 8 for x in blobs["keys"]])
        if part < 1 << part_bits:
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            keep = times[back] > 1
            key, i, at, what, gid = key[keep], i[keep], at[keep], what[keep], gid[keep]
        m = len(key)
        return pa.table([pa.array(np.ones(m, np.int32)), pa.array(key.view(np.int64)), pa.array(gid), pa.array(i.astype(np.int32)), pa.array(at.astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], schema=kinds)

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, "part long, gid long, keys binary, idx binary, pos binary, light binary, doc_id array<long>, node array<binary>, n array<long>")
    return stored(sent.groupBy("part").applyInArrow(meet, ENTRIES), "postings")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are as similar as ``percent``."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same) and same > 0


class Block:
    """Sets with an inverted index of their shingles: all links of one set at once."""

    def __init__(self, s: np.ndarray, bounds: np.ndarray, percent: int):
        self.bounds, self.percent, self.size = bounds, percent, np.diff(bounds)
        of = np.repeat(np.arange(len(self.size)), self.size)
        _, self.group = np.unique(s, return_inverse=True)
        self.order = of[np.argsort(self.group, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.group))]).astype(np.int64) if len(s) else np.zeros(1, np.int64)

    def links(self, k: int) -> np.ndarray:
        """The sets that set ``k`` links to, itself left out."""
        g = self.group[self.bounds[k] : self.bounds[k + 1]]
        n = self.first[g + 1] - self.first[g]
        run = np.cumsum(n)
        if not len(n):
            return np.zeros(0, np.int64)
        at = np.arange(run[-1]) + np.repeat(self.first[g] - (run - n), n)
        same = np.bincount(self.order[at], minlength=len(self.size))
        found = (same > 0) & (100 * same >= self.percent * (self.size + self.size[k] - same))
        found[k] = False
        return np.flatnonzero(found)

    def spanning(self) -> list[tuple[int, int]]:
        """Links that connect all that are connected.

        Sets outside the largest component are looked up one after the other; a link between two
        components has one end outside the largest, so none is missed.
        """
        label, out = np.arange(len(self.size)), []
        todo = np.ones(len(self.size), dtype=bool)
        while True:
            largest = np.bincount(label).argmax() if len(label) else -1
            open_ = np.flatnonzero(todo & (label != largest))
            if not len(open_):
                return out
            k = open_[0]
            todo[k] = False
            for j in self.links(k):
                if label[j] != label[k]:
                    out.append((int(k), int(j)))
                    label[label == label[j]] = label[k]


def labels(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the least node of its component.

    Each round takes the least label among neighbours, then the label of the label; labels are written
    to the shared folder between rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label"))
    now = stored(now, "labels")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, now["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = stored(step.join(jump, step["label"] == jump["via"], "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        now = step.select("node", "label")


def components(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of ``docs``.

    Defined results: a null or empty text has the empty set, is linked with nothing and is its own
    component; a null id is linked with nothing and has a null component; repeated rows get equal
    results; an empty table gives an empty result; very long texts are one row of a batch and one set; other
    columns, whatever their names, are not read.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shingled = max(total // 6, 1)
    part_bits = max(5, int(np.ceil(np.log2(shingled / 1e6))))
    id_bits = min(max(int(np.ceil(np.log2(shingled))) + 6, part_bits + 8), 60)
    count = frequencies(docs, width, percent, id_bits, part_bits)

    # Statistics of bounded number: by power of two, and by small size.
    found = {r["id"]: (r["n"], r["n2"]) for r in count.where("id < 0").groupBy("id").agg(F.sum("n").alias("n"), F.sum("n2").alias("n2")).collect()}
    least = 2
    many = {int(r["k"]): r["count"] for r in count.where("id >= 0").groupBy(F.floor(F.log2("n") + F.lit(1e-9)).alias("k")).count().collect()}
    while sum(c for k, c in many.items() if k >= least) > LISTED:
        least += 1
    low = [found.get(-1 - k, (0, 0)) for k in range(least)]
    mean_list = sum(x[1] for x in low) / max(sum(x[0] for x in low), 1)
    small = boundary(np.array([found.get(-1001 - k, (0, 0))[0] for k in range(SIZES + 1)], dtype=float), mean_list, percent)

    entries = postings(docs, width, percent, id_bits, *packed(count, least), small, part_bits)
    dropped(count)
    rows = entries.where("kind = 0").select("gid", "idx", "doc_id", "node", "n")
    # Equal sets are one node, named by its least id; rows that repeat an id with other texts are the same node.
    classes = rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("id"))
    rows = stored(rows.join(classes, "node", "left").select("gid", "idx", "doc_id", "id", "n"), "rows")
    met = entries.where("kind = 1").select("key", "gid", "idx", "pos").join(rows.select("gid", "idx", F.col("id").alias("node"), "n"), ["gid", "idx"])
    met = stored(met.groupBy("key", "node", "n").agg(F.min("pos").alias("pos")), "met")
    dropped(entries)
    part = stored(_blocks(met, percent), "blocks")

    # A text is fetched once, and already knows its block.
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(part.hint("merge"), "node"), "texts")
    edges = stored(_joined(texts, percent, width), "links")
    known = part.join(labels(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = stored(known, "known")
    more = stored(_travelled(met, texts, known, percent, width), "more_links")
    dropped(met, texts)
    whole = labels(more).select(F.col("node").alias("label"), F.col("label").alias("root"))
    named = known.join(whole, "label", "left").select(F.col("node").alias("id"), F.coalesce("root", "label").alias("component_id"))
    out = rows.join(named, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _salts(n: Column) -> Column:
    """Parts of a group so that each is about as large as a block."""
    return F.ceil(F.greatest(F.count("*") / F.lit(BLOCK_SETS), F.sum(n) / F.lit(BLOCK_SHINGLES))).cast("int")


def _bounded(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _blocks(met: DataFrame, percent: int) -> DataFrame:
    """(node, leader, salt, alone, heads) of every node.

    The leader of a list is the same set in every list that it is in; a node that shares no list with a
    fitting leader is its own. ``alone``: nobody else is in the block. ``heads``: the parts of the block
    that the node itself leads, if others are in it.
    """
    leader = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("leader"), F.col("n").alias("leader_n"))).alias("l")
    lists = met.groupBy("key").agg(leader, F.count("*").alias("c")).where("c > 1").select("key", "l.leader", "l.leader_n")
    pairs = met.join(lists, "key").where((F.col("node") != F.col("leader")) & (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")))
    best = pairs.groupBy("node", "leader").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "leader"))["leader"].alias("leader"))
    nodes = met.groupBy("node").agg(F.max("n").alias("n"))
    chosen = stored(nodes.join(best, "node", "left").withColumn("leader", F.coalesce("leader", "node")), "leaders")
    groups = chosen.groupBy("leader").agg(_salts(F.col("n")).alias("salts"), F.max(F.col("leader") != F.col("node")).alias("several"))
    led = groups.where("several").select(F.col("leader").alias("node"), F.col("salts").alias("heads"))
    return chosen.join(groups, "leader").join(led, "node", "left").select("node", "leader", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), (~F.col("several")).alias("alone"), "heads")


def _joined(texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that connect what is connected inside each block; the leader is in every part of its own."""
    member = texts.where(~F.col("alone") & (F.col("leader") != F.col("node"))).select("leader", "salt", "node", "text")
    head = texts.where("heads is not null").select(F.col("node").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("heads") - 1)).alias("salt"), "node", "text")

    def run(t: pa.Table) -> pa.Table:
        s, bounds = shingles(t.column("text").combine_chunks(), width)
        node = np.asarray(t.column("node"))
        pairs = Block(s, bounds, percent).spanning()
        # Rows that repeat an id are one node.
        pairs = [(node[a], node[b]) for a, b in pairs if node[a] != node[b]]
        return pa.table([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])

    return member.unionByName(head).groupBy("leader", "salt").applyInArrow(run, "a long, b long")


def _overlaps(low: Column, high: Column, percent: int) -> Column:
    """Whether a set of ``n`` that has ``shared`` prefix keys in common with sets of sizes ``low`` to ``high`` can be similar to one.

    What both can share beyond their prefixes, less the overlap that is needed, is greatest at an end of
    the sizes but for rounding: at the upper end it can be less by one than inside.
    """
    need = lambda m: F.ceil(F.lit(percent) * (F.col("n") + m) / F.lit(100.0 + percent) - F.lit(1e-9))
    beyond = lambda m: F.ceil(F.lit(percent / 100.0) * F.greatest("n", m) - F.lit(1e-9)) - 1
    return (F.col("shared") + beyond(low) >= need(low)) | (F.col("shared") + beyond(high) + 1 >= need(high))


def _travelled(met: DataFrame, texts: DataFrame, known: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) between components: sets that share a list with a larger component's sets in a block are compared with that block."""
    sizes = known.groupBy("label").agg(F.count("*").alias("of"))
    known = stored(known.join(sizes, "label"), "sized")
    tagged = met.join(known.select("node", "label", "leader", "salt", "of"), "node")
    # Of each list and block: the sizes met, and the largest component; whoever is of a smaller one travels there.
    held = tagged.groupBy("key", "leader", "salt").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.struct("of", "label")).alias("top"))
    held = stored(held, "held")
    open_keys = held.groupBy("key").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("key")
    target = held.join(open_keys, "key").select("key", F.col("leader").alias("to"), F.col("salt").alias("to_salt"), "top", "low", "high")
    fits = (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n"))
    travel = tagged.select("key", "node", "n", "pos", "label", "of").join(target, "key").where((F.struct("of", "label") < F.col("top")) & fits)
    travel = travel.groupBy("node", "to", "to_salt").agg(F.max("n").alias("n"), F.min("n").alias("least_n"), F.min("pos").alias("pos"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if(F.col("key").bitwiseAND(1) == 0).alias("shared"), F.max(F.col("key").bitwiseAND(1)).alias("subset"))
    ends = [F.greatest(F.col("low"), F.ceil(F.col("n") * F.lit(percent / 100.0) - F.lit(1e-9))), F.least(F.col("high"), F.floor(F.col("n") * F.lit(100.0 / percent) + F.lit(1e-9)))]
    need = lambda m: F.ceil(F.lit(percent) * (F.col("n") + m) / F.lit(100.0 + percent) - F.lit(1e-9))
    possible = (F.col("least_n") != F.col("n")) | (F.col("subset") == 1) | _overlaps(*ends, percent)
    travel = stored(travel.where(possible & ((F.col("least_n") != F.col("n")) | (F.col("n") - F.col("pos") >= need(ends[0])))).select("node", "n", "to", "to_salt"), "travel")

    parts = travel.groupBy("to", "to_salt").agg(_salts(F.col("n")).alias("turns"))
    block = ["to", "to_salt", "turn"]
    guest = travel.join(parts, ["to", "to_salt"]).select("to", "to_salt", F.pmod(F.xxhash64("node"), "turns").cast("int").alias("turn"), "node")
    host = known.select("node", F.col("leader").alias("to"), F.col("salt").alias("to_salt")).join(parts, ["to", "to_salt"]).select("to", "to_salt", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "node")
    both = stored(guest.withColumn("guest", F.lit(True)).unionByName(host.withColumn("guest", F.lit(False))).join(known.select("node", "label"), "node"), "guests")
    both = texts.select("node", "text").join(_bounded(both), "node").select(*block, "guest", "label", "text")

    def run(t: pa.Table) -> pa.Table:
        s, bounds = shingles(t.column("text").combine_chunks(), width)
        label, guest = np.asarray(t.column("label")), t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        near, found = Block(s, bounds, percent), set()
        for k in np.flatnonzero(guest):
            j = near.links(k)
            found |= {(int(label[k]), int(x)) for x in np.unique(label[j[~guest[j]]]) if x != label[k]}
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return both.groupBy(*block).applyInArrow(run, "a long, b long")


def representatives(docs: DataFrame, percent: int = 75, width: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """One row of each component of ``docs``, that with the least id, all columns as they are.

    Rows without words stay, as do rows with a null id; rows that repeat an id stay or go together.
    The ids that go are broadcast if they are at most ``broadcast_rows``; else the join shuffles.
    """
    gone = stored(components(docs, percent, width).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, "doc_id", "left_anti")


ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then array_to_string(w[i:i + 4], ' ') else array_to_string(w, ' ') end g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
o as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from o join n p on x = p.doc_id join n q on y = q.doc_id where 100 * c >= 75 * (p.n + q.n - c)),
r as (select doc_id, doc_id m from documents union select r.doc_id, e.y from r join e on r.m = e.x)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from (select doc_id, min(m) component_id from r group by doc_id) left join n using (doc_id)
"""
