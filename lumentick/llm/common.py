"""Helpers that several operators share: a shared folder, byte-level word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"

_local_shared: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``.

    Only where that setting is absent (tests in one JVM) is a temporary folder used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local_shared:
            _local_shared.append(tempfile.mkdtemp(prefix="spark-shared-"))
        base = _local_shared[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; their files are found by Spark's own file system."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids count as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Consecutive pieces of ``batch`` whose ``column`` holds at most ``most_bytes`` (or one row)."""
    a = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, s in enumerate(sizes):
        if i > begin and total + s > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += s
    if len(sizes) > begin:
        yield batch.slice(begin)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Ranges of more bytes are hashed one by one by a library; shorter ones all at once, eight bytes a step.
LANES = 64


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a string column, as positions in its bytes.

    ``buf`` holds the bytes (A-Z lowered on request), ``offsets`` each row's range in them,
    ``start``/``end`` each word's range, ``bounds`` each row's range of words. Null rows are empty.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        a = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        a = pc.fill_null(a, b"")
        off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
        data = a.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        if lower:
            raw = raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32)
        self.buf = raw
        n = len(raw)
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        first = np.ones(n + 1, dtype=bool)
        first[1:n] = white[:-1] if n else False
        first[self.offsets] = True
        last = np.ones(n, dtype=bool)
        if n:
            last[:-1] = white[1:] | False
            last[self.offsets[(self.offsets > 0)] - 1] = True
        self.start = np.flatnonzero(~white & first[:n])
        self.end = np.flatnonzero(~white & last) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.ranges(self.start, self.end)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes in each range, mixed after every eight bytes."""
        size = (end - start).astype(np.int64)
        h = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        if not len(size):
            return h
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        # The eight bytes from each position on.
        lanes = np.ndarray((len(self.buf) + 1,), "<u8", padded.data, 0, (1,))
        for k in np.flatnonzero(size > LANES):
            h[k] = xxhash.xxh3_64_intdigest(padded[start[k] : end[k]].data)
        at = np.flatnonzero((size > 0) & (size <= LANES))
        where, left = start[at], size[at]
        while len(at):
            x = lanes[where]
            cut = left < 8
            x[cut] &= (np.uint64(1) << (left[cut].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            h[at] = mix(h[at] ^ x)
            more = left > 8
            at, where, left = at[more], where[more] + 8, left[more] - 8
        return h
