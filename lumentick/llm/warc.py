"""Dictionary-compressed WARC archives: writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built
from the archive's first records; every record after it is a frame of its own, compressed with that
dictionary. Pages of equal payload are stored once: the others are revisit records.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored

MAGIC = 0x184D2A5D
#: Payloads of fewer bytes are stored again instead of being referred to.
SMALLEST_REVISIT = 1000
#: The dictionary's size, and the bytes of records it is built from; both bounds are per archive.
DICTIONARY, SAMPLE = 1 << 16, 2 << 20
#: Parts into which each digest is cut for the join that finds revisits, so that no task holds all copies of a page.
PARTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive int, path string, n_records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _uri(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def _page(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(uri: str) -> int | None:
    x = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, with the length of the payload, and no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_page(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page(refers_to)}"]
    else:
        block += payload
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its head says")
    return fields, rest[:n]


def dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of ``samples``; where they are too few to train on, their last bytes."""
    size = min(DICTIONARY, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Writer:
    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.waiting: list[bytes] = []
        self.size = 0
        self.compressor = None
        self.n = 0

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.compressor is not None:
            self.out.write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        d = dictionary(self.waiting)
        self.out.write(struct.pack("<II", MAGIC, len(d)) + d)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d))
        for x in self.waiting:
            self.out.write(self.compressor.compress(x))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()
        self.out.close()


def records(f, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    head = f.read(8)
    if len(head) < 8 or struct.unpack_from("<I", head)[0] != MAGIC:
        raise ValueError("an archive begins with its dictionary's frame")
    d = f.read(struct.unpack_from("<I", head, 4)[0])
    dctx = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
    rest = f.read(piece)
    while rest:
        one, parts = dctx.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data or f.read(piece)
                break
            rest = f.read(piece)
            if not rest:
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)


def write(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z", smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """Write a record for each row of (page_id, url, html); gives the manifest of archives.

    Which row of equal payloads is kept comes from a count by digest that Spark adds up before the
    shuffle. The join back is on the digest and a part of it that the row's id and url give, so the copies
    of one page are spread over ``PARTS`` keys. A repeated task writes an archive of its own.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    first = rows.where(F.col("bytes") >= smallest).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS)).cast("int")).join(first, ["digest", "part"], "left")
    again = (F.col("bytes") >= smallest) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "digest", F.when(again, F.col("first")).alias("refers_to"), again.alias("again"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        at = TaskContext.get()
        name = f"{at.partitionId():06d}-{at.taskAttemptId()}.warc.zst"
        out = None
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                for r in part.to_pylist():
                    if out is None:
                        out = Writer(where.open_output_stream(f"{base}/{name}", buffer_size=1 << 20))
                    out.add(record("revisit" if r["again"] else "response", r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"], date))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([at.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([out.n])], names=["archive", "path", "n_records"])

    return stored(rows.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives.

    A response's digest is computed from its payload and must be the one in its head. There are as many
    tasks as archives; the manifest has one row an archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, name = fs.FileSystem.from_uri(row["path"])
                got, n = [], 0
                with where.open_input_stream(name, buffer_size=1 << 20) as f:
                    for data in records(f):
                        n += 1
                        fields, block = parsed(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)[1])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"damaged payload of {fields['warc-record-id']}")
                        got.append((_page_id(fields["warc-record-id"]), size, digest, kind, _page_id(fields["warc-refers-to"]) if kind == "revisit" else None))
                        if len(got) == 4096:
                            yield _rows(got)
                            got = []
                if n != row["n_records"]:
                    raise ValueError(f"{row['path']} has {n} records, {row['n_records']} were written")
                if got:
                    yield _rows(got)

    return manifest.repartition(max(manifest.count(), 1), F.col("archive")).mapInArrow(run, RECORDS)


def _rows(got: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back.

    Defined results: a null html is an empty payload; a null url is ``about:blank``; a null page_id
    stays null, and among equal payloads it is never the response unless all of them are null; rows
    that repeat the largest page_id of equal payloads are all responses; an empty table writes no
    archive and gives an empty result; other columns are not read.
    """
    return read(write(pages, folder))


ORACLE_SQL = r"""
with p as (select page_id, coalesce(html, '') h from pages),
k as (select page_id, octet_length(encode(h))::bigint payload_bytes, sha1(h) payload_digest, max(page_id) over (partition by h) first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> first then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and page_id <> first then first end refers_to from k
"""
