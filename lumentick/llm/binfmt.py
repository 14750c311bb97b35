"""Token ids in length-delimited binary records with masked checksums and an offset index.

A shard is two files. ``*.rec`` holds one record after another:

    uint64 length | uint32 masked CRC-32 of those 8 bytes | payload | uint32 masked CRC-32 of the payload

(all little-endian; the mask rotates right by 15 bits and adds 0xA282EAD8, so that checksums of data
which hold checksums stay sound). A payload is a byte of flags (1: has an id, 2: ids are two bytes
wide, else four), the document's id as int64, and the ids. ``*.idx`` holds the byte offset of each
record as uint64 and the end offset, so that a reader may fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, stored
from .tokens import load, plain_specials, settings

#: Forms whose ids a worker keeps from slice to slice, in Arrow arrays (about 40 bytes each).
CACHE = 800_000
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: How many forms of letters go to the library in one text, and the bytes of the longest such form.
JOINED, SHORT = 256, 64
_ids: dict[str, dict[str, pa.Array]] = {}

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
RECORDS = "shard int, start long, doc_id long, n_tokens long, ids_crc32 long"


def _known(tokenizer_path: str) -> dict[str, pa.Array]:
    """The worker's forms; asked for by a function, as tasks get copies of the globals they name themselves."""
    return _ids.setdefault(tokenizer_path, {})


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframed(read, at: int = 0) -> bytes | None:
    """The next payload from ``read(n)``; None at the end."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError(f"damaged record length at {at}")
    n = struct.unpack_from("<Q", head)[0]
    body = read(n + 4)
    if len(body) < n + 4 or struct.unpack_from("<I", body, n)[0] != masked(body[:n]):
        raise ValueError(f"damaged record at {at}")
    return body[:n]


#: By byte: whether it may stand in a tail (ASCII punctuation, but not what begins special strings and contractions).
_TAIL = np.array([33 <= c < 127 and not chr(c).isalnum() and chr(c) not in "<'" for c in range(256)])
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
#: The second byte of a Latin-1 letter after 0xC3.
_LATIN = np.array([128 <= c < 192 and c not in (0x97, 0xB7) for c in range(256)])


def _strings(offsets: np.ndarray, data, kind: pa.DataType) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data or pa.py_buffer(b"")])


def _offsets(a: pa.Array) -> np.ndarray:
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)


def _forms(words: pa.Array) -> pa.Array:
    """Two strings for each word: the form that is encoded, and a tail of punctuation or nothing.

    Between a letter and such a tail the pre-tokenizer always cuts, and it lowers ASCII letters; so
    a form stands for many words. Words with "<" may hold special strings and are left as they are.
    A tail follows an ASCII or Latin-1 letter: of others, some become a letter and a mark, which
    goes with the tail.
    """
    special = pc.match_substring(words, "<")
    words = pc.if_else(pc.and_not(pc.string_is_ascii(words), special), pc.ascii_lower(words), words).cast(pa.large_string())
    at, data = _offsets(words), words.buffers()[2]
    begin, end = at[:-1], at[1:]
    raw = np.frombuffer(data or b"", np.uint8)[: at[-1]]
    # For each position, the end of the last byte before it that can't stand in a tail.
    solid = np.zeros(len(raw) + 1, np.int64)
    np.maximum.accumulate(np.where(_TAIL[raw], 0, np.arange(1, len(raw) + 1)), out=solid[1:])
    cut = np.maximum(solid[end], begin)
    padded = np.concatenate([np.zeros(2, np.uint8), raw])
    letter = _LETTER[padded[cut + 1]] | (_LATIN[padded[cut + 1]] & (padded[cut] == 0xC3))
    bounds = np.empty(2 * len(words) + 1, np.int64)
    bounds[::2] = at
    bounds[1::2] = np.where((cut > begin) & letter & ~special.to_numpy(zero_copy_only=False), cut, end)
    return _strings(bounds, data, pa.large_string())


def _encoded(forms: pa.Array, tokenizer, ends: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, pa.Array]:
    """An order of ``forms``, and in that order the bytes of each one's ids.

    Short forms of letters are encoded many in one text, with spaces between them: each is one
    pre-token, of which the last id alone is in ``ends``. Other forms, and those of a text with more
    ends than forms, are texts of their own.
    """
    plain = pc.and_(pc.utf8_is_alpha(forms), pc.less_equal(pc.binary_length(forms), SHORT)).to_numpy(zero_copy_only=False) & ends.any()
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    texts, joint = forms.take(pa.array(order)).to_pylist(), int(plain.sum())
    size, data = np.zeros(len(texts), np.int64), []
    for a in range(0, joint, JOINED):
        part = texts[a : min(a + JOINED, joint)]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=dtype)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) == len(part) and stops[-1] == len(ids):
            size[a : a + len(part)] = np.diff(stops, prepend=0)
            data.append(ids.tobytes())
        else:
            own = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            size[a : a + len(part)] = [len(x) for x in own]
            data += [np.array(x, dtype=dtype).tobytes() for x in own]
    for a in range(joint, len(texts), 1024):
        own = [e.ids for e in tokenizer.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False)]
        size[a : a + len(own)] = [len(x) for x in own]
        data += [np.array(x, dtype=dtype).tobytes() for x in own]
    return order, _strings(np.concatenate([[0], np.cumsum(size)]) * dtype.itemsize, pa.py_buffer(b"".join(data)), pa.large_binary())


def _ends(tokenizer) -> np.ndarray:
    """By id: whether it ends a pre-token, as its string has the model's suffix for that; none if there is no suffix."""
    n, suffix = tokenizer.get_vocab_size(), getattr(tokenizer.model, "end_of_word_suffix", None)
    return np.array([bool(suffix) and (tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(n)], dtype=bool)


#: The normalizer and the pattern of pre-tokens that ``_forms`` is right for; others take whole texts.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def divisible(tokenizer) -> bool:
    """Whether a text's ids are those of its words' forms: by this normalizer and pattern, white space dropped."""
    normalizer, cutter = settings(tokenizer)
    split = (cutter or {}).get("pretokenizers", [{}])[0]
    cuts = split.get("type") == "Split" and split["pattern"] == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"]
    return bool((normalizer or {}).get("normalizers") == NORMALIZER and cuts and plain_specials(tokenizer))


def encode_batch(texts: pa.Array, tokenizer, cache: dict[str, pa.Array], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a string column and each row's range in them, for a tokenizer that drops white space.

    Its pre-tokens never hold white space and its normaliser works on either side of it alone, so a
    text's ids are those of its words in turn; each distinct form is encoded by the library once.
    ``cache`` keeps the forms known so far and their ids; when they are too many, this call's forms alone.
    """
    if not divisible(tokenizer):
        own = [np.array(tokenizer.encode(x, add_special_tokens=False).ids, dtype=dtype) for x in pc.fill_null(texts, "").to_pylist()]
        return np.concatenate([np.zeros(0, dtype), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    if not cache:
        cache |= {"ends": pa.array(_ends(tokenizer)), "forms": pa.array([], pa.large_string()), "ids": pa.array([], pa.large_binary())}
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = np.asarray(words.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    coded = words.flatten().dictionary_encode()
    pieces = _forms(coded.dictionary).dictionary_encode()
    found = pc.index_in(pieces.dictionary, value_set=cache["forms"])
    at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = np.flatnonzero(at < 0)
    if len(missing):
        order, ids = _encoded(pieces.dictionary.take(pa.array(missing)), tokenizer, cache["ends"].to_numpy(zero_copy_only=False), dtype)
        at[missing[order]] = len(cache["forms"]) + np.arange(len(missing))
        cache["forms"] = pa.concat_arrays([cache["forms"], pieces.dictionary.take(pa.array(missing[order]))])
        cache["ids"] = pa.concat_arrays([cache["ids"], ids])
    own = cache["ids"].take(pa.array(at))
    if len(cache["forms"]) > CACHE:
        cache |= {"forms": pieces.dictionary, "ids": own}
    parts = own.take(pieces.indices)
    by_word = _strings(_offsets(parts)[::2], parts.buffers()[2], pa.large_binary())
    every = by_word.take(coded.indices)
    run = _offsets(every) // dtype.itemsize
    return np.frombuffer(every.buffers()[2] or b"", dtype=dtype)[: run[-1]], run[bounds]


def _target(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``text`` of every row, append ``end_id``, and write shards in ascending order of ``key``.

    Gives the manifest (shard, path, n_docs, n_tokens): one row for each shard that a finished task
    wrote. A repeated task writes a file of its own, and only the finished one is in the manifest.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens"
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        narrow = max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16
        dtype = np.dtype("<u2" if narrow else "<u4")
        end = np.array([end_id], dtype=dtype).tobytes()
        cache = _known(tokenizer_path)
        where, base = _target(folder)
        where.create_dir(base, recursive=True)
        at = TaskContext.get()
        shard = at.partitionId()
        name = f"{base}/{shard:06d}-{at.taskAttemptId()}"
        offsets, pos, tokens = [], 0, 0
        out = None
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if out is None:
                    out = where.open_output_stream(f"{name}.rec", buffer_size=1 << 20)
                ids, bounds = encode_batch(part.column("text"), tokenizer, cache, dtype)
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = ids[bounds[k] : bounds[k + 1]].tobytes()
                    r = framed(b"".join((struct.pack("<Bq", (doc is not None) + 2 * narrow, doc or 0), own, end)))
                    out.write(r)
                    offsets.append(pos)
                    pos += len(r)
                    tokens += bounds[k + 1] - bounds[k] + 1
                del ids
                pa.default_memory_pool().release_unused()
        if out is not None:
            out.close()
            with where.open_output_stream(f"{name}.idx") as index:
                index.write(np.array([*offsets, pos], dtype="<u8").tobytes())
            uri = f"{folder}/{name.rpartition('/')[2]}.rec"
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(offsets)]), pa.array([int(tokens)])], names=["shard", "path", "n_docs", "n_tokens"])

    return stored(rows.mapInArrow(run, MANIFEST), "manifest")


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, dtype="<u2" if flags & 2 else "<u4", offset=9)
    return (doc if flags & 1 else None), ids


def fetch(path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of one shard with these numbers, in this order, through the offset index."""
    where, name = _target(path)
    with where.open_input_file(f"{name.removesuffix('.rec')}.idx") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8")
    out = []
    with where.open_input_file(name) as f:
        for k in numbers:
            f.seek(int(offsets[k]))
            out.append(payload_ids(unframed(f.read, int(offsets[k]))))
    return out


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the shards: shard, start (ids before it in all shards), doc_id, n_tokens, ids_crc32.

    Checksums of lengths and payloads are tested on the way. One row a shard is summed up in one window.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = shards.repartition(max(manifest.count(), 1), F.col("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, name = _target(row["path"])
                start, got = row["first"], []
                with where.open_input_stream(name, buffer_size=1 << 20) as f:
                    while (payload := unframed(f.read)) is not None:
                        doc, ids = payload_ids(payload)
                        got.append((row["shard"], start, doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(got) == 4096:
                            yield _records(got)
                            got = []
                if start - row["first"] != row["n_tokens"]:
                    raise ValueError(f"{row['path']}: {start - row['first']} ids, {row['n_tokens']} written")
                if got:
                    yield _records(got)

    return shards.select("shard", "path", "n_tokens", "first").mapInArrow(run, RECORDS)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "start", "doc_id", "n_tokens", "ids_crc32"])


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token records and read them back: doc_id, start, n_tokens, ids_crc32.

    Defined results: a null or empty text is the end id alone; null ids come first; rows of equal id
    stand side by side in any order; an empty table writes no file and gives an empty result; other
    columns are not read.
    """
    return read(write(docs, tokenizer_path, end_id, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")
