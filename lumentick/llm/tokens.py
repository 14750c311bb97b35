"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks. Within an overlap, a position is a *common stable
boundary* when both chunks begin a pre-token there and it lies at least ``GUARD`` characters before
the left chunk's end. The pre-tokenizer's pattern matches forward only and looks ahead by less than
``GUARD`` characters, so what the left chunk has decided so far is what the whole text gives, and
from a shared beginning on the right chunk goes on as the whole text does. The left chunk's tokens
before the boundary and the right chunk's tokens from it on are spliced. Without such a boundary the
overlap is widened (doubled) and the right chunk encoded again, at last from the left chunk's begin.

Ordinary texts take the same library, one call for each distinct piece of a batch: a pre-token never
runs from a non-space into a space, so a text without adjacent white space splits exactly before
each single space. Other texts are encoded whole, and so are all texts of a tokenizer with a normalizer,
another pre-tokenizer or special strings that take in white space (see ``divisible``).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Characters before a chunk's end that prove nothing: more than a special string or a look-ahead needs.
GUARD = 64
#: Distinct pieces whose counts a worker keeps.
CACHE = 400_000
_TWO_SPACES = r"[\s\x0b\x1c-\x1f\x85\pZ][\s\x0b\x1c-\x1f\x85\pZ]"

_tokenizers: dict[str, object] = {}
_counts: dict[str, dict[str, int]] = {}


def load(path: str):
    """The tokenizers library's object for ``path``, one for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        _tokenizers[path] = t
    return _tokenizers[path]


def settings(tokenizer) -> tuple[dict | None, dict | None]:
    """A tokenizer's normalizer and pre-tokenizer, as its file states them."""
    return tuple(x and json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))


def plain_specials(tokenizer) -> bool:
    """Whether every special string is matched as it is: without white space in it or taken from around it."""
    return not any(x.lstrip or x.rstrip or x.single_word or x.normalized or re.search(r"\s", x.content) for x in tokenizer.get_added_tokens_decoder().values())


def divisible(tokenizer) -> bool:
    """Whether texts may be cut as this module does: byte-level pre-tokens by the usual pattern, nothing normalised."""
    normalizer, cutter = settings(tokenizer)
    usual = cutter is not None and cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
    return normalizer is None and usual and plain_specials(tokenizer)


def _begins(e) -> tuple[list[int], list[int]]:
    """Positions at which pre-tokens begin, and the number of tokens before each."""
    words, offsets = e.word_ids, e.offsets
    at, before = [], []
    for i, (w, o) in enumerate(zip(words, offsets)):
        if i == 0 or w != words[i - 1] or w is None:
            if not at or o[0] > at[-1]:
                at.append(o[0])
                before.append(i)
    return at, before


def spliced(text: str, tokenizer, chunk: int, overlap: int) -> list[int]:
    """The token ids of ``text``, encoded in chunks of ``chunk`` characters with ``overlap`` in common."""

    def encode(lo: int, hi: int):
        e = tokenizer.encode(text[lo:hi], add_special_tokens=False)
        at, before = _begins(e)
        return lo, e.ids, [x + lo for x in at], before

    out: list[int] = []
    hi = min(chunk, len(text))
    lo, ids, at, before = encode(0, hi)
    skip = 0  # tokens of the current chunk that are already out, or that came before its first stable boundary
    floor = 0  # the position from which this chunk's tokens count
    while hi < len(text):
        # A chunk that did not splice is followed by one twice as long, so re-encoding adds up to a constant factor.
        next_hi = min(hi + max(chunk, hi - floor if lo == floor else 0), len(text))
        stable = [(p, b) for p, b in zip(at, before) if floor < p < hi - GUARD]
        wide = overlap
        while True:
            begin = max(hi - wide, floor) if stable else floor
            if stable and begin > floor and stable[-1][0] < begin:
                wide *= 2
                continue
            new = encode(begin, next_hi)
            right = dict(zip(new[2], new[3]))
            # Where the right chunk begins proves nothing unless the left one has a boundary there too.
            common = next(((p, b) for p, b in reversed(stable) if p in right), None)
            if common:
                p, b = common
                out += ids[skip:b]
                (lo, ids, at, before), skip, floor, hi = new, right[p], p, next_hi
                break
            if begin <= floor:
                # Nothing stable from here to the end: one longer chunk takes this one's place.
                (lo, ids, at, before), hi = new, next_hi
                skip = right.get(floor, 0)
                break
            wide *= 2
    return out + ids[skip:]


def count_batch(texts: pa.Array, tokenizer, cache: dict[str, int], huge: int, chunk: int, overlap: int) -> np.ndarray:
    """Token counts of a string column."""
    texts = pc.fill_null(texts, "")
    n = np.zeros(len(texts), dtype=np.int64)
    if not len(texts):
        return n
    if not divisible(tokenizer):
        return np.array([len(tokenizer.encode(x, add_special_tokens=False)) for x in texts.to_pylist()], dtype=np.int64)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    whole = pc.match_substring_regex(texts, _TWO_SPACES).to_numpy(zero_copy_only=False) & (chars < huge)
    for i in np.flatnonzero(chars >= huge):
        n[i] = len(spliced(texts[int(i)].as_py(), tokenizer, chunk, overlap))
    rest = np.flatnonzero(whole)
    for a in range(0, len(rest), 64):
        got = tokenizer.encode_batch_fast([texts[int(i)].as_py() for i in rest[a : a + 64]], add_special_tokens=False)
        n[rest[a : a + 64]] = [len(e) for e in got]
    plain = np.flatnonzero(~whole & (chars < huge))
    pieces = pc.split_pattern(texts.take(pa.array(plain)), " ")
    offsets = np.asarray(pieces.offsets) - (pieces.offsets[0].as_py() if len(pieces.offsets) else 0)
    flat = pieces.flatten()
    # The first piece of a text has no space before it: it is counted apart.
    for i, p in zip(plain, flat.take(pa.array(offsets[:-1])).to_pylist()) if len(plain) else ():
        if p:
            if p not in cache:
                _fill(cache, [p], tokenizer)
            n[i] += cache[p]
    mask = np.ones(len(flat), dtype=bool)
    mask[offsets[:-1]] = False
    coded = pc.dictionary_encode(flat)
    names = [" " + x for x in coded.dictionary.to_pylist()]
    used = np.zeros(len(names), dtype=bool)
    index = np.asarray(coded.indices)
    used[index[mask]] = True
    missing = [x for x, u in zip(names, used) if u and x not in cache]
    for a in range(0, len(missing), 4096):
        _fill(cache, missing[a : a + 4096], tokenizer)
    value = np.fromiter((cache[x] if u else 0 for x, u in zip(names, used)), dtype=np.int64, count=len(names))
    run = np.concatenate([[0], np.cumsum(np.where(mask, value[index] if len(index) else 0, 0))])
    n[plain] += run[offsets[1:]] - run[offsets[:-1]]
    if len(cache) > CACHE:
        cache.clear()
    return n


def _fill(cache: dict[str, int], pieces: list[str], tokenizer) -> None:
    for p, e in zip(pieces, tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
        cache[p] = len(e)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
                 huge: int = 32_768, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """``keys``, n_bytes, n_tokens and over_limit of each row's whole ``text``.

    Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each on
    its own; an empty table gives an empty result; very long texts are encoded in chunks that grow where no
    boundary is found, up to the whole text; columns other than ``keys`` and ``text`` are not read.
    """
    took = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = took.drop("__text").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(tokenizer_path)
        cache = _counts.setdefault(tokenizer_path, {})
        for batch in batches:
            for part in slices(batch, "__text", 4 << 20):
                col = part.column("__text")
                tokens = count_batch(col, tokenizer, cache, huge, chunk, overlap)
                size = pc.cast(pc.fill_null(pc.binary_length(col), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], size, pa.array(tokens), pa.array(tokens > limit)], names=schema.names)

    return took.mapInArrow(run, schema)
