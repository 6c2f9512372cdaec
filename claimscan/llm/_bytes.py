"""Vectorised words of UTF-8 columns: numpy over Arrow buffers, inside tasks.

All word patterns of this subpackage are unions of ASCII ranges and all non-ASCII characters, so
they can be decided byte by byte: every byte of a multi-byte character is at least 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at a time; bounds the temporary arrays of a task.
CHUNK_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words(NamedTuple):
    """``words``: all words in order; ``first``: index of each text's first word, and their number at the end."""

    words: pa.Array
    first: np.ndarray
    starts: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for at, to in zip(edges, [*edges[1:], len(sizes)], strict=True):
        yield batch.slice(at, to - at)


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Words:
    """Words of each text: the longest runs of bytes in ``is_word``, never across two texts."""
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return Words(words, np.searchsorted(starts, offsets), starts)


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """An int code for each word, and the distinct words in the order of their codes."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    index, distinct = codes(words)
    each = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    return each[index] if len(index) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_mod(ids: pa.Array, n: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo ``n``; -1 for a null id."""
    import zlib

    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % n for i in ids.to_pylist()], dtype=np.int64)
