"""Vectorised text helpers for Arrow batches: raw bytes, words and their hashes.

All of them treat a null text as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Run of text bytes that the numpy kernels handle at once (one longer text alone).
SLICE_BYTES = (1 << 20) - 64

_U = np.uint64
#: Bytes that end a word: space, tab, newline, vertical tab, form feed, return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets into them."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first, last, bytes, offsets)."""
    data, offsets = raw(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Integer sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the white-space separated words, and where each text's words begin (n+1)."""
    gap = SPACE[data]
    prev = np.empty(len(data), bool)
    prev[:1] = True
    prev[1:] = gap[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    prev[inner] = True
    starts = np.flatnonzero(prev & ~gap)
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = gap[1:]
    after[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: A random number for each byte at each of the first places of a word.
PLACES = 64
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, (PLACES, 256), _U, endpoint=False).ravel()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of random numbers, one for each byte and its place, well mixed.

    Places beyond ``PLACES`` use the same numbers times an odd one of their own
    for each further run of so many bytes, so no pattern of bytes cancels out.
    """
    if not len(starts):
        return np.zeros(0, _U)
    place = np.zeros(len(data), np.int32)
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data), dtype=np.int32), place, out=place)
    values = _TABLE[(place & (PLACES - 1)) << 8 | data]
    if (ends - starts).max() > PLACES:
        far = np.flatnonzero(place >= PLACES)
        values[far] *= mix((place[far] // PLACES).astype(_U)) | _U(1)
    running = np.zeros(len(data) + 1, _U)
    np.cumsum(values, out=running[1:])
    return mix(running[ends] - running[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))
