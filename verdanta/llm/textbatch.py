"""Whole texts of an Arrow batch as flat numpy arrays: words, word hashes and shingles.

No Python string is made for a word. A text column's UTF-8 buffer is cut into
chunks of whole rows, white space is found by a table look-up, and each word
gets a 64-bit hash: a polynomial in its bytes, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 2 * len(_powers), 256), _BASE, np.uint64)
        step[0] = 1
        _powers = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row (and one past) the index of its first word."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = solid
    edge[offsets[:-1]] = False
    starts = np.flatnonzero(solid & ~edge[:-1])
    edge[:-1] = solid
    edge[-1] = False
    edge[offsets] = False
    ends = np.flatnonzero(solid & ~edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash for each run of ``units`` (numbers under 2**32) given by start and length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(first[-1] + lengths[-1])) - np.repeat(first, lengths)
    values = units[np.repeat(starts, lengths) + place].astype(np.uint64) + np.uint64(1)
    values *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words with A-Z lower-cased, starts, ends, first word of each row and one past)."""
    starts, ends, bounds = find_words(data, offsets)
    return run_hashes(LOWER[data], starts, ends - starts), starts, ends, bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each row, repeated ones too, and each row's bounds in them.

    A row with fewer words (but one at least) has one shingle: all its words.
    """
    n, counts = len(hashes), np.diff(bounds)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    total = np.zeros(n, np.uint64)
    for k in range(width):
        salt = np.uint64((0xA0761D6478BD642F * (2 * k + 3) + k) & _MASK)
        total[: n - k] += mix(hashes[k:] ^ salt) * (salt | np.uint64(1))
    total = mix(total)
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(len(counts)), sizes)
    at = bounds[:-1][row] + np.arange(int(out_bounds[-1])) - out_bounds[:-1][row]
    values = total[at]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        part = np.uint64(int(counts[i]) * 0x9FB21C651E98DF25 & _MASK)
        for k, h in enumerate(hashes[bounds[i] : bounds[i + 1]]):
            part = mix(np.array([part ^ h ^ np.uint64(k + 1)], np.uint64))[0]
        values[out_bounds[i]] = part
    return values, out_bounds


def gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[offsets[i]:offsets[i+1]]`` for i in ``which`` one after another, and their lengths."""
    lengths = offsets[which + 1] - offsets[which]
    first = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    return flat[np.repeat(offsets[which] - first, lengths) + np.arange(total)], lengths
