"""Vectorised words and hashes over the contiguous bytes of an Arrow string column.

Words are maximal runs of characters outside U+0020 and U+0009-U+000D. None of those bytes occurs
inside a multi-byte UTF-8 sequence, so the split is done on bytes, for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd base of the polynomial hashes of word sequences.
WORD_BASE = 0xD6E8FEB86659FD93
#: Places in a word whose random numbers are kept in a table; those of later places are made when needed.
PLACES = 64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to the longest asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, U64)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def place_numbers(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random number for each byte at each place of a word."""
    return mix((place.astype(U64) << U64(8) | byte.astype(U64)) + U64(0x9E3779B97F4A7C15))


PLACE_TABLE = place_numbers(np.tile(np.arange(256), PLACES), np.repeat(np.arange(PLACES), 256))


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of all words of ``data``: the sum of a random number for each byte at its place, and the length.

    Unlike a polynomial modulo 2**64, this has no two patterns that are equal for every base.
    """
    out = np.zeros(len(starts), U64)
    sizes = ends - starts
    total = np.cumsum(sizes)
    byte, at = data[~SPACE[data]], 0
    while at < len(starts):  # about 256 KB of words at a time
        done = int(total[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(total, done + (1 << 18), "right")))
        own, first = sizes[at:to], total[at:to] - sizes[at:to] - done
        place = np.arange(int(total[to - 1]) - done) - np.repeat(first, own)
        here = byte[done : int(total[to - 1])].astype(np.int64)
        numbers = PLACE_TABLE[np.minimum(place, PLACES - 1) << 8 | here]
        late = np.flatnonzero(place >= PLACES)
        if len(late):
            numbers[late] = place_numbers(here[late], place[late])
        out[at:to] = np.add.reduceat(numbers, first)
        at = to
    return mix(out + sizes.astype(U64) * U64(0xA0761D6478BD642F))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], each in constant time from prefix sums."""
    n = len(values)
    total = np.zeros(n + 1, U64)
    np.cumsum(values.astype(U64) * powers(base, n), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((total[ends] - total[starts]) * inverse[starts])


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings (null: empty) and the len+1 offsets."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of all words, and the len+1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def parts(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20, most_rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about most_bytes of text and at most most_rows rows each (one longer text is a slice of its own), so that memory follows the longest text and not the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = min(at + most_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to
