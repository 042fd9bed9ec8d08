"""Words, hashes and byte slices of a whole Arrow batch of texts, as numpy arrays.

Hashes are 64-bit: a polynomial in an odd base over one random number per byte value, mixed
at the end. They only name things inside an operator; where equality decides a result, the
operator says how it is confirmed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes whose sums and powers are held at once when slices are hashed, 32 bytes for each.
HASHED_BYTES = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240229)
_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        known = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number over all its bits (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[starts[i]:ends[i]] for each i. Slices come in ascending order of their starts:
    those that start in the same HASHED_BYTES are hashed together, so little more than that is at hand."""
    hashes = np.empty(len(starts), dtype=np.uint64)
    cuts = [0, *(np.flatnonzero(np.diff(starts // HASHED_BYTES)) + 1).tolist(), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            low, high = starts[a:b].min(), ends[a:b].max()
            hashes[a:b] = _slice_hashes(data[low:high], starts[a:b] - low, ends[a:b] - low)
    return hashes


def _slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of words[i:i + n] for each i, across text boundaries; from word hashes."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD1342543DE82EF95) + words[k:k + count]
    return mix(h)


def take_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all slices in a row, and where each begins and the last one ends. With
    gap, that byte follows each slice."""
    lengths = (ends - starts).astype(np.int64) + (gap is not None)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.arange(offsets[-1], dtype=np.int64) + np.repeat(starts - offsets[:-1], lengths)
    if gap is None:
        return data[at], offsets
    out = np.full(offsets[-1], gap, dtype=np.uint8)
    inside = np.ones(offsets[-1], dtype=bool)
    inside[offsets[1:] - 1] = False
    out[inside] = data[at[inside]]
    return out, offsets


def string_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    out, offsets = take_slices(data, starts, ends)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


def run_ids(offsets: np.ndarray) -> np.ndarray:
    """Which run each element is in, given where runs begin and the last one ends."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


class Texts:
    """A string column as bytes: data, and offsets where each text begins. Null is empty."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        self.count = len(column)
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + self.count + 1] if self.count else np.zeros(1, np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]

    def marks(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a flag per byte: whether the byte before, and after, is unflagged or in another text."""
        before, after = np.ones(len(flags), dtype=bool), np.ones(len(flags), dtype=bool)
        before[1:], after[:-1] = ~flags[:-1], ~flags[1:]
        filled = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][filled]] = True
        after[self.offsets[1:][filled] - 1] = True
        return before, after

    def words(self, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each maximal run without blanks (or other breaking bytes), and
        the index of each text's first word (with the number of all words behind the last)."""
        solid = ~breaks[self.data]
        before, after = self.marks(solid)
        starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lowered(self) -> Texts:
        other = object.__new__(Texts)
        other.count, other.offsets, other.data = self.count, self.offsets, LOWER[self.data]
        return other


def blocks(batches: Iterable[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches in parts whose texts have about `most` bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            piece = batch.slice(a, b - a)
            yield piece, Texts(piece.column(at))


def distinct_within(run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of one element for each distinct (run, key), in order of both, and how often it occurs."""
    order = np.lexsort((key, run))
    r, k = run[order], key[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))
