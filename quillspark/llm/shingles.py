"""Vectorised word-shingle hashing over Arrow string columns.

Texts are lower-cased for A-Z only and cut into words at the ASCII white space
``[\\x20\\x09-\\x0D]``.  A document's set holds the 64-bit hashes of its distinct
k-word shingles; a document of 1 to k-1 words has one shingle, the whole
sequence; a document without words (or null) has none.

Everything works on the UTF-8 bytes of the Arrow buffer in slices of bounded
size, so that memory follows the slice (or the longest single text), not the
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed values of the hash family (splitmix64 finaliser and odd multipliers).
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Bytes of text hashed in one go.
SLICE_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _S30)) * _MIX_A
    x = (x ^ (x >> _S27)) * _MIX_B
    return x ^ (x >> _S31)


def stream64(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _STEP)


_BYTE = stream64(256, 1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SLOT = stream64(64, 2) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _STEP, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its ``len + 1`` offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES each; one longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each row."""
    base, end = int(offsets[0]), int(offsets[-1])
    text, cuts = data[base:end], offsets - base
    n = end - base
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(cuts) - 1, np.int64)
    inside = ~_SPACE[text]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = cuts[:-1][cuts[:-1] < n]
    opens[heads] |= inside[heads]
    starts = np.flatnonzero(opens)
    per_row = np.diff(np.searchsorted(starts, cuts))
    if not len(starts):
        return np.zeros(0, np.uint64), per_row
    solid = np.flatnonzero(inside)
    first = np.searchsorted(solid, starts)
    lengths = np.diff(np.append(first, len(solid)))
    place = np.arange(len(solid)) - np.repeat(first, lengths)
    values = _BYTE[text[solid]] * _power_table(int(lengths.max()))[place]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64)), per_row


def shingle_rows(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields ``(first row, shingle hashes, shingles of each row)`` slice by slice, repeats kept."""
    data, offsets = string_bytes(column)
    for lo, hi in _slices(offsets):
        words, per_row = _word_hashes(data, offsets[lo : hi + 1])
        ends = np.cumsum(per_row)
        begins = ends - per_row
        count = np.where(per_row >= k, per_row - k + 1, (per_row > 0).astype(np.int64))
        out_begin = np.cumsum(count) - count
        hashes = np.empty(int(count.sum()), np.uint64)
        if len(words) >= k:
            rolled = np.zeros(len(words) - k + 1, np.uint64)
            for j in range(k):
                rolled += words[j : len(words) - k + 1 + j] * _SLOT[j]
            rolled = mix64(rolled)
            row = np.repeat(np.arange(len(per_row)), per_row)[: len(rolled)]
            valid = np.arange(len(rolled)) + k <= ends[row]
            long_rows = np.repeat(per_row >= k, count)
            hashes[long_rows] = rolled[valid]
        for i in np.flatnonzero((per_row > 0) & (per_row < k)):
            own = words[begins[i] : ends[i]]
            hashes[out_begin[i]] = mix64((own * _SLOT[k : k + len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
        yield lo, hashes, count


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    out: list[np.ndarray] = []
    for _, hashes, count in shingle_rows(column, k):
        at = 0
        for n in count.tolist():
            own = np.sort(hashes[at : at + n])
            if n > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
            out.append(own)
            at += n
    return out
