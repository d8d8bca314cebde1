"""Vectorised words and hashes over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once in numpy, so that memory doesn't follow the size of Arrow batches.
SLICE_BYTES = 2 << 20


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mixed(z)


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


BYTE_CODES = _splitmix(256, 11) | np.uint64(1)
PLACE_CODES = _splitmix(64, 12) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1024), np.uint64(0xD1342543DE82EF95), np.uint64))))
    return _powers[:n]


def lookup(members: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members.encode() if isinstance(members, str) else members)] = True
    return table


#: The space and the characters 9 to 13.
SPACE = lookup(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of successive runs of rows of about ``limit`` bytes; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()), "" if not pa.types.is_binary(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~gap[data]
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``data[start:end]``, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        parts = BYTE_CODES[data[place + np.repeat(starts, lens)]] * powers(int(lens.max()))[place]
        return mixed(np.add.reduceat(parts, first) + lens.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k`` consecutive words at each place, by row, and where each row's begin.

    A row of fewer words, but not none, has its whole sequence as one.
    """
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(int(begin[-1]), np.uint64)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            full += hashes[j : len(hashes) - k + 1 + j] * PLACE_CODES[j] if len(full) else full
        full = mixed(full)
        for i in np.flatnonzero((n_words > 0) & (n_words < k)):
            own = hashes[first[i] : first[i + 1]]
            out[begin[i]] = mixed((own * PLACE_CODES[: len(own)]).sum(keepdims=True) + np.uint64(len(own)) * PLACE_CODES[63])[0]
    for i in np.flatnonzero(n_words >= k):
        out[begin[i] : begin[i + 1]] = full[first[i] : first[i] + counts[i]]
    return out, begin


def sorted_sets(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in order, and where each row's begin. Changes ``values``."""
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[begin[:-1][begin[:-1] < len(values)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], total[begin]
