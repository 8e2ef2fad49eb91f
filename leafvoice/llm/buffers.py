"""Arrow string columns as numpy arrays: rows, words and 64-bit fingerprints without Python objects.

Texts are handled as UTF-8 bytes. A slice holds at most ``SLICE_BYTES`` of text (a longer text is a slice of its
own), which bounds the memory of a task whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of the words [^\x20\x09-\x0D]+
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


def text_slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """(rows of the batch, bytes, offsets from 0) for each slice."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
        for a, b in slices(offsets, most):
            part = offsets[a: b + 1]
            yield batch.slice(a, b - a), data[part[0]: part[-1]], part - part[0]


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~blank[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_P, _P_INV))
    return _powers


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Sums whose differences, scaled by ``powers``, are polynomial fingerprints of the spans between."""
    up, _ = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, _U)
    np.cumsum((symbols.astype(_U) + _U(1)) * up[: len(symbols)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of symbols[start:end]."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = BLANK):
    """Fingerprints of the words, and the index of each row's first word."""
    if lower:
        data = LOWER[data]
    starts, ends, first = words(data, offsets, blank)
    return span_hashes(prefix_sums(data), starts, ends), first


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lists(values: pa.Array, first: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)
