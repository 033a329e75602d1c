"""Vectorised text kernels that tasks apply to Arrow string columns, a bounded chunk at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes of words that are hashed at once.
HASH_BYTES = 1 << 21

_U64 = np.uint64
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_WORD_BASE = _U64(0x9E3779B97F4A7C15)
_SHINGLE = np.random.Generator(np.random.PCG64(71)).integers(1, 2**63, 64, dtype=np.uint64) | _U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits of a polynomial hash are equally good."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(29))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(32))


def string_column(column) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer row is a run of its own.

    Null texts are empty. Offsets are relative to the run's bytes and have one entry more than it has rows.
    """
    column = string_column(column)
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True in ``inside``; no run crosses a row boundary in ``offsets``."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = inside[starts]
    return starts[keep], ends[keep]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the runs taken some at a time and a very long one in pieces."""
    lengths = ends - starts
    sums = np.zeros(len(starts), dtype=np.uint64)
    powers = np.full(min(int(lengths.max(initial=0)), HASH_BYTES), _WORD_BASE)
    powers[:1] = 1
    powers = np.multiply.accumulate(powers)
    after = np.cumsum(lengths)
    first = 0
    while first < len(starts):
        before = int(after[first] - lengths[first])
        end = int(np.searchsorted(after, before + HASH_BYTES, side="right"))
        if end <= first:  # a run longer than that
            for a in range(int(starts[first]), int(ends[first]), HASH_BYTES):
                part = _BYTE_CODES[data[a : min(a + HASH_BYTES, int(ends[first]))]]
                sums[first : first + 1] += (part * powers[: len(part)]).sum(dtype=np.uint64, keepdims=True) * _U64(pow(int(_WORD_BASE), a - int(starts[first]), 2**64))
            end = first + 1
        else:
            size = lengths[first:end]
            shift = np.cumsum(size) - size
            place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(shift, size)
            sums[first:end] = np.add.reduceat(_BYTE_CODES[data[np.repeat(starts[first:end], size) + place]] * powers[place], shift)
        first = end
    return mix64(sums + lengths.astype(np.uint64) * _U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of each, starts, ends) of the words between bytes of ``gap``, A-Z lower-cased."""
    data = LOWER[data]
    starts, ends = runs(~gap[data], offsets)
    return hash_runs(data, starts, ends), np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows' entries begin in a sorted array of row numbers; one entry more at the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of every window of ``k`` words within a row; a row with fewer words gives one of all its words."""
    bounds = row_bounds(rows, n)
    counts = np.diff(bounds)
    out = np.zeros(len(hashes), dtype=np.uint64)
    for j in range(min(k, len(hashes))):
        out[: len(hashes) - j] += hashes[j:] * _SHINGLE[j]
    full = np.arange(len(hashes)) + k <= np.repeat(bounds[1:], counts)
    out = mix64(out + _U64(k))
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:
        part = hashes[bounds[r] : bounds[r + 1]]
        full[bounds[r]] = True
        out[bounds[r]] = mix64((part * _SHINGLE[: len(part)]).sum(dtype=np.uint64, keepdims=True) + _U64(len(part)))[0]
    return out[full], rows[full]
