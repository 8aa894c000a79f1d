"""Vectorised word and shingle hashing over Arrow text columns.

Whole batches are hashed from the UTF-8 buffer: a word's hash is a difference of
prefix sums of per-byte random numbers times powers of an odd constant, so no
Python object is made per word. Work is cut into slices of whole texts, which
keeps the memory of a task small whatever the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_numbers(fold: bool) -> np.ndarray:
    numbers = mix(np.arange(1, 257, dtype=U64) * U64(ODD))
    if fold:
        numbers[65:91] = numbers[97:123]
    return numbers


BYTE_NUMBERS = {fold: _byte_numbers(fold) for fold in (False, True)}


def byte_mask(members: bytes) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    mask[list(members)] = True
    return mask


SPACE_MASK = byte_mask(SPACES)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: first row, end row, offsets from 0, bytes."""
    offsets, data = text_buffer(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


class Spans:
    """Words or lines of a slice: byte bounds, row of the slice, hash."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> None:
        self.starts, self.ends, self.row, self.hash = starts, ends, row, hashes

    def __len__(self) -> int:
        return len(self.starts)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the constant and of its inverse up to n; kept up to a few slices."""
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) < n:
        with np.errstate(over="ignore"):
            up, down = np.full(n, ODD, U64), np.full(n, INVERSE, U64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n <= 4 * SLICE_BYTES:
            _POWERS["up"], _POWERS["down"] = up, down
    return up, down


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_NUMBERS[fold][data] * up[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(offsets: np.ndarray, data: np.ndarray, breaks: np.ndarray = SPACE_MASK, fold: bool = False) -> Spans:
    """Maximal runs of bytes outside `breaks`; `fold` hashes A-Z as a-z."""
    inside = ~breaks[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return Spans(starts, ends, row, hash_spans(data, starts, ends, fold))


def lines(offsets: np.ndarray, data: np.ndarray) -> Spans:
    """The \\n-split lines of every text, empty ones and the last included."""
    cut = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], cut + 1])
    ends = np.concatenate([offsets[1:], cut])
    starts.sort()
    ends.sort()
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1])
    row.sort()
    return Spans(starts, ends, row, hash_spans(data, starts, ends))


def _coefficients(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)


def windows(spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within a row, and the index of each one's first word."""
    n = len(spans) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(spans.row[:n] == spans.row[k - 1 :])
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), U64)
        for j, c in enumerate(_coefficients(k)):
            total += spans.hash[at + j] * c
    return mix(total), at


def shingle_sets(spans: Spans, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every row, sorted by row and hash; a row of 1 to k-1 words has one.

    Returns (bounds, hashes): row r owns hashes[bounds[r]:bounds[r + 1]].
    """
    hashes, at = windows(spans, k)
    row = spans.row[at]
    counts = np.bincount(spans.row, minlength=rows)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(spans.row, short)
        total = np.zeros(len(short), U64)
        with np.errstate(over="ignore"):
            for j, c in enumerate(_coefficients(k)):
                have = counts[short] > j
                total[have] += spans.hash[first[have] + j] * c
            total = mix(total + counts[short].astype(U64) * U64(0x8CB92BA72F3D8DD7))
        hashes, row = np.concatenate([hashes, total]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return np.searchsorted(row, np.arange(rows + 1)), hashes
