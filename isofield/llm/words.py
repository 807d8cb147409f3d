"""Words of Arrow text columns as arrays: where they lie and a 64-bit hash of each, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text whose words are held at once; a longer text is held alone.
BLOCK = 1_000_000
#: Bytes that are hashed at once: parts of a block, or of a text of any length, that end between words.
PART = 1 << 18
BASE = 0x9E3779B97F4A7C15


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] = lambda: None) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow; at the end of a task it forgets what it kept and gives freed memory back to the system.

    Python workers live on after a task and stand beside those of the next stage, so what they hold counts twice.
    """
    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            forget()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return tidied


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of a well-known generator)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U) * U(BASE))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) of runs of rows with about size bytes of UTF-8; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end - row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first byte, first row, bytes, offsets) of parts of about PART bytes that end before white space or with a row.

    A word longer than that makes its part longer. Rows are numbered from the first row of a part.
    """
    at, n = 0, len(data)
    while at < n:
        end = min(at + PART, n)
        bound, step = int(offsets[np.searchsorted(offsets, end)]), 1024
        while end < bound:
            piece = data[end:min(end + step, bound)]
            gap = np.flatnonzero((piece == 0x20) | ((piece >= 9) & (piece <= 13)))
            if len(gap):
                end += int(gap[0])
                break
            end, step = end + len(piece), 2 * step
        low, high = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end)
        yield at, int(low), data[at:end], np.clip(offsets[low:high + 1], at, end) - at
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of each word: a run of bytes other than 0x20 and 0x09-0x0D; lower folds A-Z alone."""
    found = []
    for at, low, piece, own in parts(data, offsets):
        row, start, end, value = _words(piece, own, lower)
        found.append((row + low, start + at, end + at, value))
    return tuple(map(np.concatenate, zip(*found))) if found else _words(data, offsets, lower)


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U)
    inside = np.zeros(n + 1, bool)
    inside[:n] = (data != 0x20) & ((data < 9) | (data > 13))
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    cut = offsets[1:-1]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    ends = ~inside
    ends[cut] = True
    follows = np.zeros(n + 1, bool)
    follows[1:] = inside[:n]
    end = np.flatnonzero(ends & follows)
    table = _byte_values()
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    up, down = _powers(max(2 * PART, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, U)
    np.cumsum(table[data] * up[:n], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, mixed(value + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


#: Bytes of letters: A-Z, a-z and all of UTF-8 beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def stems(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of letters, A-Z folded, and of its first bytes of each of the lengths that it exceeds."""
    found = []
    for _, low, piece, own in parts(data, offsets):
        row, value = _stems(piece, own, lengths)
        found.append((row + low, value))
    return tuple(map(np.concatenate, zip(*found))) if found else _stems(data, offsets, lengths)


def _stems(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:n + 1] = LETTER[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[1:-1]] = True
    start = np.flatnonzero(inside[1:n + 1] & (~inside[:n] | edge[:n]))
    end = np.flatnonzero(inside[1:n + 1] & (~inside[2:] | edge[1:])) + 1
    table = _byte_values().copy()
    table[65:91] = table[97:123]
    up, down = _powers(max(2 * PART, 1 << max(n - 1, 1).bit_length()))
    total = np.zeros(n + 1, U)
    np.cumsum(table[data] * up[:n], out=total[1:])
    row = np.searchsorted(offsets, start, "right") - 1
    base, scale, size = total[start], down[start], end - start
    rows, hashes = [row], [mixed((total[end] - base) * scale)]
    for k in lengths:
        long = size > k
        rows.append(row[long])
        hashes.append(mixed((total[start[long] + k] - base[long]) * scale[long] + U(k)))
    return np.concatenate(rows), np.concatenate(hashes)
