"""Rolling hashes over the bytes of text columns, for the operators that read texts in numpy.

Tables are small (about 2 MB a worker) and shared by all operators, and texts are read in slices of bounded bytes, so that
a task's memory does not depend on how many texts a batch holds. Hashes are polynomials modulo 2**64 over a random number
for each byte, mixed so that any of their bits are usable.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes hashed with one run of powers.
PIECE = 1 << 16
#: Bytes of text held at a time; a longer text is a slice of its own.
SLICE = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def give_back() -> None:
    """Memory that Arrow and the C library hold for later goes back to the system; for the end of a task, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run`` (batches to batches), with memory given back when it ends."""

    @functools.wraps(run)
    def own(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@functools.cache
def tables(which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and 2 * PIECE powers of an odd base and of its inverse."""
    power = lambda b: np.multiply.accumulate(np.r_[U(1), np.full(2 * PIECE, b, U)])
    base = _BASES[which]
    return np.random.default_rng(11 + which).integers(0, 2**64, 256, dtype=np.uint64), power(U(base)), power(U(pow(base, -1, 2**64)))


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums of the hashed bytes before each place of ``data``, which has at most 2 * PIECE bytes."""
    values, powers, _ = tables(which)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * powers[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they lie."""
    return mix((sums[end] - sums[start]) * tables(which)[2][start])


def arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offsets of its values in them, from 0."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[int(offsets[0]) : int(offsets[-1])] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of ``column``; a longer value is alone."""
    if not len(batch):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def joined(column: pa.Array, between: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with the byte ``between`` after each, and where each text starts (and the last ends)."""
    data, offsets = arrays(column)
    n = len(offsets) - 1
    out = np.full(len(data) + n, between, np.uint8)
    for i in range(n):
        out[offsets[i] + i : offsets[i + 1] + i] = data[offsets[i] : offsets[i + 1]]
    return out, offsets + np.arange(n + 1)


def word_hashes(data: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of ``data``, lower-cased ASCII; words are runs of bytes that don't separate."""
    space = separators[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        lo, hi = start[at], end[stop - 1]
        if hi - lo <= 2 * PIECE:
            sums = prefix_sums(LOWER[data[lo:hi]])
            s, e = start[at:stop] - lo, end[at:stop] - lo
            out[at:stop] = span_hashes(sums, s, e) + (e - s).astype(U)
        else:  # one word of many thousand bytes
            out[at] = xxhash.xxh64_intdigest(LOWER[data[lo:hi]].tobytes())
        at = stop
    return start, mix(out)
