"""Vectorised hashes over Arrow text columns: one numpy pass over many rows, no Python loop over characters.

A polynomial hash of any range of a buffer is the difference of two prefix sums, modulo 2**64, divided by a power of the
(odd, hence invertible) base. Prefix sums of a whole slice of rows give every window of every row at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Text is worked on in slices of about this many bytes, so that a task's memory does not follow the batch size.
SLICE_BYTES = 1 << 19
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers[key]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Ranges:
    """Hashes of ranges of one integer array."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = _power(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power(BASE, n + 1)[:n], dtype=np.uint64, out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        """Hash of [p, p + width) for every p; the caller drops those that cross a row's end."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, row offsets in them) of slices of a string column; null is empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    if column.null_count:  # a null may own bytes in the buffer; count it as empty
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        data = column.buffers()[2]
        view = memoryview(data) if data is not None else memoryview(b"")
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, bytes(view[offsets[at] : offsets[to]]), offsets[at : to + 1] - offsets[at]
        at = to
