"""Texts of Arrow batches as flat byte arrays, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def release() -> None:
    """Hand freed memory back to the system: Spark reuses a worker for later stages, which need their own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield ``(rows, data, bounds)``: some rows, their UTF-8 bytes, and the n + 1 bounds of the texts.

    A slice holds about ``limit`` bytes, or one longer text. A null text counts as empty.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        n = len(column)
        if n == 0:
            continue
        _, offsets, content = column.buffers()
        ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
        data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low), data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
            low = high
    release()


def binaries(parts: list[np.ndarray]) -> pa.Array:
    """A binary column with the bytes of each array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def read_binary(value: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(value, kind)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Yield ``(key, rows)`` for each run of rows with equal integer keys; the rows must be sorted by them."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        places = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(places[:-1], places[1:], strict=True):
            key = tuple(int(c[low]) for c in columns)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(low, high - low))
    if held:
        yield current, pa.Table.from_batches(held)
        held = []
    release()
