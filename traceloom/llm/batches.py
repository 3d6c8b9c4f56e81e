"""Arrow batches cut to a bounded number of text bytes, so a worker's memory does not follow the batch's row count."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_kept: dict[Any, Any] = {}


def worker_state(key: Any, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, built once. A worker keeps one such thing at a time, for workers outlive a
    stage and their memory is shared with the next stage's."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def drop_worker_state() -> None:
    """Forget what is kept and give its memory back to the system, as the next stage's tasks run in this process."""
    if _kept:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keep_state: bool = False) -> Iterator[pa.RecordBatch]:
    """Row ranges of each batch whose ``column`` holds at most ``limit`` bytes together; a longer row comes alone.

    Unless the caller uses it, what an earlier stage left in this worker is dropped.
    """
    if not keep_state:
        drop_worker_state()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def packed(texts_utf8: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, and the start of each text with the total at the end."""
    starts = np.zeros(len(texts_utf8) + 1, np.int64)
    np.cumsum([len(t) for t in texts_utf8], out=starts[1:])
    return np.frombuffer(b"".join(texts_utf8), np.uint8), starts
