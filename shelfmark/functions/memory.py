"""Memory of Python workers, which Spark keeps from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def hand_back() -> None:
    """Give the system what Arrow and the allocator hold without need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only GNU's C library keeps that much
    if trim is not None:
        trim(0)


def handing_back(run: Run) -> Run:
    """``run`` of a ``mapInArrow``, after which its worker is as small as before.

    Freed arrays of some megabytes otherwise stay with the worker, so an executor would
    hold the most that any step so far took, beside what the JVM holds by then.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole
