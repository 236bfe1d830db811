"""Memory of Python workers, which outlive a task and serve the stages that follow."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Give back to the system what is free: allocators keep it otherwise, worker by worker and stage by stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(run: Rows) -> Rows:
    """The same function of batches, which releases what an earlier stage left and what its own task used."""
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return held
