"""Memory of Python workers, which live on from task to task and from one operator to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa

_tables: list = []


def worker_table(load: Callable) -> Callable:
    """`load`, whose last two results a worker keeps from task to task, until a task of an operator without them begins there."""
    kept = lru_cache(maxsize=2)(load)
    _tables.append(kept)
    return kept


def drop_tables() -> None:
    for kept in _tables:
        kept.cache_clear()


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that; else idle workers hold what their largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` over the batches of a task, without tables that other operators left in the worker, and leaving nothing in it."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        yield from run(batches)
        give_back()

    return held
