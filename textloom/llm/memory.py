"""Python workers that give memory back.

A worker lives on from stage to stage, and the allocators of C and Arrow keep what was freed. Kernels wrapped by
:func:`steady` return it after each batch, so a worker holds what one batch needs and not the most that any ever did.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa


@cache
def _trim() -> Callable[[], object]:
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda: None
    return lambda: trim(0)


def release() -> None:
    _trim()()


_caches: dict[str, Callable[[], None]] = {}


def register(name: str, clear: Callable[[], None]) -> None:
    """What a module keeps in a worker from task to task; it goes when the worker begins other work."""
    _caches[name] = clear


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def steady(kernel: Kernel, keeps: str = "") -> Kernel:
    """The kernel of a mapInArrow, returning memory after each batch it yields and at its end. ``keeps``: the cache that
    it uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, clear in _caches.items():
            if name != keeps:
                clear()
        release()
        for out in kernel(batches):
            yield out
            del out
            release()
        release()

    return run
