"""What a worker process keeps between tasks: the tables of one operator at a time.

Spark hands the same worker from stage to stage. Tables that an operator fills as it goes (memos, encoders) stay for its
next task and go as soon as another operator's task begins, so a pipeline needs the memory of its largest stage only.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_held: dict[str, object] = {}


def held(operator: str, make: Callable[[], T]) -> T:
    """The operator's tables, made where there are none; those of other operators are dropped."""
    if operator not in _held:
        _held.clear()
        _give_back()
        _held[operator] = make()
        _give_back()  # what building them took: for the encoder more than it keeps
    return _held[operator]


def _give_back() -> None:
    """Freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
