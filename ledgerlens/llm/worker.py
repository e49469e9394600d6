"""State that a Python worker keeps from task to task (vocabularies, caches)."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_KEPT: dict[Hashable, Any] = {}


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """The state for ``key``, made on first use. A worker keeps one state: that of the operator
    it ran last, so the stages of a pipeline do not add up in its memory."""
    if key not in _KEPT:
        _KEPT.clear()
        _give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def _give_back() -> None:
    """Return memory that earlier operators have freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)
