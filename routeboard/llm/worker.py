"""What a Python worker keeps between tasks, one operator's share at a time.

Spark reuses its Python workers for task after task, also those of another
operator.  Caches that outlive a task are therefore held under a name, and an
operator that starts in a worker drops what others have left there, so a
worker's memory is bounded by one operator's caches whatever ran before.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_held: dict[str, Callable[[], object]] = {}


def hold(name: str, drop: Callable[[], object]) -> None:
    """Called when an operator's task starts: ``drop`` empties its caches once another operator takes over."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    if others:
        gc.collect()
        try:     # hand freed pages back to the system, where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass
    _held[name] = drop
