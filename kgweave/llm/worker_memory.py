"""What a Python worker keeps between tasks, and when it lets go of it.

Spark keeps workers for the next task, and each with all it holds. Encoders and counters are worth keeping while tasks
of one operator follow each other; a worker that does nothing for a few seconds, or begins something else, forgets
them and gives the memory back."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import threading

#: Seconds without a task after which a worker forgets.
IDLE = 3.0
#: Caches of modules of this package, by name.
CACHES = (("tokens", "encoder"), ("token_counts", "counter"))
_state: dict = {"tasks": 0, "doing": None, "timer": None}
_lock = threading.RLock()


def forget() -> None:
    for module, name in CACHES:
        loaded = sys.modules.get(f"{__package__}.{module}")
        if loaded is not None:
            getattr(loaded, name).cache_clear()
    gc.collect()
    release()


def release() -> None:
    """Gives freed memory back to the system, where its C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _idle() -> None:
    with _lock:
        if not _state["tasks"]:
            forget()


@contextlib.contextmanager
def task(doing: int):
    """Around a task; doing tells one operator's function from another's."""
    with _lock:
        _state["tasks"] += 1
        if _state["timer"] is not None:
            _state["timer"].cancel()
        if _state["doing"] not in (None, doing) and _state["tasks"] == 1:
            forget()
        _state["doing"] = doing
    try:
        yield
    finally:
        with _lock:
            _state["tasks"] -= 1
            _state["timer"] = threading.Timer(IDLE, _idle)
            _state["timer"].daemon = True
            _state["timer"].start()
        release()
