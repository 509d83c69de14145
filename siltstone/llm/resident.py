"""What a Python worker keeps between tasks: the tables of one operator at a time.

Spark hands a worker process from task to task. Tokenizers, vocabularies and look-up tables are worth
keeping for the next task of the same operator, but would add up over the stages of a pipeline.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_held: dict = {}
_cleaners: list[Callable[[], None]] = []
_operator = ""


def cleaned(clear: Callable[[], None]) -> None:
    """Call ``clear`` whenever a worker turns to another operator."""
    _cleaners.append(clear)


def trim(collect: bool = True) -> None:
    """Give freed memory back to the system; with ``collect``, that of cycles too."""
    if collect:
        gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library keeps what it keeps
        pass


def one_thread() -> None:
    """Let this process's matrix products take one thread: its task has one core."""
    try:
        import numpy._core._multiarray_umath as umath

        library = ctypes.CDLL(umath.__file__)
    except (ImportError, OSError):
        return
    for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
        if hasattr(library, name):  # another library keeps its threads
            getattr(library, name)(1)


def enter(operator: str) -> None:
    """Say whose task this is; what another operator has left in this process goes."""
    global _operator
    if operator == _operator:
        return
    _operator = operator
    _held.clear()
    for clear in _cleaners:
        clear()
    trim()


def resident(make: Callable, *args):
    """``make(*args)``, made once for the operator at work in this process."""
    key = make.__module__, make.__qualname__, args
    if key not in _held:
        _held[key] = make(*args)
    return _held[key]
