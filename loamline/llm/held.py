"""What a Python worker keeps between tasks: the cache of one operator, so that those of a pipeline's stages don't add up."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_HELD: dict[tuple[str, str], object] = {}


def held(kind: str, key: str, make: Callable[[], T]) -> T:
    """The object that is kept under this name; a new one takes the place of all others."""
    if (kind, key) not in _HELD:
        release()
        _HELD[kind, key] = make()
    return _HELD[kind, key]


def release() -> None:
    """Drop what earlier operators left."""
    if _HELD:
        _HELD.clear()
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)
