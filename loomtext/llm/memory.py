"""Gives memory of Python workers back to the system, so that idle and reused workers stay small."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

#: Fixed value: glibc's number for the size from which an allocation is a mapping of its own.
_MMAP_THRESHOLD = -3
MAPPED_BYTES = 1 << 20


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library: nothing to set
        return None


def large_arrays_apart() -> None:
    """From now on large arrays go back to the system as they are freed, those of Arrow too."""
    if _libc() is not None:
        _libc().mallopt(_MMAP_THRESHOLD, MAPPED_BYTES)
        pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)
