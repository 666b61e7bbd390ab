"""What Python workers do beside their work."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Hand freed memory back to the system: workers live on between tasks, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        return
