"""What the operators share: stored tables, shipping this package to workers, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from tracemill.functions.scratch import drop_stored, scratch, stored
from tracemill.functions.shipping import ship

__all__ = ["LOWER", "WORD", "drop_stored", "give_back", "scratch", "ship", "stored", "tidied", "words_of"]

#: Lower-cases A-Z only; bytes.split() then cuts at x20 and x09-x0D.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The same as a pattern for the JVM.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8; none for null or empty."""
    return text.translate(LOWER).split() if text else []


def give_back() -> None:
    """Gives a worker's unused memory back: it lives on beside its executor, between tasks of many jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with give_back() after its last batch."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
