"""Arrow batches of texts, a bounded part at a time."""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are Python strings at once in a worker; a longer text comes alone.
SLICE_BYTES = 2 << 20


def slices(texts, rows=1024, n_bytes=SLICE_BYTES):
    """Parts of an Arrow array of texts, in order: at most ``rows`` and ``n_bytes`` each, but one text at least.

    A batch is bounded in rows only; as Python objects it takes many times the memory of the texts.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + n_bytes, "right"))))
        yield texts.slice(start, stop - start)
        start = min(stop, len(texts))


def parts(batches, rows=1024, n_bytes=SLICE_BYTES):
    """``slices`` of one batch after another; a batch is let go before the next is asked for."""
    for batch in batches:
        yield from slices(batch, rows, n_bytes)
        del batch


def give_back():
    """Freed memory to the system: workers wait for other tasks, each with what its allocators hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the C library of Linux
        pass
