"""Batches in pieces, so that a worker holds the objects of a few megabytes of text whatever a batch holds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES, MOST_ROWS = 1 << 20, 2000


def pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = MOST_BYTES, most_rows: int = MOST_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has at most most_bytes in a column of text or bytes, and most_rows rows, or one row. At the end, freed memory goes back to the system."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if i > start and (held + n > most_bytes or i - start == most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
