"""Arrow batches in slices, which bound what Python holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a slice.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch in runs of rows of about SLICE_BYTES; of a batch without rows nothing."""
    for b in batches:
        n = max(1, b.num_rows // (b.nbytes // SLICE_BYTES + 1))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)
