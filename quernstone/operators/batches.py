"""Stretches of Arrow batches that a Python worker may hold as objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and rows, that a worker holds as Python objects at once (one row at least).
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024


def slices(batch: pa.RecordBatch, column: int):
    """Stretches of an Arrow batch, whose texts in that column are short enough together to
    be held as Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    total, at = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        end = int(np.searchsorted(total, before + SLICE_BYTES, side="right"))
        end = min(max(end, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
