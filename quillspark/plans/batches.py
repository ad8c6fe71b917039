"""Arrow batches cut into pieces of bounded size, so that a task's memory does not depend on how long texts are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters, bytes or tokens of a piece.
PIECE = 500_000


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each string, or elements of each list; null has none."""
    of = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    return of(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in pieces of about ``most`` in the ``columns`` together; a longer row is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = sum(lengths(batch.column(c)) for c in columns)
        at = (np.cumsum(sizes) - sizes) // most
        starts = np.append(0, np.flatnonzero(np.diff(at)) + 1)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
