"""Vectors inside tasks: usable rows of an Arrow column of number arrays."""

import numpy as np
import pyarrow as pa


def matrix(column):
    """For each usable vector length: (rows, matrix of doubles). A vector is usable if it is not null, not empty, not
    zero, and has only finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    # components of null entries stay out through their length of 0
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, np.diff(offsets), 0)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[offsets[rows][:, None] + np.arange(size)]
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield rows[good], x[good]
