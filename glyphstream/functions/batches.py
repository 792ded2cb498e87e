"""Arrow batches in stretches of bounded bytes, for Spark bounds a batch by rows alone."""

from __future__ import annotations


def by_bytes(batch, col, most: int = 1 << 18):
    """The batch in slices whose column col (a name or a number, of strings or of lists) has most bytes or elements at most; a larger row is alone with few others."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    at = batch.column(col) if isinstance(batch, pa.RecordBatch) else batch
    length = pc.list_value_length if pa.types.is_list(at.type) else pc.binary_length
    upto = np.cumsum(np.asarray(pc.fill_null(length(at), 0), np.int64))
    edges = (np.flatnonzero(np.diff(upto // most)) + 1).tolist()
    for lo, hi in zip([0, *edges], [*edges, len(at)]):
        yield batch.slice(lo, hi - lo)
