"""Groups of consecutive equal keys in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Every run of equal keys as one table, also where it spans batches.

    The caller sorts by ``key`` within partitions. Memory holds a batch and one
    group, so groups must be bounded by the caller.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def list_rows(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The lists of a list column as arrays, without a Python object for each value."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values = chunk.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        ends = np.cumsum(np.nan_to_num(np.asarray(chunk.value_lengths().to_numpy(zero_copy_only=False), float))).astype(int)
        out += np.split(values, ends[:-1]) if len(ends) else []
    return out
