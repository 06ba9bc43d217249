"""Groups of rows that arrive sorted by their keys: one pass over a partition, no call of a worker for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ, null being equal to null."""
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group, one after another; a group may come in any number of batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k) for k in keys]
        new = np.logical_or.reduce([_differs(c.slice(1), c.slice(0, n - 1)) for c in columns]) if n > 1 else np.zeros(0, bool)
        cut = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        if held and any(_differs(held[-1].column(k).slice(held[-1].num_rows - 1), c.slice(0, 1))[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
