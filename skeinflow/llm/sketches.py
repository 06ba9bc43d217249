"""Count-min sketches with counters that stop at two, made by tasks, merged block by block, and read as bitmaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a sketch; log2 of the cells that tasks address, and of the blocks by which cells are merged.
ROWS, CELL_BITS, BLOCK_BITS = 2, 32, 6
U = np.uint64


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each 64-bit key in a row of 2**bits cells: two disjoint halves of the key."""
    return ((keys >> U(32)) if row == 0 else (keys & U(0xFFFFFFFF))) >> U(CELL_BITS - bits)


def partial_rows(keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """A task's sketch, sparsely: for each row and block the cells counted once and those counted more often."""
    out = []
    for row in range(ROWS):
        c, at = np.unique(cells(keys, row, CELL_BITS), return_inverse=True)
        n = np.bincount(at, counts, len(c))
        bounds = np.searchsorted(c, np.arange((1 << BLOCK_BITS) + 1, dtype=U) << U(CELL_BITS - BLOCK_BITS))
        for b in range(1 << BLOCK_BITS):
            lo, hi = bounds[b], bounds[b + 1]
            if hi > lo:
                part, many = c[lo:hi].astype(np.uint32), n[lo:hi] > 1
                out.append((row << BLOCK_BITS | b, part[~many].tobytes(), part[many].tobytes()))
    return out


def merged(sketches: DataFrame, bits: int) -> list[np.ndarray]:
    """Bitmaps, one for each row, of the cells that count two or more over all tasks; 2**bits cells in each.

    sketches: (block int, once binary, more binary) of partial_rows(). A block's counters, 2**(bits - BLOCK_BITS)
    bytes, are added up in one task, a batch at a time; bitmaps of 2**bits / 8 bytes reach the driver.
    """
    if bits < BLOCK_BITS + 3:
        raise ValueError("too few cells for the blocks")
    width = 1 << (bits - BLOCK_BITS)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.uint8)
        for batch in batches:
            for name, n in (("once", 1), ("more", 2)):
                for raw in batch.column(name):
                    at = (np.frombuffer(raw.as_py() or b"", np.uint32) >> np.uint32(CELL_BITS - bits)) & np.uint32(width - 1)
                    # Cells of a part may meet when the sketch is folded to fewer cells.
                    at, k = np.unique(at, return_counts=True)
                    counts[at] = np.minimum(counts[at] + np.minimum(k * n, 2), 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["block", "bitmap"])

    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]
    for r in sketches.groupBy("block").applyInArrow(add, "block int, bitmap binary").collect():
        row, b = divmod(r.block, 1 << BLOCK_BITS)
        out[row][b * width // 8 : (b + 1) * width // 8] = np.frombuffer(r.bitmap, np.uint8)
    return out


def maybe_repeated(keys: np.ndarray, bitmaps: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether the sketch estimates two or more for a key: never false for a key that is there twice."""
    ok = np.ones(len(keys), bool)
    for row, bitmap in enumerate(bitmaps):
        c = cells(keys, row, bits)
        ok &= (bitmap[c >> U(3)] >> (U(7) - (c & U(7))).astype(np.uint8)) & 1 > 0
    return ok


def bits_for(n: int, least: int = 16, most: int = 29) -> int:
    """Four to eight cells for each key, within bounds: 2 rows of 2**29 bits are 128 MB wherever they are read."""
    return min(most, max(least, max(1, int(n)).bit_length() + 2))
