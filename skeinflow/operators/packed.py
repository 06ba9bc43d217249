"""F2 elimination on bit-packed words: leading bits, elimination word by word, and by tables of row combinations.

A matrix is an array of uint64 with a row for each vector, bit i of a vector in word i // 64. A boundary map's columns
are the vectors; its rows are the bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np

U = np.uint64
#: Bits that one table of row combinations clears: 2**8 combinations are made by eight steps.
TABLE_BITS = 8
#: Entries that stand alone are taken off before a sparse matrix is packed, as long as a round takes off such a part.
LEAST_PART = 1 / 200


def pack(indptr: np.ndarray, indices: np.ndarray, rows: int) -> np.ndarray:
    """Compressed columns as packed vectors of so many bits; repeated entries count once."""
    cols, words = len(indptr) - 1, max(1, -(-rows // 64))
    out = np.zeros(cols * words, U)
    if len(indices):
        indices = indices.astype(np.int64)
        at = np.repeat(np.arange(cols, dtype=np.int64), np.diff(indptr)) * words + (indices >> 6)
        order = np.argsort(at, kind="stable")
        at, bits = at[order], U(1) << (indices[order] & 63).astype(U)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = np.bitwise_or.reduceat(bits, first)
    return out.reshape(cols, words)


def leading(v: np.ndarray) -> int:
    """The highest bit of a packed vector; -1 for zero."""
    some = np.flatnonzero(v)
    return int(some[-1]) * 64 + int(v[some[-1]]).bit_length() - 1 if len(some) else -1


def leads_by_words(m: np.ndarray) -> np.ndarray:
    """Leading bits of an echelon form, highest first: from the highest bit down, one vector that has it is added to the others that do."""
    m, out = m.copy(), []
    for word in range(m.shape[1] - 1, -1, -1):
        # Vectors left have nothing above this word.
        m = m[m[:, : word + 1].any(1)][:, : word + 1] if len(m) else m
        while len(m):
            top = int(m[:, word].max()).bit_length() - 1
            if top < 0:
                break
            have = np.flatnonzero((m[:, word] >> U(top)) & U(1))
            m[have[1:]] ^= m[have[0]]
            m[have[0]] = m[-1]
            m = m[:-1]
            out.append(64 * word + top)
    return np.array(out, np.int64)


def leads_by_tables(m: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """The same, bits at a time: what a vector needs of the block's pivots is an index into a table of all their sums.

    The block's bits alone are eliminated first, which tells each vector's index; whole vectors are then changed once for
    each block, not once for each bit.
    """
    m, out = m.copy(), []
    for word in range(m.shape[1] - 1, -1, -1):
        m = m[m.any(1)][:, : word + 1] if len(m) else m[:, : word + 1]
        for low in range(64 - bits, -1, -bits):
            value = ((m[:, word] >> U(low)) & U((1 << bits) - 1)).astype(np.int64)
            index = np.zeros(len(m), np.int64)
            pivots: list[int] = []
            for b in range(bits - 1, -1, -1):
                have = np.flatnonzero(value >> b & 1)
                if not len(have):
                    continue
                p = int(have[0])
                out.append(64 * word + low + b)
                value[have[1:]] ^= value[p]
                index[have[1:]] |= 1 << len(pivots)
                value[p] = 0
                pivots.append(p)
            if not pivots:
                continue
            table = np.zeros((1, word + 1), U)
            for n, p in enumerate(pivots):
                whole = m[p] ^ table[index[p] & ((1 << n) - 1)]
                table = np.concatenate((table, table ^ whole))
            # A pivot's own bit stays with it: it is no vector any more.
            index[pivots] = 0
            used = np.flatnonzero(index)
            m[used] ^= table[index[used]]
            keep = np.ones(len(m), bool)
            keep[pivots] = False
            m = m[keep]
    return np.array(out, np.int64)


def words_rank(m: np.ndarray) -> int:
    return len(leads_by_words(m))


def tables_rank(m: np.ndarray) -> int:
    return len(leads_by_tables(m))


def peeled(col: np.ndarray, row: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rank so far, what is left) of a matrix by its distinct entries: what stands alone in its row or column is a pivot without fill.

    The pivot's other line goes with it. Rounds alternate until one takes off next to nothing.
    """
    rank = 0
    while len(col):
        before = len(col)
        for own in (0, 1):
            mine, other = (row, col) if own == 0 else (col, row)
            _, at, n = np.unique(mine, return_inverse=True, return_counts=True)
            lines = np.unique(other[n[at] == 1])
            if len(lines):
                # Two that stand alone in one line of the other side are one pivot: the line goes once.
                rank += len(lines)
                spot = np.searchsorted(lines, other)
                spot[spot == len(lines)] = 0
                keep = lines[spot] != other
                col, row = col[keep], row[keep]
        if before - len(col) <= before * LEAST_PART:
            break
    return rank, col, row


def distinct_entries(col: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (column, row) once, sorted."""
    order = np.lexsort((row, col))
    col, row = col[order], row[order]
    new = np.ones(len(col), bool)
    new[1:] = (col[1:] != col[:-1]) | (row[1:] != row[:-1])
    return col[new], row[new]


def sparse_rank(col: np.ndarray, row: np.ndarray) -> int:
    """Rank of a matrix by its entries, in any order, repeated ones counted once: peeled, then packed and eliminated by tables."""
    rank, col, row = peeled(*distinct_entries(np.asarray(col, np.int64), np.asarray(row, np.int64)))
    if not len(col):
        return rank
    (_, i), (_, j) = np.unique(col, return_inverse=True), np.unique(row, return_inverse=True)
    if j.max() > i.max():
        i, j = j, i
    # Vectors are the longer side: fewer bits, fewer tables.
    order = np.argsort(i, kind="stable")
    ptr = np.concatenate(([0], np.cumsum(np.bincount(i))))
    return rank + tables_rank(pack(ptr, j[order], int(j.max()) + 1))


def first_independent(indptr: np.ndarray, indices: np.ndarray, rows: int) -> np.ndarray:
    """The columns that are independent of those before them, ascending: prefix ranks are counts among them.

    The transposed matrix is eliminated with the columns' order turned over, so that the leading bit is the first column.
    """
    cols = len(indptr) - 1
    col = np.repeat(np.arange(cols), np.diff(indptr))
    order = np.argsort(indices, kind="stable")
    ptr = np.concatenate(([0], np.cumsum(np.bincount(indices, minlength=rows))))
    return cols - 1 - leads_by_tables(pack(ptr, cols - 1 - col[order], cols))


# --- many maps at once ---------------------------------------------------------------------------------------------

#: A map of so many columns and words at most goes into a stack; a larger one is worth calls of its own.
STACKED_COLS, STACKED_WORDS = 256, 4
#: Words of a stack, so that what is made from it stays in the processor's cache.
STACK = 1 << 15

#: A map as (indptr, indices, rows).
Map = tuple[np.ndarray, np.ndarray, int]


def stack(maps: list[Map], cols: int, words: int) -> np.ndarray:
    """Maps of so many columns and words at most as one array (map, column, word); repeated entries count once."""
    held = np.zeros((len(maps) * cols, words * 64), bool)
    size = [len(p) - 1 for p, _, _ in maps]
    column = np.concatenate([np.arange(n) for n in size]) + np.repeat(np.arange(len(maps)) * cols, size)
    held[np.repeat(column, np.concatenate([np.diff(p) for p, _, _ in maps])), np.concatenate([i for _, i, _ in maps])] = True
    return np.packbits(held, axis=1, bitorder="little").view("<u8").astype(U, copy=False).reshape(len(maps), cols, words)


def stacked_words_ranks(m: np.ndarray) -> np.ndarray:
    """Rank of each map of a stack, a bit at a time: in every map, the first vector that has it is added to all that do, itself too."""
    m, each, out = m.copy(), np.arange(len(m)), np.zeros(len(m), np.int64)
    for word in range(m.shape[2] - 1, -1, -1):
        for bit in range(63, -1, -1):
            have = m[:, :, word] & U(1 << bit) != 0
            first = have.argmax(1)
            some = have[each, first]
            if some.any():
                out += some
                m ^= m[each, first][:, None, :] * have[:, :, None]
    return out


def stacked_tables_ranks(m: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    """The same, bits at a time by a table of sums of pivots for each map; a bit that no vector of a map has adds zero to its table."""
    m, each, out = m.copy(), np.arange(len(m)), np.zeros(len(m), np.int64)
    for word in range(m.shape[2] - 1, -1, -1):
        for low in range(64 - bits, -1, -bits):
            value = (m[:, :, word] >> U(low)) & U((1 << bits) - 1)
            if not value.any():
                continue
            index = np.zeros(value.shape, np.int64)
            table = np.zeros((len(m), 1, m.shape[2]), U)
            for n, b in enumerate(range(bits - 1, -1, -1)):
                have = value & U(1 << b) != 0
                first = have.argmax(1)
                some = have[each, first]
                out += some
                whole = (m[each, first] ^ table[each, index[each, first]]) * some[:, None]
                table = np.concatenate((table, table ^ whole[:, None, :]), axis=1)
                # The pivot has its own sum in its index, which leaves nothing of it.
                value ^= value[each, first][:, None] * have
                index |= have.astype(np.int64) << n
            m ^= table[each[:, None], index]
    return out


def stacked_sparse_ranks(m: np.ndarray) -> np.ndarray:
    """The same: what stands alone in a row or column of its map is taken off in all maps together, the rest goes by tables."""
    maps, cols, words = m.shape
    bits = np.unpackbits(np.ascontiguousarray(m).astype("<u8", copy=False).view(np.uint8), bitorder="little")
    at = np.flatnonzero(bits)
    # Lines are numbered through all maps.
    col, row = at // (64 * words), at // (64 * words * cols) * (64 * words) + at % (64 * words)
    lines, out = (maps * cols, maps * 64 * words), np.zeros(maps, np.int64)
    while len(col):
        before = len(col)
        for own in (0, 1):
            mine, other = (row, col) if own == 0 else (col, row)
            gone = np.zeros(lines[own], bool)
            gone[other[np.bincount(mine, minlength=1)[mine] == 1]] = True
            out += gone.reshape(maps, -1).sum(1)
            keep = ~gone[other]
            col, row = col[keep], row[keep]
        if before - len(col) <= before * LEAST_PART:
            break
    if not len(col):
        return out
    left = np.unique(col // cols)
    rest = np.zeros((maps * cols, 64 * words), bool)
    rest[col, row % (64 * words)] = True
    rest = np.packbits(rest, axis=1, bitorder="little").view("<u8").astype(U, copy=False).reshape(m.shape)
    out[left] += stacked_tables_ranks(rest[left])
    return out


def ranks_of_many(maps: list[Map], stacked: Callable[[np.ndarray], np.ndarray], single: Callable[[np.ndarray, np.ndarray, int], int]) -> list[int]:
    """Ranks of maps of any sizes: those of like size in stacks, large ones each by itself, an empty one has 0."""
    out, like = [0] * len(maps), defaultdict(list)
    for i, (ptr, idx, rows) in enumerate(maps):
        cols, words = len(ptr) - 1, -(-rows // 64)
        if not len(idx):
            continue
        if cols > STACKED_COLS or words > STACKED_WORDS:
            out[i] = single(ptr, idx, rows)
        else:
            like[cols.bit_length(), words].append(i)
    for (_, words), who in like.items():
        who.sort(key=lambda i: len(maps[i][0]))
        step = max(1, STACK // (len(maps[who[-1]][0]) * words))
        for k in range(0, len(who), step):
            some = who[k : k + step]
            for i, rank in zip(some, stacked(stack([maps[i] for i in some], len(maps[some[-1]][0]) - 1, words)).tolist(), strict=True):
                out[i] = rank
    return out
