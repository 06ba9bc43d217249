"""Graded F2 complexes as compressed sparse columns: boundary maps in binary slices that cross a shuffle as they are.

A complex is gen(cx, deg, dim), dim at least 1, and entries (cx, deg, col, row): the map from deg to deg + 1. In compressed
form a row is a slice of a map: (cx, deg, first, cols, rows, indptr, indices), cols columns from first on, indptr
cols + 1 and indices little-endian integers of four bytes; rows is the dimension above. Every degree of a complex has
slices, without entries too, so that an empty map has a shape.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.algebra import f2_rank, f2_rank_sets
from skeinflow.operators.packed import Map, pack, ranks_of_many, sparse_rank, stacked_sparse_ranks, stacked_tables_ranks, stacked_words_ranks, tables_rank, words_rank

#: Columns of a slice at most; dimensions of four bytes.
SLICE, MOST = 1 << 12, (1 << 31) - 1
#: Entries and columns of the small maps that are worked on together; complexes of simplices that are made together.
PORTION, SPANNED = 1 << 20, 1 << 11
INDEX, FIELDS = "<i4", ("cx", "deg", "first", "cols", "rows", "indptr", "indices")


def packed_columns(columns: DataFrame) -> DataFrame:
    """(cx, deg, cols, indptr, indices) of (cx, deg, columns array<array<bigint>>): one after another, neither sorted nor made distinct."""
    size = F.transform("columns", lambda c: F.size(c))
    ends = F.transform(F.sequence(F.lit(0), F.size("columns")), lambda i: F.aggregate(F.slice(size, 1, i), F.lit(0), lambda a, x: a + x))
    return columns.select("cx", "deg", F.size("columns").alias("cols"), ends.alias("indptr"), F.flatten("columns").alias("indices"))


def dimension(dim: Column) -> Column:
    """A dimension as long; one below 1 or beyond four bytes raises."""
    dim = dim.cast("long")
    return F.when((dim < 1) | (dim > MOST), F.raise_error(F.concat(F.lit("a dimension is at least 1 and below 2**31: "), dim.cast("string")))).otherwise(dim)


def from_entries(gen: DataFrame, entries: DataFrame) -> DataFrame:
    """The compressed form of entries (cx, deg, col, row); repeated ones count once.

    An entry beyond the dimensions, or a dimension below 1 or beyond four bytes, raises. A column stands whole in a slice,
    and a slice is one row: of SLICE columns at most, however large the map.
    """
    size = gen.select("cx", F.col("deg").cast("int").alias("deg"), dimension(F.col("dim")).alias("dim"))
    above = size.select("cx", (F.col("deg") - 1).alias("deg"), F.col("dim").alias("rows"))
    slices = size.join(above, ["cx", "deg"], "left").select("cx", "deg", "dim", F.coalesce("rows", F.lit(0)).alias("rows"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("dim") - 1, F.lit(SLICE).cast("long"))).alias("first"))
    e = entries.select("cx", F.col("deg").cast("int").alias("deg"), F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"))
    e = e.withColumn("first", F.floor(F.col("col") / SLICE) * SLICE)
    both = slices.select("cx", "deg", "first", F.least(F.lit(SLICE), F.col("dim") - F.col("first")).alias("cols"), "rows").join(e, ["cx", "deg", "first"], "full")
    beyond = F.col("cols").isNull() | ((F.col("col") < F.col("first")) | (F.col("col") >= F.col("first") + F.col("cols")) | (F.col("row") < 0) | (F.col("row") >= F.col("rows")))
    both = both.withColumn("col", F.when(F.coalesce(beyond, F.lit(False)), F.raise_error(F.concat_ws(" ", F.lit("an entry is beyond the generators: degree"), "deg", F.lit("column"), "col", F.lit("row"), "row"))).otherwise(F.col("col") - F.col("first")))

    cells = F.collect_set(F.when(F.col("col").isNotNull(), F.struct("col", "row")))
    sliced = both.groupBy("cx", "deg", "first", "cols", "rows").agg(F.sort_array(cells).alias("cells"))
    sliced = sliced.select("cx", "deg", "first", "cols", "rows", F.transform("cells", lambda c: c["col"]).alias("indptr"), F.transform("cells", lambda c: c["row"]).alias("indices"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape = [batch.column(c) for c in ("cx", "deg", "first", "cols", "rows")]
            size = np.cumsum(batch.column("indices").value_lengths().to_numpy())[:-1]
            col, row = (np.split(batch.column(c).flatten().to_numpy(), size) for c in ("indptr", "indices"))
            ptr = [np.concatenate(([0], np.cumsum(np.bincount(c, minlength=n)))).astype(INDEX).tobytes() for c, n in zip(col, shape[3].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*shape, pa.array(ptr, pa.binary()), pa.array([r.astype(INDEX).tobytes() for r in row], pa.binary())], [*FIELDS])

    empty = F.lit(None).cast("binary")
    return sliced.mapInArrow(make, sliced.withColumns({"indptr": empty, "indices": empty}).schema)


def binaries(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Integers as binary values of so many each, one after another."""
    ends = np.concatenate(([0], np.cumsum(size * 4)))
    if ends[-1] > MOST:
        raise ValueError("a batch of slices is beyond 2**31 bytes")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(INDEX))])


def from_simplices(sets: DataFrame) -> DataFrame:
    """The compressed cochain complexes modulo 2, up to triangles, of (cx, sets array<int>): what sets of vertices span, as bit masks.

    Simplices of each degree are numbered by their vertices in order. Vertices are at most 31, and a complex is made whole in
    one task: each of its maps is one slice, and no entry is shuffled. A null cx equals none, as in joins, so that its maps
    go nowhere.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SPANNED):
                yield from _spanned(batch.slice(k, SPANNED))

    zero, empty = F.lit(0).cast("long"), F.lit(None).cast("binary")
    some = sets.where(F.exists("sets", lambda v: v != 0))
    return some.mapInArrow(make, sets.select("cx", F.lit(0).alias("deg"), *(zero.alias(c) for c in ("first", "cols", "rows")), empty.alias("indptr"), empty.alias("indices")).schema)


def _spanned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The slices of each degree of a batch of complexes."""
    sets, cx = batch.column("sets"), batch.column("cx")
    masks, known = sets.flatten().to_numpy(), cx.is_valid().to_numpy(zero_copy_only=False)
    begin = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))[:-1]
    vertices = [1 << i for i in range(31) if np.bitwise_or.reduce(masks) >> i & 1]
    faces = [np.array([sum(c) for c in combinations(vertices, d + 1)], masks.dtype) for d in range(3)]
    there = [np.logical_or.reduceat((masks[:, None] & f) == f, begin, axis=0) for f in faces]
    dims = [t.sum(1) for t in there] + [np.zeros(batch.num_rows, np.int64)]
    for deg in range(3):
        ends, above, hit = np.zeros((batch.num_rows, len(faces[deg]) + 1), np.int64), np.zeros(0, np.int64), np.zeros((batch.num_rows, 0), bool)
        if deg < 2:
            # Pairs of a face and what it is a face of, in the order of the face; ends are the pairs of each face and those before.
            below, above = np.nonzero((faces[deg][:, None] & faces[deg + 1]) == faces[deg][:, None])
            hit = there[deg + 1][:, above] & known[:, None]
            counts = np.concatenate((ends[:, :1], np.cumsum(hit, axis=1)), axis=1)
            ends = counts[:, np.searchsorted(below, np.arange(len(faces[deg]) + 1))]
            above = (np.cumsum(there[deg + 1], axis=1) - 1)[:, above][hit]
        have = dims[deg] > 0
        if not have.any():
            continue
        # A face that is not there has no pairs.
        shown = np.concatenate((have[:, None], there[deg]), axis=1)
        n = int(have.sum())
        numbers = [np.full(n, deg, np.int32), np.zeros(n, np.int64), dims[deg][have], (dims[deg + 1] * known)[have]]
        yield pa.RecordBatch.from_arrays([cx.filter(pa.array(have)), *map(pa.array, numbers), binaries(ends[shown], dims[deg][have] + 1), binaries(above, hit.sum(1)[have])], [*FIELDS])


def odd_entries(bd: DataFrame) -> DataFrame:
    """Entries of a boundary table with values, modulo 2: repeated ones are added."""
    return bd.groupBy("cx", "deg", "col", "row").agg(F.sum("v").alias("v")).where("pmod(v, 2) = 1").drop("v")


def verdict_of(indptr: np.ndarray, indices: np.ndarray, cols: int, rows: int) -> str | None:
    """Null, or what is wrong with a slice."""
    if len(indptr) != cols + 1:
        return f"indptr has {len(indptr)} values for {cols} columns"
    if indptr[0] != 0:
        return "indptr does not start at 0"
    if (np.diff(indptr) < 0).any():
        return "indptr falls"
    if indptr[-1] != len(indices):
        return "indptr does not end at the number of entries"
    if len(indices) and (indices.min() < 0 or indices.max() >= rows):
        return "a row is beyond the dimension above"
    return None


def _verdicts(batch: pa.RecordBatch) -> pa.Array:
    out = []
    for indptr, indices, cols, rows in zip(*(batch.column(c).to_pylist() for c in ("indptr", "indices", "cols", "rows")), strict=True):
        whole = indptr is not None and indices is not None and len(indptr) % 4 == len(indices) % 4 == 0
        out.append(verdict_of(np.frombuffer(indptr, INDEX), np.frombuffer(indices, INDEX), cols, rows) if whole else "not integers of four bytes")
    return pa.array(out, pa.string())


def verdicts(csc: DataFrame) -> DataFrame:
    """(cx, deg, first, verdict) of slices from anywhere: null where indptr and indices fit the shape."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cx", "deg", "first")), _verdicts(batch)], ["cx", "deg", "first", "verdict"])

    return csc.mapInArrow(look, csc.select("cx", "deg", "first", F.lit(None).cast("string").alias("verdict")).schema)


def map_shapes(csc: DataFrame) -> DataFrame:
    """(cx, deg, cols, rows, entries, verdict) of each map: slices are looked at where they are, only their counts are shuffled."""
    kept = ["cx", "deg", "cols", "rows", "bytes"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _verdicts(batch)], [*kept, "verdict"])

    c = csc.withColumn("bytes", F.octet_length("indices").cast("long"))
    looked = c.mapInArrow(look, c.select(*kept, F.lit(None).cast("string").alias("verdict")).schema)
    return looked.groupBy("cx", "deg").agg(F.sum("cols").alias("cols"), F.max("rows").alias("rows"), (F.sum("bytes") / 4).cast("long").alias("entries"), F.min("verdict").alias("verdict"))


def nnz(csc: DataFrame) -> DataFrame:
    """(cx, deg, entries): by the bytes alone, no map is read."""
    return csc.groupBy("cx", "deg").agg(F.sum(F.octet_length("indices") / 4).cast("long").alias("entries"))


def differential(csc: DataFrame) -> DataFrame:
    """(cx, deg, col, row): the entries of the maps."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ptr, idx = ([np.frombuffer(x, INDEX) for x in batch.column(c).to_pylist()] for c in ("indptr", "indices"))
            which = np.repeat(np.arange(batch.num_rows), [len(x) for x in idx])
            if len(which):
                col = np.concatenate([f + np.repeat(np.arange(len(p) - 1, dtype=np.int64), np.diff(p)) for f, p in zip(batch.column("first").to_pylist(), ptr, strict=True)])
                same = [batch.column(c).take(pa.array(which)) for c in ("cx", "deg")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(col), pa.array(np.concatenate(idx).astype(np.int64))], ["cx", "deg", "col", "row"])

    return csc.mapInArrow(spread, csc.select("cx", "deg", F.lit(0).cast("long").alias("col"), F.lit(0).cast("long").alias("row")).schema)


# --- ranks by tier -------------------------------------------------------------------------------------------------


def _columns(indptr: np.ndarray, indices: np.ndarray) -> list[list[int]]:
    return [indices[a:b].tolist() for a, b in zip(indptr[:-1], indptr[1:], strict=True)]


def _mask(rows: list[int]) -> int:
    out = 0
    for r in rows:
        out |= 1 << r
    return out


#: By name: the rank of a map (indptr, indices, rows), and what it is. All give the same.
TIERS: dict[str, tuple[Callable[[np.ndarray, np.ndarray, int], int] | None, str]] = {
    "sets": (lambda p, i, n: f2_rank_sets(_columns(p, i)), "sets of rows, the plain form"),
    "bits": (lambda p, i, n: f2_rank(map(_mask, _columns(p, i))), "a big integer for each column"),
    "words": (lambda p, i, n: words_rank(pack(p, i, n)), "packed words, one bit at a time"),
    "tables": (lambda p, i, n: tables_rank(pack(p, i, n)), "packed words, eight bits at a time by tables of combinations"),
    "sparse": (lambda p, i, n: sparse_rank(np.repeat(np.arange(len(p) - 1), np.diff(p)), i), "lone entries taken off, the rest by tables"),
    "compiled": (None, "needs numba"),
}
#: What does best on sparse and dense maps alike.
BEST = "sparse"


def available_tiers() -> list[tuple[str, bool, str]]:
    """(tier, whether it can run here, note)."""
    return [(name, kernel is not None, note + ("" if kernel or importlib.util.find_spec("numba") is None else ", which is here; no kernel is built on it")) for name, (kernel, note) in TIERS.items()]


def kernel_of(tier: str) -> Callable[[np.ndarray, np.ndarray, int], int]:
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; there are {', '.join(TIERS)}")
    kernel, note = TIERS[tier]
    if kernel is None:
        raise RuntimeError(f"the tier {tier!r} is not available: {note}")
    return kernel


#: Tiers that work on stacks of small maps.
STACKED = {"words": stacked_words_ranks, "tables": stacked_tables_ranks, "sparse": stacked_sparse_ranks}


def many_of(tier: str) -> Callable[[list[Map]], list[int]]:
    """The ranks of many maps by a tier: small maps of like size take the same steps together, where the tier has such a form."""
    kernel, stacked = kernel_of(tier), STACKED.get(tier)
    return (lambda maps: ranks_of_many(maps, stacked, kernel)) if stacked else lambda maps: [kernel(*m) if len(m[1]) else 0 for m in maps]


def _portions(maps: Iterable[Map]) -> Iterator[list[Map]]:
    held, size = [], 0
    for m in maps:
        held.append(m)
        size += len(m[0]) + len(m[1])
        if size > PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _map_of(indptr: list, indices: list, rows: int) -> Map:
    """A map by its slices in order."""
    if len(indptr) == 1:
        return np.frombuffer(indptr[0].as_buffer(), INDEX), np.frombuffer(indices[0].as_buffer(), INDEX), rows
    ptr, idx, total = [np.zeros(1, np.int64)], [], 0
    for p, x in zip(indptr, indices, strict=True):
        p = np.frombuffer(p.as_buffer(), INDEX).astype(np.int64)
        ptr.append(p[1:] + total)
        total += int(p[-1])
        idx.append(np.frombuffer(x.as_buffer(), INDEX))
    return np.concatenate(ptr), np.concatenate(idx), rows


def _sized_ranks(csc: DataFrame, tier: str, sliced: bool) -> DataFrame:
    """(cx, deg, cols, rank) of each map."""
    many = many_of(tier)
    if sliced:
        slices = F.array_sort(F.collect_list(F.struct("first", "indptr", "indices", "rows")))
        maps = csc.groupBy("cx", "deg").agg(F.sum("cols").alias("cols"), slices.alias("s")).select("cx", "deg", "cols", F.get("s.rows", 0).alias("rows"), "s.indptr", "s.indices")
    else:
        more = F.raise_error(F.lit("a map has more than one slice"))
        maps = csc.select("cx", "deg", "cols", F.when(F.col("first") != 0, more).otherwise(F.col("rows")).alias("rows"), F.array("indptr").alias("indptr"), F.array("indices").alias("indices"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = (_map_of(*m) for m in zip(*(batch.column(c) for c in ("indptr", "indices")), batch.column("rows").to_pylist(), strict=True))
            out = [r for portion in _portions(each) for r in many(portion)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cx", "deg", "cols")), pa.array(out, pa.int64())], ["cx", "deg", "cols", "rank"])

    return maps.mapInArrow(work, csc.select("cx", "deg", F.lit(0).cast("long").alias("cols"), F.lit(0).cast("long").alias("rank")).schema)


def ranks(csc: DataFrame, tier: str = BEST, sliced: bool = True) -> DataFrame:
    """(cx, deg, rank) of each map, its slices put together in one task; a map without entries has rank 0.

    Unless maps are sliced, each one's only slice is worked on where it is, and a second one raises.
    """
    return _sized_ranks(csc, tier, sliced).select("cx", "deg", "rank")


def homology(csc: DataFrame, tier: str = BEST, sliced: bool = True) -> DataFrame:
    """(cx, deg, betti), zeros dropped, of compressed maps alone, each read once; a negative dimension raises."""
    lost = F.array(F.struct("deg", (F.col("cols") - F.col("rank")).alias("n")), F.struct((F.col("deg") + 1).alias("deg"), (-F.col("rank")).alias("n")))
    both = _sized_ranks(csc, tier, sliced).select("cx", F.explode(lost).alias("x")).select("cx", "x.*")
    out = both.groupBy("cx", "deg").agg(F.sum("n").alias("betti"))
    return out.withColumn("betti", F.when(F.col("betti") < 0, F.raise_error(F.lit("a negative dimension: not a complex"))).otherwise(F.col("betti"))).where("betti <> 0")


def tier_ranks(csc: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """(cx, deg, a column of ranks for each tier), every map read once: the comparison of kernels."""
    kernels = {t: many_of(t) for t in tiers}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(batch.column("first").to_pylist()) or SLICE in batch.column("cols").to_pylist():
                raise ValueError("maps of one slice are compared")
            maps = ((np.frombuffer(p.as_buffer(), INDEX), np.frombuffer(x.as_buffer(), INDEX), n) for p, x, n in zip(batch.column("indptr"), batch.column("indices"), batch.column("rows").to_pylist(), strict=True))
            out: dict[str, list[int]] = {t: [] for t in kernels}
            for portion in _portions(maps):
                for t, many in kernels.items():
                    out[t] += many(portion)
            yield pa.RecordBatch.from_arrays([batch.column("cx"), batch.column("deg"), *(pa.array(v, pa.int64()) for v in out.values())], ["cx", "deg", *out])

    return csc.mapInArrow(each, csc.select("cx", "deg", *(F.lit(0).cast("long").alias(t) for t in tiers)).schema)


def timed_tiers(csc: DataFrame, tiers: tuple[str, ...], repeat: int = 3) -> DataFrame:
    """(cx, deg, tier, rank, seconds): the best of some runs of each kernel on each map, where the map is."""
    import time

    kernels = {t: kernel_of(t) for t in tiers}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for m in batch.itertuples():
                p, x = np.frombuffer(m.indptr, INDEX), np.frombuffer(m.indices, INDEX)
                for t, kernel in kernels.items():
                    best, rank = float("inf"), 0
                    for _ in range(repeat):
                        began = time.perf_counter()
                        rank = kernel(p, x, m.rows)
                        best = min(best, time.perf_counter() - began)
                    rows.append((m.cx, m.deg, t, rank, best))
            yield pd.DataFrame(rows, columns=["cx", "deg", "tier", "rank", "seconds"])

    return csc.mapInPandas(run, csc.select("cx", "deg", F.lit("").alias("tier"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("seconds")).schema)
