"""Grid diagrams: states as permutations, gradings, differentials, and knot Floer homology."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.once import once, tasks
from skeinflow.operators.packed import first_independent, leads_by_tables, pack, sparse_rank
from skeinflow.sources.derived import checkpoint_dir

#: Rows beyond which n! states are refused.
MOST_ROWS = 10


def grid_verdict(n: Column, o: Column, x: Column) -> Column:
    """Null where o and x are permutations of 0 ... n - 1 that never share a cell."""
    full = F.sequence(F.lit(0), n - 1)
    return F.when(n.isNull() | o.isNull() | x.isNull() | (n < 1), "no markers").when((F.array_sort(o) != full) | (F.array_sort(x) != full), "not permutations").when(F.exists(F.arrays_zip(o.alias("o"), x.alias("x")), lambda c: c["o"] == c["x"]), "two markers in one cell")


def from_markers(markers: DataFrame) -> DataFrame:
    """(diagram, n, o, x) of (diagram, r, c) cells, 1-based, two in each row and column: colours alternate along the knot.

    The knot is traced cell by cell, one diagram in a task; rows are turned over, which undoes the mirror.
    """
    def trace(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [(int(r) - 1, int(c) - 1) for r, c in zip(pdf["r"], pdf["c"], strict=True)]
        n = len(cells) // 2
        rows, cols = {}, {}
        for i, (r, c) in enumerate(cells):
            rows.setdefault(r, []).append(i)
            cols.setdefault(c, []).append(i)
        if set(rows) != set(range(n)) or set(cols) != set(range(n)) or any(len(v) != 2 for v in [*rows.values(), *cols.values()]):
            raise ValueError(f"{key[0]}: two markers in each row and column are needed")
        at, seen, o, x = 0, 0, [0] * n, [0] * n
        while True:
            o[n - 1 - cells[at][0]] = cells[at][1]
            mate = next(i for i in rows[cells[at][0]] if i != at)
            x[n - 1 - cells[mate][0]] = cells[mate][1]
            at = next(i for i in cols[cells[mate][1]] if i != mate)
            seen += 2
            if at == 0:
                break
        if seen != 2 * n:
            raise ValueError(f"{key[0]}: more than one component")
        return pd.DataFrame({"diagram": [key[0]], "n": [n], "o": [o], "x": [x]})

    return markers.groupBy("diagram").applyInPandas(trace, "diagram string, n int, o array<int>, x array<int>")


# --- kernels over blocks of states ---------------------------------------------------------------------------------


def unranked(ranks: np.ndarray, n: int) -> np.ndarray:
    """Permutations by lexicographic rank, a row for each."""
    out = np.empty((len(ranks), n), np.int64)
    pool = np.tile(np.arange(n), (len(ranks), 1))
    rest = ranks.astype(np.int64).copy()
    for i in range(n):
        digit, rest = np.divmod(rest, factorial(n - 1 - i))
        out[:, i] = pool[np.arange(len(ranks)), digit]
        keep = np.arange(n - i)[None] != digit[:, None]
        pool = pool[keep].reshape(len(ranks), n - i - 1)
    return out


def ranked(states: np.ndarray) -> np.ndarray:
    n = states.shape[1]
    out = np.zeros(len(states), np.int64)
    for i in range(n):
        out += (states[:, i + 1 :] < states[:, i : i + 1]).sum(1) * factorial(n - 1 - i)
    return out


def states_of(ranks: DataFrame) -> DataFrame:
    """(diagram, n, rank) with state array<int>, the permutation of that rank; a rank outside 0 ... n! - 1 raises."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            for n, part in batch.reset_index(drop=True).groupby("n"):
                r = part["rank"].to_numpy()
                if len(r) and (r.min() < 0 or r.max() >= factorial(int(n))):
                    raise ValueError(f"a rank is outside 0 ... {n}! - 1")
                out[part.index] = list(unranked(r, int(n)))
            yield batch.assign(state=out.to_numpy())

    return ranks.select("diagram", "n", "rank").mapInPandas(work, ranks.select("diagram", "n", "rank", F.array().cast("array<int>").alias("state")).schema)


def ranks_of(states: DataFrame) -> DataFrame:
    """(diagram, n, state) with rank; what is no permutation of 0 ... n - 1 raises."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for n, part in batch.reset_index(drop=True).groupby("n"):
                s = np.array([np.asarray(x) for x in part["state"]]).reshape(len(part), -1)
                if s.shape[1] != n or (np.sort(s, 1) != np.arange(n)).any():
                    raise ValueError("a state is no permutation")
                out[part.index] = ranked(s)
            yield batch.assign(rank=out)

    return states.select("diagram", "n", "state").mapInPandas(work, states.select("diagram", "n", "state", F.lit(0).cast("long").alias("rank")).schema)


def gradings(states: np.ndarray, o: list[int], x: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(Maslov, Alexander) of each state, in doubled integer coordinates: markers stand half a cell up and right of lattice points."""
    n = states.shape[1]
    rows = np.arange(n)

    def maslov(markers: list[int]) -> np.ndarray:
        m = np.array(markers)
        own = sum((states[:, i : i + 1] < states[:, i + 1 :]).sum(1) for i in range(n))
        up = sum((states[:, i : i + 1] <= m[rows >= i][None]).sum(1) for i in range(n))
        down = sum((m[i] < states[:, rows > i]).sum(1) for i in range(n))
        fixed = sum(int(m[i] < m[j]) for i in range(n) for j in range(i + 1, n))
        return own - up - down + fixed + 1

    mo = maslov(o)
    return mo, (mo - maslov(x) - (n - 1)) // 2


def rectangles(states: np.ndarray, avoid: list[list[int]]) -> list[tuple[int, int, np.ndarray]]:
    """(i, j, mask): rows i < j whose swap survives modulo 2, as exactly one of their two rectangles on the torus is empty."""
    n = states.shape[1]
    out = []
    for i in range(n):
        for j in range(i + 1, n):
            out.append((i, j, _empty(states, i, j, avoid) ^ _empty(states, j, i, avoid)))
    return out


def _empty(states: np.ndarray, lo: int, hi: int, avoid: list[list[int]]) -> np.ndarray:
    """Whether the rectangle from (lo, its column) up and right to (hi, its column), around the torus, holds no state point inside and no marker to avoid."""
    n = states.shape[1]
    width = (states[:, hi] - states[:, lo]) % n
    ok = np.ones(len(states), bool)
    height = (hi - lo) % n
    for k in range(height):
        r = (lo + k) % n
        if k:
            inside = (states[:, r] - states[:, lo]) % n
            ok &= ~((inside > 0) & (inside < width))
        for markers in avoid:
            ok &= (markers[r] - states[:, lo]) % n >= width
    return ok


def checked_grids(grids: DataFrame) -> DataFrame:
    """(diagram, n, o, x); what is no grid, or too large, raises."""
    wrong = F.coalesce(grid_verdict(F.col("n"), F.col("o"), F.col("x")), F.when(F.col("n") > MOST_ROWS, F.concat(F.lit("too many states: n = "), F.col("n").cast("string"))))
    n = F.when(wrong.isNull(), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("grid "), F.coalesce(F.col("diagram").cast("string"), F.lit("null")), F.lit(": "), wrong)).cast("int"))
    return grids.select("diagram", n.alias("n"), "o", "x")


def _once(grids: DataFrame, f) -> DataFrame:
    return once(checked_grids(grids), ["n", "o", "x"], f)


def _blocks(grids: DataFrame, parts: int = 64) -> DataFrame:
    """Ranks 0 ... n! - 1 of each grid, in spans that are dealt out by number; what is no grid, or too large, raises."""
    g = checked_grids(grids).withColumn("all", F.factorial("n"))
    step = F.greatest(F.lit(512).cast("long"), F.ceil(F.col("all") / parts))
    return g.select("diagram", "n", "o", "x", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, step)).alias("first"), step.alias("step")).repartition(tasks(grids), "diagram", "first")


def grid_states(grids: DataFrame, targets: str | None = None) -> DataFrame:
    """(diagram, rank, m, a) of all states; with targets "hat" (neither marker in a rectangle) or "filtered" (no O), also targets array<bigint>."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                n, o, x = int(g.n), [int(v) for v in g.o], [int(v) for v in g.x]
                r = np.arange(g.first, min(g.all, g.first + g.step))
                s = unranked(r, n)
                m, a = gradings(s, o, x)
                out = pd.DataFrame({"diagram": g.diagram, "rank": r, "m": m.astype(np.int32), "a": a.astype(np.int32)})
                if targets:
                    lists: list[list[int]] = [[] for _ in r]
                    for i, j, hit in rectangles(s, [o, x] if targets == "hat" else [o]):
                        t = s[hit]
                        t[:, [i, j]] = t[:, [j, i]]
                        for k, v in zip(np.flatnonzero(hit).tolist(), ranked(t).tolist(), strict=True):
                            lists[k].append(v)
                    out["targets"] = lists
                yield out

    schema = "diagram string, rank long, m int, a int" + (", targets array<bigint>" if targets else "")
    return _blocks(grids).mapInPandas(work, schema)


def grid_maps(grids: DataFrame, kind: str) -> DataFrame:
    """(diagram, m, a, n, ranks, indptr, targets): of each span the states of each grading, by rank, and their differentials as compressed columns.

    Integers of four bytes; targets are ranks. A row for a span and grading crosses the shuffle, not one for a state.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                n, o, x = int(g.n), [int(v) for v in g.o], [int(v) for v in g.x]
                r = np.arange(g.first, min(g.all, g.first + g.step))
                s = unranked(r, n)
                m, a = gradings(s, o, x)
                hits = []
                for i, j, hit in rectangles(s, [o, x] if kind == "hat" else [o]):
                    t = s[hit]
                    t[:, [i, j]] = t[:, [j, i]]
                    hits.append((np.flatnonzero(hit), ranked(t)))
                col, row = (np.concatenate(h) for h in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
                # Columns by grading, entries by column.
                order = np.lexsort((np.arange(len(r)), m, a))
                place = np.empty(len(r), np.int64)
                place[order] = np.arange(len(r))
                by = np.argsort(place[col], kind="stable")
                ptr = np.concatenate(([0], np.cumsum(np.bincount(place[col], minlength=len(r)))))
                row, m, a, r = row[by].astype("<i4"), m[order], a[order], r[order].astype("<i4")
                cut = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (a[1:] != a[:-1])))
                rows = [(g.diagram, int(m[lo]), int(a[lo]), hi - lo, r[lo:hi].tobytes(), (ptr[lo : hi + 1] - ptr[lo]).astype("<i4").tobytes(), row[ptr[lo] : ptr[hi]].tobytes()) for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(r)], strict=True)]
                yield pd.DataFrame(rows, columns=["diagram", "m", "a", "n", "ranks", "indptr", "targets"])

    blocks = _blocks(grids)
    empty = F.lit(None).cast("binary")
    schema = blocks.select("diagram", F.lit(0).alias("m"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("n"), empty.alias("ranks"), empty.alias("indptr"), empty.alias("targets")).schema
    return blocks.mapInPandas(work, schema)


def _columns(indptr: pa.ListScalar, targets: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(indptr, targets) of a map out of those of its spans."""
    ptr, total = [np.zeros(1, np.int64)], 0
    for p in indptr:
        p = np.frombuffer(p.as_buffer(), "<i4").astype(np.int64)
        ptr.append(p[1:] + total)
        total += int(p[-1])
    return np.concatenate(ptr), np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in targets]).astype(np.int64)


def grading_histogram(grids: DataFrame) -> DataFrame:
    """(diagram, m, a, n): partial sums where states are made. Equal grids are worked out once."""
    return _once(grids, lambda g: grid_states(g).groupBy("diagram", "m", "a").agg(F.count("*").alias("n")))


def alexander_euler(grids: DataFrame) -> DataFrame:
    """(diagram, a, chi): (1 - t)^(n - 1) times the Alexander polynomial; zeros dropped."""
    sign = F.when(F.pmod("m", F.lit(2)) == 0, 1).otherwise(-1)
    return grading_histogram(grids).groupBy("diagram", "a").agg(F.sum(sign * F.col("n")).alias("chi")).where("chi <> 0")


def grid_boundary(grids: DataFrame, kind: str = "hat") -> DataFrame:
    """(diagram, m, a, rank, target, m_to, a_to): M falls by one; A stays ("hat") or may fall ("filtered"). Equal grids are worked out once."""
    return _once(grids, lambda g: _grid_boundary(g, kind))


def _grid_boundary(grids: DataFrame, kind: str) -> DataFrame:
    s = grid_states(grids, kind)
    e = s.select("diagram", "m", "a", "rank", F.explode("targets").alias("target"))
    t = grid_states(grids).select("diagram", F.col("rank").alias("target"), F.col("m").alias("m_to"), F.col("a").alias("a_to"))
    return e.join(t, ["diagram", "target"])


def grid_poincare(grids: DataFrame) -> DataFrame:
    """(diagram, m, a, dim): homology of the hat differential. It keeps A and lowers M by one, so that each grading has one map out and one in.

    A task has one grading's map as compressed columns; targets need no places of their own to count a rank. Equal grids
    are worked out once.
    """
    return _once(grids, _grid_poincare)


def _grid_poincare(grids: DataFrame) -> DataFrame:
    spans = F.array_sort(F.collect_list(F.struct("ranks", "indptr", "targets")))
    maps = grid_maps(grids, "hat").groupBy("diagram", "m", "a").agg(F.sum("n").alias("n"), spans.alias("s")).select("diagram", "m", "a", "n", "s.indptr", "s.targets")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ptr, targets = _columns(batch.column("indptr")[i], batch.column("targets")[i])
                out.append(sparse_rank(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), targets))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("diagram", "m", "a", "n")), pa.array(out, pa.int64())], ["diagram", "m", "a", "n", "rank"])

    r = maps.mapInArrow(reduce, maps.select("diagram", "m", "a", "n", F.lit(0).cast("long").alias("rank")).schema)
    each = F.explode(F.array(F.struct(F.col("m").alias("m"), (F.col("n") - F.col("rank")).alias("d")), F.struct((F.col("m") - 1).alias("m"), (-F.col("rank")).alias("d"))))
    out = r.select("diagram", "a", each.alias("x")).groupBy("diagram", F.col("x.m").alias("m"), "a").agg(F.sum("x.d").alias("dim")).where("dim <> 0")
    return out.withColumn("dim", F.when(F.col("dim") > 0, F.col("dim")).otherwise(F.raise_error(F.lit("a negative dimension: not a complex")).cast("long"))).select("diagram", "m", "a", "dim")


def divided(poincare: DataFrame, grids: DataFrame) -> DataFrame:
    """(diagram, m, a, rank): divided by (1 + q^-1 t^-1)^(n - 1): alternating binomial sums along diagonals m - a."""
    p = poincare.join(grids.select("diagram", "n"), "diagram").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * MOST_ROWS))))
    table = F.array(*(F.array(*(F.lit(comb(max(n - 2 + k, 0), k) * (-1) ** k if n > 1 else int(k == 0)).cast("long") for k in range(2 * MOST_ROWS + 1))) for n in range(MOST_ROWS + 1)))
    q = p.select("diagram", (F.col("m") - F.col("k")).alias("m"), (F.col("a") - F.col("k")).alias("a"), (F.col("dim") * F.get(F.get(table, F.col("n")), F.col("k"))).alias("v"))
    return q.groupBy("diagram", "m", "a").agg(F.sum("v").alias("rank")).where("rank <> 0")


def tensored(hfk: DataFrame, grids: DataFrame) -> DataFrame:
    """(diagram, m, a, dim): multiplied by (1 + q^-1 t^-1)^(n - 1)."""
    h = hfk.join(grids.select("diagram", "n"), "diagram").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    table = F.array(*(F.array(*(F.lit(comb(max(n - 1, 0), k)).cast("long") for k in range(MOST_ROWS + 1))) for n in range(MOST_ROWS + 1)))
    t = h.select("diagram", (F.col("m") - F.col("k")).alias("m"), (F.col("a") - F.col("k")).alias("a"), (F.col("rank") * F.get(F.get(table, F.col("n")), F.col("k"))).alias("v"))
    return t.groupBy("diagram", "m", "a").agg(F.sum("v").alias("dim")).where("dim <> 0")


def hfk_hat(grids: DataFrame) -> DataFrame:
    """(diagram, m, a, rank), all positive. The quotient is a polynomial, so it ends where the Poincare polynomial does, n - 1 steps up.

    It is multiplied back and compared with the Poincare polynomial: a remainder raises.
    """
    checkpoint_dir(grids.sparkSession)
    p = grid_poincare(grids).checkpoint()
    low = p.groupBy("diagram").agg(F.min("m").alias("low_m"), F.min("a").alias("low_a")).join(grids.select("diagram", "n"), "diagram")
    q = divided(p, grids).join(low, "diagram").where("m >= low_m + n - 1 and a >= low_a + n - 1").select("diagram", "m", "a", "rank")
    q = q.withColumn("rank", F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.raise_error(F.lit("a negative rank"))))
    both = p.union(tensored(q, grids).select("diagram", "m", "a", -F.col("dim"))).groupBy("diagram", "m", "a").agg(F.sum("dim").alias("left"))
    rest = both.where("left <> 0").select("diagram").distinct().withColumn("rest", F.lit(True))
    # Full: a diagram whose quotient is cut to nothing has no row of it, but has a remainder.
    q = q.join(rest, "diagram", "full")
    return q.select("diagram", "m", "a", F.when(F.col("rest"), F.raise_error(F.lit("the division leaves a remainder"))).otherwise(F.col("rank")).alias("rank"))


def seifert_genus(grids: DataFrame) -> DataFrame:
    return hfk_hat(grids).groupBy("diagram").agg(F.max("a").alias("genus"))


def tau(grids: DataFrame) -> DataFrame:
    """(diagram, tau): the least A at which the filtered complex has a cycle in degree 0 that is no boundary.

    Two maps, each in a task of its own: out of degree 0, with its states by (A, rank), the columns independent of those
    before them tell the cycles of every level at once; into it, an echelon form's leading rows tell the boundaries. Equal
    grids are worked out once.
    """
    return _once(grids, _tau)


def _tau(grids: DataFrame) -> DataFrame:
    checkpoint_dir(grids.sparkSession)
    s = grid_maps(grids, "filtered").where("m in (0, 1)").checkpoint()
    spans = F.array_sort(F.collect_list(F.struct("m", "a", "ranks", "indptr", "targets")))
    whole = s.where("m = 0").select("*", F.explode(F.array(F.lit("out"), F.lit("into"))).alias("kind")).union(s.where("m = 1").withColumn("kind", F.lit("into")))
    maps = whole.groupBy("diagram", "kind").agg(spans.alias("s")).select("diagram", "kind", *(F.col(f"s.{c}").alias(c) for c in ("m", "a", "ranks", "indptr", "targets")))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                m, a = (batch.column(c)[i].values.to_numpy() for c in ("m", "a"))
                ranks = [np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) for x in batch.column("ranks")[i]]
                zero = np.flatnonzero(m == 0)
                state = np.concatenate([ranks[k] for k in zero])
                of = np.repeat(a[zero], [len(ranks[k]) for k in zero])
                order = np.lexsort((state, of))
                parts = zero if batch.column("kind")[i].as_py() == "out" else np.flatnonzero(m == 1)
                ptr, targets = _columns(*(pa.scalar([batch.column(c)[i][int(k)].as_py() for k in parts], pa.list_(pa.binary())) for c in ("indptr", "targets"))) if len(parts) else (np.zeros(1, np.int64), np.zeros(0, np.int64))
                if batch.column("kind")[i].as_py() == "out":
                    # Columns by (A, rank).
                    size = np.diff(ptr)[order]
                    take = np.repeat(ptr[:-1][order] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    _, row = np.unique(targets[take], return_inverse=True)
                    some = first_independent(np.concatenate(([0], np.cumsum(size))), row, int(row.max()) + 1 if len(row) else 0)
                else:
                    by_rank = np.argsort(state[order])
                    row = by_rank[np.searchsorted(state[order], targets, sorter=by_rank)] if len(targets) else targets
                    some = leads_by_tables(pack(ptr, row, len(state)))
                levels, n = np.unique(of, return_counts=True)
                ends = np.cumsum(n)
                below = np.searchsorted(np.sort(some), ends)
                k = len(levels)
                yield pa.RecordBatch.from_arrays([batch.column("diagram").take(pa.array([i] * k)), batch.column("kind").take(pa.array([i] * k)), pa.array(levels.astype(np.int32)), pa.array(ends), pa.array(below)], ["diagram", "kind", "a", "states", "pivots"])

    found = maps.mapInArrow(level, maps.select("diagram", "kind", F.lit(0).alias("a"), F.lit(0).cast("long").alias("states"), F.lit(0).cast("long").alias("pivots")).schema)
    pivots = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("pivots")))
    levels = found.groupBy("diagram", "a").agg((F.max("states") - pivots("out") - pivots("into")).alias("new"))
    out = levels.groupBy("diagram").agg(F.min(F.when(F.col("new") > 0, F.col("a"))).alias("tau"), F.max_by("new", "a").alias("last"))
    wrong = F.raise_error(F.concat(F.col("diagram").cast("string"), F.lit(": homology in degree 0 is not of dimension one"))).cast("int")
    return out.select("diagram", F.when(F.col("last") == 1, F.col("tau")).otherwise(wrong).alias("tau"))
