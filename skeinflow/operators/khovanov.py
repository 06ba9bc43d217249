"""Khovanov and Lee complexes as generator and boundary tables, their homology, and Rasmussen's s."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.once import once
from skeinflow.operators.algebra import PRIMES, d_squared, dense_rank, f2_pivots, homology, prefix_ranks, rank_by_primes
from skeinflow.operators.cube import cube_states, labels_of, state_histogram
from skeinflow.operators.diagrams import checked, seifert_structure


#: Crossings beyond which generators have no number: a state and its signs are one 64-bit key.
MOST_KERNEL = 20


def chain_dimensions(pds: DataFrame) -> DataFrame:
    """(diagram, i, j, dim) of the chain groups: binomials for each state, without listing generators."""
    s = cube_states(pds).select("diagram", F.bit_count("state").alias("ones"), F.size(F.array_distinct("labels")).alias("m"))
    s = s.groupBy("diagram", "ones", "m").agg(F.count("*").alias("n")).join(seifert_structure(pds), "diagram")
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m"))))
    binomial = F.round(F.expr("aggregate(sequence(1, greatest(k, 1)), 1.0D, (a, t) -> if(k = 0, 1.0D, a * (m - k + t) / t))")).cast("long")
    i = F.col("ones") - F.col("n_minus")
    j = 2 * F.col("k") - F.col("m") + F.col("ones") + F.col("n_plus") - 2 * F.col("n_minus")
    return s.groupBy("diagram", i.alias("i"), j.alias("j")).agg(F.sum(F.col("n") * binomial).alias("dim"))


def unreduced_size(pds: DataFrame) -> DataFrame:
    """(diagram, size): generators of the whole complex, two to the circles summed over states; no generator is made."""
    return state_histogram(pds).groupBy("diagram").agg(F.sum(F.col("n") * F.expr("shiftleft(1L, circles)")).alias("size"))


def euler_characteristic(pds: DataFrame) -> DataFrame:
    """(diagram, j, chi): the graded Euler characteristic of the chain groups, the unnormalised Jones polynomial."""
    sign = F.when(F.pmod("i", F.lit(2)) == 0, 1).otherwise(-1)
    return chain_dimensions(pds).groupBy("diagram", "j").agg(F.sum(sign * F.col("dim")).alias("chi")).where("chi <> 0")


def generators(pds: DataFrame) -> DataFrame:
    """(diagram, state, minus, i, j, labels, roots): minus is a mask over arcs, a bit at each least arc whose circle carries v-."""
    s = cube_states(pds).withColumn("roots", F.array_sort(F.array_distinct("labels"))).join(seifert_structure(pds).select("diagram", "n_plus", "n_minus"), "diagram")
    s = s.withColumn("pick", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, size(roots)) - 1"))))
    minus = F.expr("aggregate(sequence(0, size(roots) - 1), 0L, (a, k) -> a | if(pick & shiftleft(1L, k) <> 0, shiftleft(1L, element_at(roots, k + 1) - 1), 0L))")
    ones, m = F.bit_count("state"), F.size("roots")
    j = m - 2 * F.bit_count("pick") + ones + F.col("n_plus") - 2 * F.col("n_minus")
    return s.select("diagram", "state", minus.alias("minus"), (ones - F.col("n_minus")).alias("i"), j.alias("j"), "labels", "roots", F.size("labels").alias("arcs"))


def boundary(pds: DataFrame, lee: bool = False) -> DataFrame:
    """(diagram, i, j, state, minus, to_state, to_minus, v): the signed differential; j is the source's.

    Each 0 of a state becomes 1; the circles at that crossing merge or split, and the Frobenius algebra's product or
    coproduct says which signs follow. Lee's adds what sends v- v- to v+ and v- to v+ v+. The target's labels come by
    an equi-join of states, a row for each edge of the cube, before generators multiply.
    """
    g = generators(pds)
    states = cube_states(pds).select("diagram", F.col("state").alias("to_state"), F.col("labels").alias("to_labels"), F.array_sort(F.array_distinct("labels")).alias("to_roots"))
    e = g.withColumn("k", F.explode(F.expr("filter(sequence(0, cast(arcs / 2 as int) - 1), k -> state & shiftleft(1L, k) = 0)")))
    e = e.withColumn("to_state", F.expr("state | shiftleft(1L, k)")).join(states, ["diagram", "to_state"])
    e = e.withColumns({"gone": F.array_except("roots", "to_roots"), "new": F.array_except("to_roots", "roots")})
    sign = F.expr("1 - 2 * (bit_count(state & (shiftleft(1L, k) - 1)) % 2)")
    # Merge: a least arc vanishes into the one that its circle joins. Split: one appears out of the circle it was of.
    e = e.withColumn("s", sign)
    bit = lambda mask, arc: F.expr(f"{mask} & shiftleft(1L, {arc} - 1)") != 0
    without = lambda a, b: F.expr(f"minus & ~(shiftleft(1L, {a} - 1) | shiftleft(1L, {b} - 1))")
    plus_bit = lambda base, arc: base.bitwiseOR(F.expr(f"shiftleft(1L, {arc} - 1)"))
    merge = e.where("size(gone) = 1 and size(new) = 0").withColumn("b", F.get("gone", F.lit(0))).withColumn("a", F.expr("element_at(to_labels, b)"))
    x, y = bit("minus", "a"), bit("minus", "b")
    base = without("a", "b")
    out = F.when(~x & ~y, base).when(x != y, plus_bit(base, "a"))
    if lee:
        out = F.coalesce(out, base)
    merged = merge.withColumn("to_minus", out).where("to_minus is not null")
    split = e.where("size(new) = 1 and size(gone) = 0").withColumn("b", F.get("new", F.lit(0))).withColumn("a", F.expr("element_at(labels, b)"))
    base = without("a", "b")
    both = F.array(plus_bit(plus_bit(base, "a"), "b"))
    apart = F.array(plus_bit(base, "a"), plus_bit(base, "b"))
    parted = split.withColumn("to_minus", F.explode(F.when(bit("minus", "a"), F.concat(both, F.array(base)) if lee else both).otherwise(apart)))
    columns = ["diagram", "i", "j", "state", "minus", "to_state", "to_minus", F.col("s").alias("v")]
    return merged.select(*columns).union(parted.select(*columns))


def as_complex(pds: DataFrame, lee: bool = False) -> tuple[DataFrame, DataFrame]:
    """(gen, bd) over cx = struct(diagram, j), or the diagram alone for Lee's, positions by state and signs."""
    cx = F.struct("diagram") if lee else F.struct("diagram", "j")
    g = generators(pds).withColumn("cx", cx).select("cx", F.col("i").alias("deg"), "state", "minus", "j")
    at = F.row_number().over(Window.partitionBy("cx", "deg").orderBy("state", "minus")) - 1
    placed = g.withColumn("pos", at.cast("long"))
    d = boundary(pds, lee).withColumn("cx", cx).select("cx", F.col("i").alias("deg"), "state", "minus", "to_state", "to_minus", "v")
    d = d.groupBy("cx", "deg", "state", "minus", "to_state", "to_minus").agg(F.sum("v").alias("v")).where("v <> 0")
    src = placed.select("cx", "deg", "state", "minus", F.col("pos").alias("col"), F.col("j").alias("q_col"))
    dst = placed.select("cx", (F.col("deg") - 1).alias("deg"), F.col("state").alias("to_state"), F.col("minus").alias("to_minus"), F.col("pos").alias("row"), F.col("j").alias("q_row"))
    bd = d.join(src, ["cx", "deg", "state", "minus"]).join(dst, ["cx", "deg", "to_state", "to_minus"])
    return placed, bd.select("cx", "deg", "col", "row", "v", "q_col", "q_row")


def boundary_entries(pds: DataFrame) -> DataFrame:
    """(diagram, entries): how many entries the boundary has modulo 2. Equal codes are worked out once."""
    odd = lambda d: as_complex(d)[1].where("pmod(v, 2) = 1").groupBy("cx.diagram").agg(F.count("*").alias("entries"))
    return once(checked(pds.select("diagram", "pd")), ["pd"], odd)


def squares(pds: DataFrame, field: str = "f2", lee: bool = False) -> DataFrame:
    """(cx, deg, col, row, v), cx as JSON: the entries of the boundary's square that aren't zero; none for a complex. Equal codes are worked out once."""

    def of(d: DataFrame) -> DataFrame:
        bd = as_complex(d, lee)[1].select("cx", "deg", "col", "row", F.col("v").cast("long").alias("v"))
        return d_squared(bd, field).select("cx.diagram", *([] if lee else ["cx.j"]), "deg", "col", "row", "v")

    found = once(checked(pds.select("diagram", "pd")), ["pd"], of)
    return found.select(F.to_json(F.struct("diagram") if lee else F.struct("diagram", "j")).alias("cx"), "deg", "col", "row", "v")


def square_gaps(bd: DataFrame) -> DataFrame:
    """(cx) of complexes whose boundary's square has an entry, over the integers and so over every field.

    Each target two degrees up gets a random weight modulo a prime below 2^31; the weights' sums over all paths of two
    steps are zero for a complex. An entry is missed with a chance below 2^-30. Rows meet once, no pair of steps is made.
    """
    p, seed = PRIMES[0], int(np.random.default_rng().integers(1 << 62))
    rest = lambda x: F.pmod(x, F.lit(p))
    up = bd.groupBy("cx", (F.col("deg") - 1).alias("deg"), F.col("col").alias("row")).agg(rest(F.sum(F.col("v") * rest(F.xxhash64("row", F.lit(seed))))).alias("w"))
    sums = bd.join(up, ["cx", "deg", "row"]).groupBy("cx", "deg", "col").agg(rest(F.sum(F.col("v") * F.col("w"))).alias("s"))
    return sums.where("s <> 0").select("cx").distinct()


def khovanov_homology(pds: DataFrame, field: str = "f2", verify: bool = True) -> DataFrame:
    """(diagram, i, j, dim) over F2 ("f2") or the rationals ("q"); a diagram without crossings is the unknot. verify checks the boundary's square.

    Generators go by their state and signs in one number, so that a rank needs no places: dimensions come from binomials,
    the boundary from one join of states. The square is checked by random weights, see square_gaps(). Equal codes are
    worked out once.
    """
    return once(checked(pds.select("diagram", "pd")), ["pd"], lambda different: _khovanov_homology(different, field, verify))


def _khovanov_homology(pds: DataFrame, field: str, verify: bool) -> DataFrame:
    many = F.raise_error(F.lit(f"more than {MOST_KERNEL} crossings: a generator is no 64-bit number")).cast("array<array<int>>").cast(pds.schema["pd"].dataType)
    some = pds.where(F.size("pd") > 0).withColumn("pd", F.when(F.size("pd") > MOST_KERNEL, many).otherwise(F.col("pd")))
    cx = F.to_json(F.struct("diagram", "j")).alias("cx")
    gen = chain_dimensions(some).select(cx, F.col("i").alias("deg"), "dim")
    number = lambda state, minus: F.shiftleft(state, 2 * MOST_KERNEL).bitwiseOR(F.col(minus))
    bd = boundary(some).select(cx, F.col("i").alias("deg"), number("state", "minus").alias("col"), number("to_state", "to_minus").alias("row"), F.col("v").cast("long").alias("v"))
    if verify:
        bad = square_gaps(bd).withColumn("bad", F.lit(True))
        wrong = F.raise_error(F.concat(F.lit("the boundary's square is not zero: "), "cx")).cast("long")
        gen = gen.join(bad, "cx", "left").select("cx", "deg", F.when(F.col("bad"), wrong).otherwise(F.col("dim")).alias("dim"))
    h = homology(gen, bd, "q_modular" if field == "q" else field, False)
    c = F.from_json("cx", "diagram string, j int")
    trivial = pds.where(F.size("pd") == 0).select("diagram", F.lit(0).alias("i"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("j"), F.lit(1).cast("long").alias("dim"))
    return h.select(c["diagram"].alias("diagram"), F.col("deg").alias("i"), c["j"].alias("j"), F.col("betti").alias("dim")).union(trivial)


def lee_homology(pds: DataFrame) -> DataFrame:
    """(diagram, i, dim): a knot has dimension 2 in degree 0 and nothing else. Equal codes are worked out once."""
    return once(checked(pds.select("diagram", "pd")), ["pd"], _lee_homology)


def _lee_homology(pds: DataFrame) -> DataFrame:
    placed, bd = as_complex(pds, lee=True)
    gen = placed.groupBy("cx", "deg").agg(F.count("*").alias("dim"))
    h = homology(gen.withColumn("cx", F.to_json("cx")), bd.withColumn("cx", F.to_json("cx")), "q_modular", False)
    return h.select(F.from_json("cx", "diagram string")["diagram"].alias("diagram"), F.col("deg").alias("i"), F.col("betti").alias("dim"))


def s_of(dim: list[tuple[int, int]], out: list[tuple], into: list[tuple]) -> int:
    """From q-degrees of the generators in degree 0 (pos, q) and the entries (col, row, v, q_col, q_row) out of and into it.

    The part of homology that is represented in filtration q >= k has dimension: cycles there, less boundaries there.
    """
    def rank(entries) -> int:
        cols: dict[int, dict[int, int]] = {}
        for c, r, v in entries:
            cols.setdefault(c, {})[r] = v
        return rank_by_primes(list(cols.values()))

    all_in = rank((c, r, v) for c, r, v, _, _ in into)
    dims = {}
    for k in sorted({q for _, q in dim}):
        cycles = sum(q >= k for _, q in dim) - rank((c, r, v) for c, r, v, q, _ in out if q >= k)
        dims[k] = cycles - (all_in - rank((c, r, v) for c, r, v, _, q in into if q < k))
    two, one = max(k for k, n in dims.items() if n >= 2), max(k for k, n in dims.items() if n >= 1)
    if one != two + 2:
        raise ArithmeticError("the filtration's levels are not two apart: not a knot")
    return two + 1


def rasmussen_s(pds: DataFrame) -> DataFrame:
    """(diagram, s): from the filtered Lee complex near degree 0; 0 for a diagram without crossings. Equal codes are worked out once."""
    return once(checked(pds.select("diagram", "pd")), ["pd"], _rasmussen_s)


def _rasmussen_s(pds: DataFrame) -> DataFrame:
    placed, bd = as_complex(pds.where(F.size("pd") > 0), lee=True)
    gens = placed.where("deg = 0").select("cx.diagram", F.lit("g").alias("kind"), F.col("pos").alias("col"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("v"), F.col("j").alias("q_col"), F.lit(0).alias("q_row"))
    edges = bd.where("deg in (0, -1)").select("cx.diagram", F.when(F.col("deg") == 0, "o").otherwise("i").alias("kind"), "col", "row", F.col("v").cast("long"), "q_col", "q_row")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {k: [tuple(map(int, r)) for r in part[["col", "row", "v", "q_col", "q_row"]].to_numpy(np.int64)] for k, part in pdf.groupby("kind")}
        return pd.DataFrame({"diagram": [key[0]], "s": [s_of([(r[0], r[3]) for r in rows["g"]], rows.get("o", []), rows.get("i", []))]})

    s = gens.union(edges).groupBy("diagram").applyInPandas(one, "diagram string, s int")
    return s.union(pds.where(F.size("pd") == 0).select("diagram", F.lit(0)))


# --- the batch kernel: a diagram's whole complex in one worker, for many small diagrams -----------------------------


def complex_of(code: list[list[int]], lee: bool = False, degrees: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j) of all generators, and edges (source, target, sign), as arrays; with degrees only of these (first, last).

    A generator is its state and a mask over arcs, as in generators(), in the order of both; one pass over all generators
    for each crossing.
    """
    d = np.array(code)
    d = d - d.min()
    c, n2 = len(d), 2 * len(d)
    if c > MOST_KERNEL:
        raise ValueError(f"{c} crossings; at most {MOST_KERNEL} fit a kernel's keys")
    w = int(np.where(d[:, 3] == (d[:, 1] + 1) % n2, 1, -1).sum())
    plus, minus = (c + w) // 2, (c - w) // 2
    labels = labels_of(d).astype(np.int64)
    root = labels == np.arange(n2)
    ones = np.bitwise_count(np.arange(1 << c, dtype=np.uint64)).astype(np.int64)
    circles = root.sum(1)
    states = np.arange(1 << c)
    if degrees:
        states = states[(ones - minus >= degrees[0]) & (ones - minus <= degrees[1])]
    n = 1 << circles[states]
    state = np.repeat(states, n)
    pick = np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n)
    before = np.cumsum(root, 1) - root
    mask = np.zeros(len(state), np.int64)
    for arc in range(n2):
        mask |= (((pick >> before[state, arc]) & 1) * root[state, arc]) << arc
    key = state << n2 | mask
    i = ones[state] - minus
    j = circles[state] - 2 * np.bitwise_count(pick.astype(np.uint64)).astype(np.int64) + ones[state] + plus - 2 * minus
    sources, targets, signs = [], [], []
    for k, (a, b, x, _) in enumerate(d):
        src = np.flatnonzero((state >> k & 1 == 0) & (i < degrees[1] if degrees else True))
        s, m = state[src], mask[src]
        t = s | 1 << k
        sign = 1 - 2 * (np.bitwise_count((s & ((1 << k) - 1)).astype(np.uint64)).astype(np.int64) % 2)
        p, q = labels[s, a], labels[s, b]
        # Two circles merge into the one of the lesser arc; of one that splits, one keeps it.
        merge = p != q
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        y, z = labels[t, a], labels[t, x]
        lo, hi = np.where(merge, lo, np.minimum(y, z)), np.where(merge, hi, np.maximum(y, z))
        low, high = np.left_shift(1, lo), np.left_shift(1, hi)
        base, one, two = m & ~(low | high), m & low != 0, m & high != 0
        parts = [(merge & ~(one & two), base | np.where(one | two, low, 0)), (~merge & one, base | low | high), (~merge & ~one, base | low), (~merge & ~one, base | high)]
        if lee:
            parts += [(merge & one & two, base), (~merge & one, base)]
        for live, out in parts:
            sources.append(src[live])
            targets.append(np.searchsorted(key, t[live] << n2 | out[live]))
            signs.append(sign[live])
    return i, j, np.stack([np.concatenate(e) for e in (sources, targets, signs)])


def check_square(src: np.ndarray, dst: np.ndarray, sign: np.ndarray, n: int) -> None:
    """Raise unless the signed paths of two edges between any two of n generators cancel.

    Over the integers and so over every field: a random weight for each target makes the sum over paths a number for
    each source, modulo a prime below 2**31; one that isn't zero tells of an entry, and a nonzero entry is missed with a
    chance below 2**-30.
    """
    weight = np.random.default_rng().integers(1, PRIMES[0], n)
    for _ in range(2):
        # The boundary's transpose, twice.
        term = sign * weight[dst]
        weight = np.zeros(n, np.int64)
        np.add.at(weight, src, term)
        weight %= PRIMES[0]
    if weight.any():
        raise ArithmeticError("the boundary's square is not zero: not a complex")


def khovanov_of(code: list[list[int]], field: str = "f2", verify: bool = True) -> dict[tuple[int, int], int]:
    """{(i, j): dimension}: every quantum grading by itself, F2 by bit masks, Q by what F2 leaves open and the largest rank modulo three primes.

    verify checks the boundary's square first.
    """
    if not code:
        return {(0, 1): 1, (0, -1): 1}
    i, j, (src, dst, sign) = complex_of(code)
    if verify:
        check_square(src, dst, sign, len(i))
    key = i * 4096 + j
    o = np.argsort(key, kind="stable")
    cells, start, count = np.unique(key[o], return_index=True, return_counts=True)
    place = np.empty(len(key), np.int64)
    place[o] = np.arange(len(key)) - np.repeat(start, count)
    size = dict(zip(cells.tolist(), count.tolist(), strict=True))
    e = np.argsort(key[src], kind="stable")
    src, dst, sign = src[e], dst[e], sign[e]
    edge_cells, cut = np.unique(key[src], return_index=True)
    entries = {cell: slice(lo, hi) for cell, lo, hi in zip(edge_cells.tolist(), cut.tolist(), [*cut[1:].tolist(), len(src)], strict=True)}
    ranks, pivots = dict.fromkeys(size, 0), {}
    for cell, at in sorted(entries.items()):
        columns = [0] * size[cell]
        for u, v in zip(place[src[at]].tolist(), place[dst[at]].tolist(), strict=True):
            columns[u] ^= 1 << v
        # The square is zero: generators that pivots of the boundary before stand at add nothing to this rank.
        gone = pivots.get(cell - 4096, ())
        pivots[cell] = f2_pivots((u, x) for u, x in enumerate(columns) if u not in gone)
        ranks[cell] = len(pivots[cell])
    left = {cell: n - ranks[cell] - ranks.get(cell - 4096, 0) for cell, n in size.items()}
    if field != "f2":
        more = {}
        for cell, at in entries.items():
            # A rank over Q is that over F2 at least, and exceeds it by what is left on both sides at most. Pivots over F2
            # are independent over Q too, so that generators of those on either side add nothing here either.
            if most := min(left[cell], left.get(cell + 4096, 0)):
                m = np.zeros((size[cell], size[cell + 4096]), np.int64)
                np.add.at(m, (place[src[at]], place[dst[at]]), sign[at])
                m = np.delete(m, list(pivots.get(cell - 4096, ())), 0)
                m = np.delete(m, list(pivots.get(cell + 4096, {}).values()), 1)
                for p in PRIMES:
                    more[cell] = max(more.get(cell, 0), dense_rank(m, p) - ranks[cell])
                    if more[cell] == most:
                        break
        for cell, n in more.items():
            left[cell] -= n
            left[cell + 4096] -= n
    out = {}
    for cell, n in left.items():
        if n:
            degree = (cell + 2048) // 4096
            out[degree, cell - 4096 * degree] = n
    return out


def rasmussen_of(code: list[list[int]]) -> int:
    """s of a knot from Lee's complex between degrees -1 and 1: one elimination in the filtration's order on each side has the ranks of all levels."""
    if not code:
        return 0
    i, j, (src, dst, sign) = complex_of(code, lee=True, degrees=(-1, 1))
    at = {d: np.flatnonzero(i == d)[np.argsort(j[i == d], kind="stable")] for d in (-1, 0, 1)}
    place = np.empty(len(i), np.int64)
    for rows in at.values():
        place[rows] = np.arange(len(rows))
    q, n = j[at[0]], len(at[0])
    out, into = np.zeros((n, len(at[1])), np.int64), np.zeros((n, len(at[-1])), np.int64)
    leaves = i[src] == 0
    # Sources from the highest level down; targets from the lowest up.
    np.add.at(out, (n - 1 - place[src[leaves]], place[dst[leaves]]), sign[leaves])
    np.add.at(into, (place[dst[~leaves]], place[src[~leaves]]), sign[~leaves])
    above, under = (np.max([prefix_ranks(m, p) for p in PRIMES], axis=0) for m in (out, into))
    dims = {}
    for k in np.unique(q).tolist():
        below = int((q < k).sum())
        dims[k] = n - below - int(above[n - below]) - int(under[n] - under[below])
    levels = [max((k for k, x in dims.items() if x >= least), default=None) for least in (1, 2)]
    if None in levels or levels[0] != levels[1] + 2:
        raise ArithmeticError("the filtration's levels are not two apart: not a knot")
    return levels[1] + 1


def rasmussen_batch(pds: DataFrame) -> DataFrame:
    """(diagram, s), as rasmussen_s(), a diagram in one task: for many diagrams of a dozen crossings or fewer. Equal codes are worked out once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = [rasmussen_of([list(map(int, x)) for x in code]) for code in batch["pd"]]
            yield pd.DataFrame({"diagram": batch["diagram"], "s": np.array(s, np.int32)})

    return once(pds, ["pd"], lambda d: d.mapInPandas(work, d.select("diagram", F.lit(0).alias("s")).schema))


def khovanov_batch(pds: DataFrame, field: str = "f2", verify: bool = True) -> DataFrame:
    """(diagram, i, j, dim), as khovanov_homology(), a diagram in one task: for many diagrams of a dozen crossings or fewer. Equal codes are worked out once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *c, n) for d, code in zip(batch["diagram"], batch["pd"], strict=True) for c, n in khovanov_of([list(map(int, x)) for x in code], field, verify).items()]
            yield pd.DataFrame(rows, columns=["diagram", "i", "j", "dim"])

    return once(pds, ["pd"], lambda d: d.mapInPandas(work, d.select("diagram", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).cast("long").alias("dim")).schema))
