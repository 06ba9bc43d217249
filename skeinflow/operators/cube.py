"""The cube of resolutions: states as bit masks, circles by label folding, bracket and Jones polynomial."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.diagrams import checked, crossing_signs, from_one, merged_labels

#: Crossings beyond which a diagram's states are not enumerated; states that are dealt out together.
MOST_CROSSINGS, SPAN = 24, 4096


def cube_states(pds: DataFrame) -> DataFrame:
    """(diagram, state, labels): a row for each of 2^c resolutions; labels[a - 1] is the least arc of a's circle.

    Bit k of state is crossing k: 0 joins (b, c), (d, a); 1 joins (a, b), (c, d). States are dealt out in spans before the
    fold. A code that is no knot's raises, and so do more than MOST_CROSSINGS crossings.
    """
    many = F.raise_error(F.concat_ws(" ", F.lit("diagram"), F.col("diagram").cast("string"), F.lit("has"), F.size("pd").cast("string"), F.lit(f"crossings; at most {MOST_CROSSINGS} are enumerated"))).cast("long")
    d = checked(pds.select("diagram", "pd")).withColumn("all", F.when(F.size("pd") > MOST_CROSSINGS, many).otherwise(F.expr("shiftleft(1L, size(pd))")))
    spans = d.select("diagram", "pd", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(SPAN).cast("long"))).alias("first")).repartition("diagram", "first")
    states = spans.select("diagram", "pd", F.explode(F.sequence("first", F.least(F.col("first") + SPAN, F.col("all")) - 1)).alias("state"))

    def pairs(c, k):
        one = F.expr("state").bitwiseAND(F.pow(F.lit(2), k).cast("long")) != 0
        pair = lambda x, y: F.struct(F.get(c, x).alias("x"), F.get(c, y).alias("y"))
        return F.when(one, F.array(pair(0, 1), pair(2, 3))).otherwise(F.array(pair(1, 2), pair(3, 0)))

    return states.select("diagram", "state", merged_labels(2 * F.size("pd"), F.flatten(F.transform("pd", pairs))).alias("labels"))


def state_histogram(pds: DataFrame) -> DataFrame:
    """(diagram, ones, circles, n): all that the bracket needs, at most c^2 rows for each diagram."""
    s = cube_states(pds)
    return s.groupBy("diagram", F.bit_count("state").alias("ones"), F.size(F.array_distinct("labels")).alias("circles")).agg(F.count("*").alias("n"))


def kauffman_bracket(pds: DataFrame) -> DataFrame:
    """(diagram, exp, coef): sum over states of A^(c - 2 ones) (-A^2 - A^-2)^(circles - 1), powers in closed form."""
    h = state_histogram(pds).join(pds.select("diagram", F.size("pd").alias("c")), "diagram")
    m = F.col("circles") - 1
    h = h.select("diagram", "n", m.alias("m"), (F.col("c") - 2 * F.col("ones")).alias("e"), F.explode(F.sequence(F.lit(0), m)).alias("k"))
    binomial = F.round(F.expr("aggregate(sequence(1, greatest(k, 1)), 1.0D, (a, t) -> if(k = 0, 1.0D, a * (m - k + t) / t))")).cast("long")
    term = h.select("diagram", (F.col("e") + 2 * F.col("m") - 4 * F.col("k")).alias("exp"), (F.when(F.col("m") % 2 == 0, 1).otherwise(-1) * F.col("n") * binomial).alias("c"))
    return term.groupBy("diagram", "exp").agg(F.sum("c").alias("coef")).where("coef <> 0")


def jones_polynomial(pds: DataFrame) -> DataFrame:
    """(diagram, exp, coef): V(t) = (-A^3)^(-writhe) bracket at A = t^(1/4), with the sign convention of tables; zeros dropped."""
    writhe = pds.select("diagram", F.aggregate(crossing_signs(from_one(F.col("pd"))), F.lit(0), lambda a, x: a + x).alias("w"))
    b = kauffman_bracket(pds).join(writhe, "diagram")
    four = F.col("exp") - 3 * F.col("w")
    whole = F.when(F.pmod(four, F.lit(4)) != 0, F.raise_error(F.lit("an exponent is no multiple of four: not a knot"))).otherwise((four / 4).cast("int"))
    return b.select("diagram", whole.alias("exp"), (F.when(F.pmod(F.col("w"), F.lit(2)) == 0, 1).otherwise(-1) * F.col("coef")).alias("coef"))


def canonical(poly: DataFrame) -> DataFrame:
    """(diagram, low, coeffs): dense coefficients from the lowest exponent."""
    g = poly.where("coef <> 0").groupBy("diagram").agg(F.min("exp").alias("low"), F.max("exp").alias("high"), F.map_from_entries(F.collect_list(F.struct("exp", "coef"))).alias("m"))
    return g.select("diagram", "low", F.transform(F.sequence("low", "high"), lambda e: F.coalesce(F.try_element_at("m", e), F.lit(0).cast("long"))).alias("coeffs"))


# --- the batch kernel ----------------------------------------------------------------------------------------------


def labels_of(pd_code: np.ndarray) -> np.ndarray:
    """Least arcs (from 0) of all arcs' circles in all 2^c states: states double crossing by crossing, each half joined its own way."""
    c = len(pd_code)
    labels = np.arange(2 * c, dtype=np.int8 if c < 60 else np.int16)[None]
    for a, b, x, d in pd_code - pd_code.min():
        halves = []
        for pairs in (((b, x), (d, a)), ((a, b), (x, d))):
            half = labels.copy()
            for p, q in pairs:
                u, v = half[:, p].copy(), half[:, q].copy()
                lo, hi = np.minimum(u, v), np.maximum(u, v)
                half = np.where(half == hi[:, None], lo[:, None], half)
            halves.append(half)
        labels = np.concatenate(halves)
    return labels


def circles_of(pd_code: np.ndarray) -> np.ndarray:
    """Circles of all states; each is counted at its least arc."""
    labels = labels_of(pd_code)
    return (labels == np.arange(labels.shape[1], dtype=labels.dtype)).sum(1)


_PLANS: dict[tuple, dict[int, int]] = {}


def jones_of(pd_code: list[list[int]], remember: bool = True) -> dict[int, int]:
    """{exponent: coefficient}; the same code is worked out once by a worker that remembers."""
    if not pd_code:
        return {0: 1}
    code = tuple(map(tuple, pd_code))
    if remember and code in _PLANS:
        return _PLANS[code]
    p = np.array(pd_code)
    c, n2 = len(p), 2 * len(p)
    if c > MOST_CROSSINGS:
        raise ValueError(f"{c} crossings; at most {MOST_CROSSINGS} are enumerated")
    p = p - p.min() + 1
    w = int(np.where(p[:, 3] == p[:, 1] % n2 + 1, 1, -1).sum())
    circles = circles_of(p)
    ones = np.bitwise_count(np.arange(len(circles), dtype=np.uint64))
    table = np.bincount(ones.astype(np.int64) * (n2 + 1) + circles, minlength=(c + 1) * (n2 + 1)).reshape(c + 1, n2 + 1)
    out: dict[int, int] = {}
    for b, k in zip(*np.nonzero(table), strict=True):
        m = int(k) - 1
        for i in range(m + 1):
            e = c - 2 * int(b) + 2 * m - 4 * i - 3 * w
            out[e // 4] = out.get(e // 4, 0) + (-1) ** ((m + w) % 2) * int(table[b, k]) * comb(m, i)
    out = {e: v for e, v in sorted(out.items()) if v}
    if remember and len(_PLANS) < 4096:
        _PLANS[code] = out
    return out


def jones_batch(pds: DataFrame, remember: bool = True) -> DataFrame:
    """(diagram, exp, coef) by the kernel: no state leaves the worker, nothing is shuffled."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(d, e, v) for d, code in zip(batch["diagram"], batch["pd"], strict=True) for e, v in jones_of([list(map(int, x)) for x in code], remember).items()]
            yield pd.DataFrame(got, columns=["diagram", "exp", "coef"])

    return pds.select("diagram", "pd").mapInPandas(work, pds.select("diagram", F.lit(0).alias("exp"), F.lit(0).cast("long").alias("coef")).schema)
