"""Second algorithms for invariants, which share no step with the first: what a result is cross-checked with.

The bracket by a frontier of open arcs, crossing by crossing, with no list of states; Alexander's polynomial by the reduced
Burau representation at some numbers; the signature by eigenvalues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.once import once
from skeinflow.operators.classical import seifert_of

#: Numbers that two polynomials are compared at, up to a unit.
POINTS = (2, 3, 5)


def _times_circle(poly: dict[int, int]) -> dict[int, int]:
    """By -A^2 - A^-2."""
    out: dict[int, int] = {}
    for e, c in poly.items():
        for k in (2, -2):
            out[e + k] = out.get(e + k, 0) - c
    return out


def _by_circle(poly: dict[int, int]) -> dict[int, int]:
    """The quotient by -A^2 - A^-2; a remainder raises."""
    left, out = {e: c for e, c in poly.items() if c}, {}
    while left:
        e = max(left)
        c = -left[e]
        out[e - 2] = c
        for k in (2, -2):
            left[e - 2 + k] = left.get(e - 2 + k, 0) + c
            if not left[e - 2 + k]:
                del left[e - 2 + k]
        if e - 2 < min(poly) - 2:
            raise ArithmeticError("the sum over states is no multiple of a circle")
    return out


def bracket_by_frontier(code: list[list[int]]) -> dict[int, int]:
    """{exponent of A: coefficient}, one circle counting one: a sum over the ways that open arcs are joined so far.

    Crossings are taken in an order that keeps few arcs open; the work grows with the ways to join those, not with 2^c.
    """
    if not code:
        return {0: 1}
    left, open_, sums = [tuple(map(int, c)) for c in code], set(), {(): {0: 1}}
    while left:
        crossing = max(left, key=lambda c: sum(x in open_ for x in c))
        left.remove(crossing)
        a, b, c, d = crossing
        after: dict[tuple, dict[int, int]] = {}
        for joined, poly in sums.items():
            for pairs, shift in ((((b, c), (d, a)), 1), (((a, b), (c, d)), -1)):
                mate, now = dict(joined), poly
                for p, q in pairs:
                    if p == q or mate.get(p) == q:
                        # A circle closes: both ends of one arc, or of one path.
                        mate.pop(p, None), mate.pop(q, None)
                        now = _times_circle(now)
                        continue
                    x, y = mate.pop(p, p), mate.pop(q, q)
                    mate[x], mate[y] = y, x
                key = tuple(sorted(mate.items()))
                into = after.setdefault(key, {})
                for e, v in now.items():
                    into[e + shift] = into.get(e + shift, 0) + v
        sums = after
        for x in crossing:
            open_ ^= {x}
    if set(sums) != {()}:
        raise ValueError("an arc does not end twice")
    return _by_circle(sums[()])


def jones_by_frontier(code: list[list[int]]) -> dict[int, int]:
    """{exponent: coefficient} of the Jones polynomial, of a knot's code with any number of crossings."""
    if not code:
        return {0: 1}
    d = np.array(code)
    d = d - d.min()
    w = int(np.where(d[:, 3] == (d[:, 1] + 1) % (2 * len(d)), 1, -1).sum())
    out = {}
    for e, c in bracket_by_frontier(code).items():
        if (e - 3 * w) % 4:
            raise ValueError("an exponent is no multiple of four: not a knot")
        if c:
            out[(e - 3 * w) // 4] = (-1) ** (w % 2) * c
    return dict(sorted(out.items()))


def _value(coeffs: list[int], t: int) -> Fraction:
    return sum((Fraction(c) * t**i for i, c in enumerate(coeffs)), Fraction(0))


def _determinant(m: list[list[Fraction]]) -> Fraction:
    m, out = [row[:] for row in m], Fraction(1)
    for c in range(len(m)):
        p = next((r for r in range(c, len(m)) if m[r][c]), None)
        if p is None:
            return Fraction(0)
        if p != c:
            m[c], m[p], out = m[p], m[c], -out
        out *= m[c][c]
        for r in range(c + 1, len(m)):
            if f := m[r][c] / m[c][c]:
                m[r] = [x - f * y for x, y in zip(m[r], m[c], strict=True)]
    return out


def burau_value(braid: list[int], t: int) -> Fraction:
    """det(1 - B(t)) of the reduced Burau matrix: (1 + t + ... + t^(n - 1)) times Alexander's polynomial, up to a unit."""
    n = max(map(abs, braid))
    one = lambda i, j: Fraction(int(i == j))
    b = [[one(i, j) for j in range(n)] for i in range(n)]
    for x in braid:
        i = abs(x) - 1
        left, own, right = (Fraction(t), Fraction(-t), Fraction(1)) if x > 0 else (Fraction(1), Fraction(-1, t), Fraction(1, t))
        # By a matrix that differs from one in row i: columns beside i get a part of column i.
        for row in b:
            v = row[i]
            if i:
                row[i - 1] += v * left
            if i + 1 < n:
                row[i + 1] += v * right
            row[i] = v * own
    return _determinant([[one(i, j) - b[i][j] for j in range(n)] for i in range(n)])


def _power(x: Fraction, t: int) -> int | None:
    """k where x = t^k."""
    k = 0
    while x.denominator > 1 and k > -10_000:
        x, k = x * t, k - 1
    while x > 1 and x.denominator == 1 and x.numerator % t == 0:
        x, k = x / t, k + 1
    return k if x == 1 else None


def alexander_agrees(braid: list[int], coeffs: list[int]) -> bool | None:
    """Whether coeffs are the closure's Alexander polynomial up to a unit, at some numbers; None for a braid that leaves out a strand."""
    n = max(map(abs, braid)) + 1
    if set(map(abs, braid)) != set(range(1, n)):
        return None
    seen = set()
    for t in POINTS:
        want, got = burau_value(braid, t), _value(coeffs, t) * sum(t**i for i in range(n))
        if not want or not got:
            seen.add("zero" if not want and not got else "not")
        else:
            k = _power(abs(want / got), t)
            seen.add((k, want / got > 0) if k is not None else "not")
    return len(seen) == 1 and "not" not in seen


def signature_by_eigenvalues(braid: list[int]) -> int:
    """Signs of the eigenvalues of V + V^T in floating point; those next to zero count for nothing."""
    form = seifert_of(braid)
    v = np.array(form, float).reshape(len(form), len(form))
    values = np.linalg.eigvalsh(v + v.T) if form else np.zeros(0)
    return int((values > 1e-7).sum() - (values < -1e-7).sum())


def per_object(rows: DataFrame, column: str, f: Callable, kind: str) -> DataFrame:
    """(diagram, second) with f of each object, as JSON text of kind: no shuffle. An object that f can't take is null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [f(plain(x)) for x in batch[column]]
            yield pd.DataFrame({"diagram": batch["diagram"], "second": pd.Series(out, dtype=object)})

    return rows.select("diagram", column).mapInPandas(work, rows.select("diagram", F.lit(None).cast(kind).alias("second")).schema)


def plain(x):
    """Nested lists of Python's integers."""
    if x is None:
        raise ValueError("null is no object")
    return [plain(v) if isinstance(v, (list, np.ndarray)) else int(v) for v in x]


def jones_frontier_batch(pds: DataFrame) -> DataFrame:
    """(diagram, exp, coef text), as cube.jones_batch(), without its bound on crossings: coefficients are decimal text of any length. Equal codes are worked out once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, e, str(c)) for d, code in zip(batch["diagram"], batch["pd"], strict=True) for e, c in jones_by_frontier(plain(code)).items()]
            yield pd.DataFrame(rows, columns=["diagram", "exp", "coef"])

    return once(pds, ["pd"], lambda d: d.mapInPandas(work, d.select("diagram", F.lit(0).alias("exp"), F.lit("").alias("coef")).schema))
