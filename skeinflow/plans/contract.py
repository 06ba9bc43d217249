"""The result contract: one row per diagram and invariant with provenance and checks; verdicts and reports over them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow import VERSION
from skeinflow.functions.once import once

#: What compute() knows; names that other texts use for them.
INVARIANTS = ("determinant", "signature", "alexander_polynomial", "jones_polynomial", "khovanov_homology", "rational_khovanov_homology", "rasmussen_s", "hfk_hat", "seifert_genus", "tau")
ALIASES = {"rasmussen_invariant": "rasmussen_s"}
#: Worst first.
PRIORITY = ("mismatch", "mirror", "pass", "oracle")


#: By invariant: the column that it is worked out from, how, and what it is checked with.
METHODS = {
    "determinant": ("braid", "Seifert form, modulo primes", "Burau representation"),
    "signature": ("braid", "Seifert form by congruence", "eigenvalues"),
    "alexander_polynomial": ("braid", "Seifert form, interpolation", "Burau representation"),
    "jones_polynomial": ("pd", "cube of resolutions", "frontier of open arcs"),
    "khovanov_homology": ("pd", "cube complex over F2", "Euler characteristic by a frontier"),
    "rational_khovanov_homology": ("pd", "cube complex over Q", "Euler characteristic by a frontier"),
    "rasmussen_s": ("pd", "Lee's filtered complex, arrays", "Lee's filtered complex, tables"),
    "hfk_hat": ("n, o, x", "grid complex", "Euler characteristic of the states"),
    "seifert_genus": ("n, o, x", "grid complex", None),
    "tau": ("n, o, x", "filtered grid complex", None),
}


def _rows(df: DataFrame, *c: str) -> DataFrame:
    return df.groupBy("diagram").agg(F.to_json(F.array_sort(F.collect_list(F.array(*(F.col(x).cast("long") for x in c))))).alias("value"))


def _one(df: DataFrame, c: str) -> DataFrame:
    return df.select("diagram", F.col(c).cast("string").alias("value"))


def compute(diagrams: DataFrame, invariant: str, known: DataFrame | None = None, validate: bool = True, cross_check: bool = True) -> DataFrame:
    """(diagram, invariant, value, method, backend, version, inputs, known_answer_check, cross_backend_check, d_squared_check, validated).

    value is canonical JSON text; inputs is JSON of what it was worked out from. diagrams have a column pd, braid, or n, o,
    x as the invariant needs, a row for each diagram. known is (diagram, value): equal is pass, else fail; what isn't there
    is not_available. The cross-check is a second algorithm (METHODS); its verdict is pass, fail, or not_available where
    there is none. Either pass validates, unless the other fails; with validate, whatever isn't validated raises.
    """
    from skeinflow.operators import classical, cube, grid, khovanov

    name = ALIASES.get(invariant, invariant)
    if name not in METHODS:
        raise ValueError(f"unknown invariant {invariant!r}; there are {', '.join(INVARIANTS)}")
    if name in ("determinant", "signature"):
        got = _one(classical.braid_texts(diagrams), name)
    elif name == "alexander_polynomial":
        got = classical.braid_texts(diagrams).select("diagram", F.concat(F.lit("["), F.array_join("alexander", ","), F.lit("]")).alias("value"))
    elif name == "jones_polynomial":
        got = _rows(cube.jones_batch(diagrams), "exp", "coef")
    elif name in ("khovanov_homology", "rational_khovanov_homology"):
        got = _rows(khovanov.khovanov_batch(diagrams, "q" if name[0] == "r" else "f2"), "i", "j", "dim")
    elif name == "rasmussen_s":
        got = _one(khovanov.rasmussen_batch(diagrams), "s")
    elif name == "hfk_hat":
        got = _rows(grid.hfk_hat(diagrams), "m", "a", "rank")
    elif name == "seifert_genus":
        got = _one(grid.seifert_genus(diagrams), "genus")
    else:
        got = _one(grid.tau(diagrams), "tau")
    column, _, second = METHODS[name]
    given = diagrams.select("diagram", F.to_json(F.struct(*column.split(", "))).alias("inputs"))
    cross = cross_checked(diagrams, got, name) if cross_check and second else None
    return finalized(got.join(given, "diagram"), name, known, validate, cross)


def cross_checked(diagrams: DataFrame, got: DataFrame, name: str) -> DataFrame:
    """(diagram, agrees boolean or null) of results (diagram, value), by an algorithm of its own for each object; equal ones with equal values once."""
    from skeinflow.operators import grid, khovanov, second

    if name in ("determinant", "signature", "alexander_polynomial"):
        both = got.join(diagrams.select("diagram", "braid"), "diagram")

        def agrees(batches):
            from skeinflow.operators import classical

            for batch in batches:
                out = []
                for braid, value in zip(batch["braid"], batch["value"], strict=True):
                    braid, value = second.plain(braid), json.loads(value)
                    if name == "signature":
                        out.append(second.signature_by_eigenvalues(braid) == value)
                    elif name == "alexander_polynomial":
                        out.append(second.alexander_agrees(braid, value))
                    else:
                        # The determinant is the polynomial's absolute value at -1, whose coefficients Burau's matrix confirms.
                        a = classical.alexander_of(classical.seifert_of(braid))
                        same = abs(sum(c * (-1) ** i for i, c in enumerate(a))) == value
                        confirmed = second.alexander_agrees(braid, a)
                        out.append(None if confirmed is None else confirmed and same)
                yield pd.DataFrame({"diagram": batch["diagram"], "agrees": pd.Series(out, dtype=object)})

        return once(both, ["braid", "value"], lambda d: d.mapInPandas(agrees, d.select("diagram", F.lit(None).cast("boolean").alias("agrees")).schema))
    if name in ("jones_polynomial", "khovanov_homology", "rational_khovanov_homology"):
        both = got.join(diagrams.select("diagram", "pd"), "diagram")

        def agrees(batches):
            for batch in batches:
                out = []
                for code, value in zip(batch["pd"], batch["value"], strict=True):
                    jones, value = second.jones_by_frontier(second.plain(code)), json.loads(value)
                    if name == "jones_polynomial":
                        out.append(sorted(map(tuple, value)) == sorted(jones.items()))
                        continue
                    # Tables have Jones in the inverse variable: j is minus twice the exponent, give or take one.
                    want: dict[int, int] = {}
                    for e, c in jones.items():
                        for k in (1, -1):
                            want[k - 2 * e] = want.get(k - 2 * e, 0) + c
                    have: dict[int, int] = {}
                    for i, j, n in value:
                        have[j] = have.get(j, 0) + (-1) ** (i % 2) * n
                    out.append({j: c for j, c in want.items() if c} == {j: c for j, c in have.items() if c})
                yield pd.DataFrame({"diagram": batch["diagram"], "agrees": out})

        return once(both, ["pd", "value"], lambda d: d.mapInPandas(agrees, d.select("diagram", F.lit(None).cast("boolean").alias("agrees")).schema))
    if name == "rasmussen_s":
        other = khovanov.rasmussen_s(diagrams).select("diagram", F.col("s").cast("string").alias("other"))
        return got.join(other, "diagram", "left").select("diagram", (F.col("value") == F.col("other")).alias("agrees"))
    # The homology's Euler characteristic, times that of V to the n - 1, is that of all states.
    ranks = got.select("diagram", F.explode(F.from_json("value", "array<array<bigint>>")).alias("c")).select("diagram", *(F.get("c", k).alias(x) for k, x in enumerate(("m", "a", "rank"))))
    sign = F.when(F.pmod("m", F.lit(2)) == 0, 1).otherwise(-1)
    own = grid.tensored(ranks, diagrams).select("diagram", "a", (sign * F.col("dim")).alias("chi"))
    rest = own.union(grid.alexander_euler(diagrams).select("diagram", "a", -F.col("chi"))).groupBy("diagram", "a").agg(F.sum("chi").alias("left")).where("left <> 0").select("diagram").distinct()
    return got.join(rest.withColumn("rest", F.lit(True)), "diagram", "left").select("diagram", F.col("rest").isNull().alias("agrees"))


def finalized(got: DataFrame, invariant: str, known: DataFrame | None = None, validate: bool = False, cross: DataFrame | None = None) -> DataFrame:
    """Result rows of (diagram, value) and perhaps inputs, with provenance and checks; see compute().

    A diagram known twice with equal values is known once; with different ones it raises.
    """
    spark = got.sparkSession
    name = lambda x: F.coalesce(F.col("diagram").cast("string"), F.lit("null")) if x is None else x
    if known is None:
        known = spark.createDataFrame([], "diagram string, value string")
    k = known.where("value is not null").groupBy("diagram").agg(F.min("value").alias("known"), F.max("value").alias("most"))
    twice = F.raise_error(F.concat(F.lit("two known values of "), name(None))).cast("string")
    out = got.join(k.withColumn("known", F.when(F.col("known") == F.col("most"), F.col("known")).otherwise(twice)).drop("most"), "diagram", "left")
    if cross is not None:
        out = out.join(cross.select("diagram", "agrees"), "diagram", "left")
    else:
        out = out.withColumn("agrees", F.lit(None).cast("boolean"))
    verdict = lambda ok: F.when(ok.isNull(), "not_available").when(ok, "pass").otherwise("fail")
    method = METHODS.get(invariant, (None, "given", None))[1]
    square = F.lit("pass" if "khovanov" in invariant else "not_applicable")
    inputs = F.col("inputs") if "inputs" in got.columns else F.lit(None).cast("string")
    out = out.select("diagram", F.lit(invariant).alias("invariant"), "value", F.lit(method).alias("method"), F.lit("spark").alias("backend"), F.lit(VERSION).alias("version"), inputs.alias("inputs"), verdict(F.col("known") == F.col("value")).alias("known_answer_check"), verdict(F.col("agrees")).alias("cross_backend_check"), square.alias("d_squared_check"))
    checks = F.array("known_answer_check", "cross_backend_check")
    out = out.withColumn("validated", F.array_contains(checks, "pass") & ~F.array_contains(checks, "fail"))
    if validate:
        out = out.withColumn("validated", F.when(F.col("validated"), True).otherwise(F.raise_error(F.concat(F.lit("not validated: "), F.col("diagram").cast("string"))).cast("boolean")))
    return out


def verdicts(native: DataFrame, oracle: DataFrame) -> DataFrame:
    """(diagram, verdict) of bigraded tables (diagram, i, j, dim): pass, mirror (both gradings negated) or mismatch.

    A diagram that only one of the tables has is a mismatch. Zeros count for nothing, and rows of one cell are added.
    """
    cells = lambda df: df.groupBy("diagram", "i", "j").agg(F.sum("dim").cast("long").alias("dim"))
    sign = lambda df, s: cells(df).groupBy("diagram").agg(F.array_sort(F.collect_list(F.when(F.col("dim") != 0, F.struct((s * F.col("i")).alias("i"), (s * F.col("j")).alias("j"), "dim")))).alias("t"))
    n, o, m = sign(native, 1), sign(oracle, 1).withColumnRenamed("t", "o"), sign(oracle, -1).withColumnRenamed("t", "m")
    j = n.join(o.join(m, "diagram"), "diagram", "full")
    return j.select("diagram", F.when(F.col("t") == F.col("o"), "pass").when(F.col("t") == F.col("m"), "mirror").otherwise("mismatch").alias("verdict"))


def worst_verdicts(rows: DataFrame) -> DataFrame:
    """(tool, invariant, verdict) over a ladder of diagrams: mismatch before mirror before pass before oracle."""
    order = F.array(*map(F.lit, PRIORITY))
    worst = rows.groupBy("tool", "invariant").agg(F.min(F.array_position(order, F.col("verdict"))).alias("p"))
    return worst.select("tool", "invariant", F.get(order, (F.col("p") - 1).cast("int")).alias("verdict"))


def median_ms(rows: DataFrame) -> DataFrame:
    """(tool, invariant, ms): the median over diagrams of each one's best time."""
    best = rows.groupBy("tool", "invariant", "diagram").agg(F.min("seconds").alias("s"))
    return best.groupBy("tool", "invariant").agg((F.percentile("s", F.lit(0.5)) * 1000).alias("ms"))


def section_columns(results: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, tool): tools that have a result (tool, invariant, value not null) of any invariant of a section (section, invariant)."""
    there = results.where("value is not null").select("tool", "invariant").distinct()
    return sections.select("section", "invariant").distinct().join(there, "invariant").select("section", "tool").distinct()
