"""A table of known values, all text, by the columns of the published knot tables: look-ups, notations, known answers.

The table itself is not shipped; any DataFrame or file with these columns will do. Blank is null, never a default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.text import blank_as_null, khovanov_mod2, mirrored, normalize_name, parse_braid, parse_nested

# The table's column names.
ROSTER = ("grid_notation", "hfk_polynomial_vector", "ozsvath_szabo_tau_invariant", "three_genus")
SCALARS = {"determinant": "determinant", "signature": "signature", "rasmussen_s": "rasmussen_invariant"}


def known_rows(table: DataFrame) -> DataFrame:
    """Rows with a name, without the row that describes the columns."""
    return table.where((blank_as_null(F.col("name")).isNotNull()) & (F.col("name") != "Name"))


def looked_up(table: DataFrame, names: DataFrame) -> DataFrame:
    """names (diagram) with the table's row for each, by normalised name; a name that isn't there raises."""
    rows = known_rows(table)
    wanted = names.select("diagram", normalize_name(F.col("diagram")).alias("__name"))
    out = wanted.join(rows, F.col("__name") == F.col("name"), "left")
    return out.withColumn("name", F.when(F.col("name").isNull(), F.raise_error(F.concat(F.lit("unknown knot: "), F.col("diagram")))).otherwise(F.col("name"))).drop("__name")


def _there(column: str):
    """The column's text; a blank one raises."""
    c = blank_as_null(F.col(column))
    return F.when(c.isNull(), F.raise_error(F.concat(F.lit(f"no {column} of "), F.col("diagram")))).otherwise(c)


def pd_codes(rows: DataFrame) -> DataFrame:
    return rows.select("diagram", parse_nested(_there("pd_notation")).alias("pd"))


def braid_words(rows: DataFrame) -> DataFrame:
    return rows.select("diagram", parse_braid(F.col("braid_notation")).alias("braid"))


def grid_markers(rows: DataFrame) -> DataFrame:
    """(diagram, r, c), 1-based, as operators.grid.from_markers() takes them."""
    m = rows.select("diagram", F.explode(parse_nested(F.col("grid_notation"))).alias("m"))
    return m.select("diagram", F.get("m", 0).alias("r"), F.get("m", 1).alias("c"))


def hfk_ranks(rows: DataFrame) -> DataFrame:
    """(diagram, m, a, rank) of [r,A,M; ...] vectors; of equal cells the last one holds."""
    v = rows.select("diagram", F.posexplode(F.split(F.regexp_replace(blank_as_null(F.col("hfk_polynomial_vector")), r"[\[\]{}\s]", ""), ";")).alias("k", "t"))
    p = F.split("t", ",")
    return v.select("diagram", p[2].cast("int").alias("m"), p[1].cast("int").alias("a"), p[0].cast("long").alias("r"), "k").groupBy("diagram", "m", "a").agg(F.max_by("r", "k").alias("rank"))


def tau_values(rows: DataFrame) -> DataFrame:
    return rows.select("diagram", _there("ozsvath_szabo_tau_invariant").cast("int").alias("tau"))


def known_answers(rows: DataFrame, invariant: str) -> DataFrame:
    """(diagram, value) in the contract's JSON text; null where the table is blank or has no such invariant.

    The table's Khovanov groups and s are those of the mirror image: gradings and sign are turned back.
    """
    if invariant in SCALARS:
        raw = blank_as_null(F.col(SCALARS[invariant])).cast("int")
        return rows.select("diagram", (-raw if invariant == "rasmussen_s" else raw).cast("string").alias("value"))
    if invariant in ("alexander_polynomial", "jones_polynomial"):
        vector = parse_nested(F.col(f"{invariant}_vector"), "array<bigint>")
        coeffs = F.slice("v", F.lit(3), F.size("v"))
        v = rows.select("diagram", vector.alias("v"))
        if invariant == "alexander_polynomial":
            first = F.get(F.filter(coeffs, lambda x: x != 0), F.lit(0))
            return v.select("diagram", F.to_json(F.transform(coeffs, lambda x: F.when(first < 0, -x).otherwise(x))).alias("value"))
        cells = F.filter(F.transform(coeffs, lambda x, i: F.array(F.get("v", F.lit(0)) + i, x)), lambda c: F.get(c, F.lit(1)) != 0)
        return v.select("diagram", F.to_json(cells).alias("value"))
    if invariant in ("khovanov_homology", "rational_khovanov_homology"):
        v = rows.select("diagram", F.explode(parse_nested(F.col("khovanov_unreduced_integral_vector"))).alias("v"))
        v = v.select("diagram", *(F.get("v", k).alias(n) for k, n in enumerate(("torsion", "mult", "i", "j"))))
        free = v.where("torsion = 0").groupBy("diagram", "i", "j").agg(F.sum("mult").alias("dim"))
        table = mirrored(khovanov_mod2(v) if invariant == "khovanov_homology" else free)
        cells = table.groupBy("diagram").agg(F.to_json(F.array_sort(F.collect_list(F.array(*(F.col(c).cast("long") for c in ("i", "j", "dim")))))).alias("value"))
        return rows.select("diagram").join(cells, "diagram", "left")
    return rows.select("diagram", F.lit(None).cast("string").alias("value"))


def floer_roster(table: DataFrame, most_rows: int) -> DataFrame:
    """(name, n): knots with a grid of at most so many rows and all of ROSTER known, by size, then name."""
    rows = known_rows(table)
    for c in ROSTER:
        rows = rows.where(blank_as_null(F.col(c)).isNotNull())
    n = (F.size(parse_nested(F.col("grid_notation"))) / 2).cast("int")
    return rows.select("name", n.alias("n")).where(F.col("n") <= most_rows).orderBy("n", "name")
