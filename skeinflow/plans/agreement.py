"""Agreement of values with those of other tools: readers of what tools print, and verdicts up to each invariant's conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags of the lines that a tool's script prints. Fixed values.
TAGS = ("JONES", "ALEXANDER", "SIGNATURE", "DETERMINANT", "KHOVANOV")
_LINES = r"\r\n|\n|\r"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def field_after_colon(c: Column, marker: str) -> Column:
    """What follows the first colon of the first line that has the marker; null where no line has it."""
    line = F.get(F.filter(F.split(c, _LINES), lambda x: F.contains(x, F.lit(marker))), 0)
    return F.when(F.contains(line, F.lit(":")), _stripped(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)))


def torus_strands(name: Column) -> Column:
    """n where a name n_1 with n odd and 3 or more means the torus knot T(2, n); null elsewhere."""
    n = F.regexp_extract(name, r"^([0-9]+)_1$", 1).try_cast("int")
    return F.when((n >= 3) & (n % 2 == 1), n)


def last_polynomial(c: Column) -> Column:
    """The last line of nothing but a polynomial's characters that mentions q; null where there is none."""
    lines = F.transform(F.split(c, _LINES), _stripped)
    return F.try_element_at(F.filter(lines, lambda x: F.contains(x, F.lit("q")) & x.rlike(r"^[q t0-9^*+()\-]+$")), F.lit(-1))


def tagged_fields(texts: DataFrame) -> DataFrame:
    """(diagram, tag, value) of lines that begin with a known tag; of a tag's lines in one text the last counts."""
    lines = texts.select("diagram", F.posexplode(F.split("text", _LINES)).alias("at", "line"))
    lines = lines.withColumn("tag", F.regexp_extract("line", rf"^({'|'.join(TAGS)}) ", 1)).where("tag <> ''")
    value = F.expr("substring(line, length(tag) + 2)")
    return lines.groupBy("diagram", "tag").agg(F.max_by(value, "at").alias("value"))


def polynomial_fields(fields: DataFrame) -> DataFrame:
    """(diagram, exp, coef) of values like {1: 1, 3: -2}; an exponent that comes again counts as it is last; zeros dropped."""
    pair = r"(-?[0-9]+)\s*:\s*(-?[0-9]+)"
    p = fields.select("diagram", F.posexplode(F.regexp_extract_all("value", F.lit(pair), 0)).alias("at", "p"))
    number = lambda k: F.regexp_extract("p", pair, k)
    return p.groupBy("diagram", number(1).cast("int").alias("exp")).agg(F.max_by(number(2).cast("long"), "at").alias("coef")).where("coef <> 0")


def cell_fields(fields: DataFrame) -> DataFrame:
    """(diagram, i, j, free, even) of values like {(0, 1): (0,), (3, 7): (2, 0)}: a factor 0 is a free summand, an even one is torsion that F2 sees."""
    cell = r"\(\s*(-?[0-9]+)\s*,\s*(-?[0-9]+)\s*\)\s*:\s*\(([^)]*)\)"
    c = fields.select("diagram", F.explode(F.regexp_extract_all("value", F.lit(cell), 0)).alias("cell"))
    part = lambda k: F.regexp_extract("cell", cell, k)
    factors = F.transform(F.regexp_extract_all(part(3), F.lit(r"-?[0-9]+"), 0), lambda x: x.cast("long"))
    count = lambda keep: F.size(F.filter(factors, keep)).alias
    return c.select("diagram", part(1).cast("int").alias("i"), part(2).cast("int").alias("j"), count(lambda x: x == 0)("free"), count(lambda x: (x != 0) & (x % 2 == 0))("even"))


def negated_exponents(poly: DataFrame) -> DataFrame:
    """t and 1/t exchanged."""
    return poly.withColumn("exp", -F.col("exp"))


def halved_exponents(poly: DataFrame) -> DataFrame:
    """From a variable that is the square root of t to t; an odd exponent raises."""
    odd = F.raise_error(F.concat(F.lit("an odd exponent of the root of t: "), F.col("diagram").cast("string")))
    return poly.withColumn("exp", F.when(F.col("exp") % 2 == 0, (F.col("exp") / 2).cast("int")).otherwise(odd))


def _listed(poly: DataFrame, name: str) -> DataFrame:
    term = F.struct(F.col("exp").cast("long").alias("exp"), F.col("coef").cast("long").alias("coef"))
    return poly.where("coef <> 0").groupBy("diagram").agg(F.array_sort(F.collect_list(term)).alias(name))


def _negated(terms: Column) -> Column:
    return F.array_sort(F.transform(terms, lambda t: F.struct((-t["exp"]).alias("exp"), t["coef"].alias("coef"))))


def _unit_free(terms: Column) -> Column:
    first = F.get(terms, 0)
    return F.transform(terms, lambda t: F.struct((t["exp"] - first["exp"]).alias("exp"), (t["coef"] * F.signum(first["coef"]).cast("long")).alias("coef")))


def jones_verdicts(native: DataFrame, oracle: DataFrame) -> DataFrame:
    """(diagram, verdict) of Laurent polynomials (diagram, exp, coef): pass, mirror (t for 1/t) or mismatch, for each diagram that either has.

    Each (diagram, exp) occurs once. A polynomial is as long as its diagram's crossings allow; one side is negated, not joined again.
    """
    both = _listed(native, "a").join(_listed(oracle, "b"), "diagram", "full")
    return both.select("diagram", F.when(F.col("a").eqNullSafe(F.col("b")), "pass").when(F.col("a") == _negated(F.col("b")), "mirror").otherwise("mismatch").alias("verdict"))


def alexander_verdicts(native: DataFrame, oracle: DataFrame) -> DataFrame:
    """(diagram, verdict), pass or mismatch: polynomials up to a sign and a power of t, for each diagram that either has."""
    both = _listed(native, "a").join(_listed(oracle, "b"), "diagram", "full")
    return both.select("diagram", F.when(_unit_free(F.col("a")).eqNullSafe(_unit_free(F.col("b"))), "pass").otherwise("mismatch").alias("verdict"))


def scalar_verdicts(native: DataFrame, oracle: DataFrame) -> DataFrame:
    """(diagram, verdict) of (diagram, value): pass, mirror (the negative) or mismatch, for each diagram that either has."""
    both = native.select("diagram", F.col("value").alias("a")).join(oracle.select("diagram", F.col("value").alias("b")), "diagram", "full")
    return both.select("diagram", F.when(F.col("a") == F.col("b"), "pass").when(F.col("a") == -F.col("b"), "mirror").otherwise("mismatch").alias("verdict"))
