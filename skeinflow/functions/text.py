"""Names, notations and polynomials as text, as columns. Blank is null, and never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_as_null(c: Column) -> Column:
    """Null for empty text and for "does not exist"."""
    t = F.trim(c)
    return F.when((t != "") & (F.lower(t) != "does not exist"), t)


def normalize_name(c: Column) -> Column:
    """Trimmed, without a leading K, with the underscore that tables put between class and number."""
    t = F.regexp_replace(F.trim(c), "^K", "")
    return F.when(F.instr(t, "_") > 0, t).otherwise(F.regexp_replace(t, r"^([0-9]+[a-zA-Z])([0-9]+)$", "$1_$2"))


def parse_nested(c: Column, kind: str = "array<array<int>>") -> Column:
    """Nested integer lists in brackets or braces, with commas or semicolons."""
    return F.from_json(F.translate(blank_as_null(c), "{};", "[],"), kind)


def parse_braid(c: Column) -> Column:
    """A flat braid word; one nesting around it is taken off."""
    t = F.translate(blank_as_null(c), "{};", "[],")
    flat = F.when(t.rlike(r"^\s*\[\s*\["), F.regexp_extract(t, r"(?s)^\s*\[(.*)\]\s*$", 1)).otherwise(t)
    return F.from_json(flat, "array<int>")


def khovanov_rows(vectors: DataFrame, column: str = "text") -> DataFrame:
    """(diagram, torsion, mult, i, j) of integral vectors."""
    v = vectors.select("diagram", F.explode(parse_nested(F.col(column))).alias("v"))
    return v.select("diagram", *(F.get("v", k).alias(n) for k, n in enumerate(("torsion", "mult", "i", "j"))))


def khovanov_mod2(rows: DataFrame) -> DataFrame:
    """Universal coefficients: dim(i, j) = free(i, j) + even torsion(i, j) + even torsion(i + 1, j); zeros dropped."""
    free = rows.where("torsion = 0").select("diagram", "i", "j", "mult")
    even = rows.where("torsion > 0 and torsion % 2 = 0")
    both = free.union(even.select("diagram", "i", "j", "mult")).union(even.select("diagram", F.col("i") - 1, "j", "mult"))
    return both.groupBy("diagram", "i", "j").agg(F.sum("mult").alias("dim")).where("dim <> 0")


def mirrored(table: DataFrame) -> DataFrame:
    return table.withColumns({"i": -F.col("i"), "j": -F.col("j")})


def laurent_terms(texts: DataFrame, var: str = "t") -> DataFrame:
    """(diagram, exp, coef) of Laurent polynomials in one variable; like terms add up, zeros dropped."""
    clean = F.regexp_replace(F.regexp_replace("text", r"[\s*()]", ""), rf"{var}\^", f"{var}")
    terms = texts.select("diagram", F.explode(F.regexp_extract_all(clean, F.lit(rf"([+-]?(?:[0-9]*{var}(?:-?[0-9]+)?|[0-9]+))"), 1)).alias("term")).where("term <> ''")
    head = F.regexp_extract("term", rf"^([+-]?[0-9]*){var}?", 1)
    coef = F.when(head.isin("", "+"), 1).when(head == "-", -1).otherwise(head.try_cast("int"))
    power = F.regexp_extract("term", rf"{var}(-?[0-9]*)$", 1)
    exp = F.when(~F.contains("term", F.lit(var)), 0).when(power == "", 1).otherwise(power.try_cast("int"))
    return terms.select("diagram", exp.alias("exp"), coef.cast("long").alias("coef")).groupBy("diagram", "exp").agg(F.sum("coef").alias("coef")).where("coef <> 0")


def khovanov_terms(texts: DataFrame) -> DataFrame:
    """(diagram, i, j, dim) of sums of monomials c t^i q^j."""
    terms = texts.select("diagram", F.explode(F.split(F.col("text"), r"\s\+\s")).alias("term"))
    power = lambda v: F.when(~F.contains("term", F.lit(v)), 0).otherwise(F.coalesce(F.regexp_extract("term", rf"{v}\^\(?(-?[0-9]+)", 1).try_cast("int"), F.lit(1)))
    coef = F.coalesce(F.regexp_extract("term", r"^\s*([0-9]+)", 1).try_cast("long"), F.lit(1))
    return terms.select("diagram", power("t").alias("i"), power("q").alias("j"), coef.alias("c")).groupBy("diagram", "i", "j").agg(F.sum("c").alias("dim"))


def cpulist(c: Column) -> Column:
    """Distinct sorted numbers of a list like 0-3,8."""
    parts = F.filter(F.split(c, ","), lambda p: F.trim(p) != "")
    ends = lambda p: F.split(F.trim(p), "-")
    each = F.transform(parts, lambda p: F.sequence(F.get(ends(p), F.lit(0)).cast("int"), F.element_at(ends(p), -1).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def human_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.format_string("%.0f B", n)
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return out
