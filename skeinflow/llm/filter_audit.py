"""What filters remove together and apart, for every order of applying them, from joint-failure counts alone."""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged

SPACE = r"[\x20\x09-\x0D]+"
#: The filters' failure conditions over the struct of text_figures(); E, copies, needs the table.
CONDITIONS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 2 * n_chars",
    "D": "has_signs",
}
COPY = "E"
#: 8! orders are 322,560 rows a part; more are refused.
MOST_FILTERS = 8


def text_figures(text: Column) -> Column:
    """A struct of what the conditions look at, over a whole text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_capitals"),
        F.length(text).cast("long").alias("n_chars"),
        text.rlike(r"[#$%&*|]").alias("has_signs"),
    )


def with_copies(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows with name: whether another row with an equal key has a smaller order.

    Only keys that stand in several rows are joined back, one row for each, so that a key of any number of rows can be
    split by Spark. A null order is neither smaller nor larger; rows equal in both are no copies of each other.
    """
    k, least = own(rows, "__key", "__least")
    several = rows.groupBy(F.col(quoted(key)).alias(k)).agg(F.min(quoted(order)).alias(least), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # Written: with an exchange of its own on either side, a hot key's rows can be split.
    out = rows.join(staged(several, "copies"), F.col(quoted(key)) == F.col(k), "left")
    return out.withColumn(name, F.coalesce(F.col(quoted(order)) > F.col(least), F.lit(False))).drop(k, least)


def joint_failures(rows: DataFrame, filters: list[str], part: str, measures: dict[str, Column]) -> DataFrame:
    """(part, for each measure an array over all filter sets of the measure's sum over rows that fail every filter of it).

    Sets are bit masks, filter i at bit i; the empty set counts all rows. A set's rows are those whose product of flags
    is one, so that a part costs each task one row, however many rows the part has. Null flags are no failures.
    """
    flags = [F.coalesce(F.col(quoted(f)), F.lit(False)).cast("long") for f in filters]
    own_flags = [f"__f{i}" for i in range(len(filters))]
    sized = rows.select(F.col(quoted(part)).alias("part"), *(f.alias(n) for f, n in zip(flags, own_flags, strict=True)), *(m.cast("long").alias(f"__m_{n}") for n, m in measures.items()))

    def product(mask: int, measure: str) -> Column:
        return reduce(lambda a, i: a * F.col(own_flags[i]), (i for i in range(len(filters)) if mask >> i & 1), F.col(f"__m_{measure}"))

    return sized.groupBy("part").agg(*(F.array(*(F.sum(product(s, m)) for s in range(1 << len(filters)))).alias(m) for m in measures))


def _sign(mask: Column) -> Column:
    return F.lit(1) - 2 * (F.bit_count(mask) % 2)


def survivors(joint: Column, n: int) -> Column:
    """For each filter set the sum over rows that fail none of it: signed joint failures over its subsets."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((1 << n) - 1)),
        lambda m: F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(m) == s, _sign(s) * F.get(joint, s)).otherwise(0)),
    )


def lone_failures(joint: Column, n: int) -> Column:
    """For each filter the sum over rows that fail it and no other: signed joint failures over the sets that hold it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda f: F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda a, s: a + F.when(_bit(s, f) == 1, -_sign(s) * F.get(joint, s)).otherwise(0)),
    )


def shapley_sums(joint: Column, n: int) -> Column:
    """For each filter what it removes, summed over all n! orders: a set's Harsanyi dividend is its signed joint failures,

    shared evenly by its filters; n! over a set's size is a whole number, so the sums are exact.
    """
    share = F.array(*(F.lit(math.factorial(n) // max(1, k)) for k in range(n + 1)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda f: F.aggregate(
            F.sequence(F.lit(1), F.lit((1 << n) - 1)),
            F.lit(0).cast("long"),
            lambda a, s: a + F.when(_bit(s, f) == 1, -_sign(s) * F.get(joint, s) * F.get(share, F.bit_count(s))).otherwise(0),
        ),
    )


def _bit(mask: Column, i: Column) -> Column:
    return F.call_function("getbit", mask.cast("long"), i).cast("int")


def audit_filters(rows: DataFrame, filters: list[str], part: str, lost: dict[str, Column] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, a column for each of lost, shapley).

    rows has a boolean column for each filter (true: fails; null: passes). For each part, each order of the filters (their
    names run together, so names of one letter read best) and each step of it: rows kept after the step, removed at it,
    failing its filter but removed earlier, failing its filter only; of each of lost (a condition by name) the rows that
    the step removes; and what its filter removes, summed over all orders. The data is read once, by an aggregation
    that sends one row for each task and part; all else is arithmetic on the 2^n joint counts of a part. A null part is
    a part; an empty table has no parts; other columns, whatever their names, are not looked at.
    """
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) != n:
        raise ValueError(f"between one and {MOST_FILTERS} different filters")
    lost = lost or {}
    measures = {"__rows": F.lit(1)} | {f"__lost_{k}": F.coalesce(c, F.lit(False)).cast("int") for k, c in lost.items()}
    joint = joint_failures(rows, filters, part, measures)
    plan = [
        {"filter_order": "".join(filters[i] for i in order), "step": at + 1, "f": f, "before": sum(1 << i for i in order[:at]), "after": sum(1 << i for i in order[: at + 1])}
        for order in permutations(range(n))
        for at, f in enumerate(order)
    ]
    steps = F.from_json(F.lit(json.dumps(plan)), "array<struct<filter_order: string, step: int, f: int, before: int, after: int>>")
    # The arrays' names differ from those they are made of: a name within a lambda may be looked up late, among the aliases.
    left = {m: survivors(F.col(m), n).alias(f"__left{m}") for m in measures}
    per = joint.select("part", F.col("__rows").alias("__joint"), *left.values(), lone_failures(F.col("__rows"), n).alias("__lone"), shapley_sums(F.col("__rows"), n).alias("__shapley"))
    each = per.select("*", F.inline(steps))
    gone = {m: F.get(f"__left{m}", "before") - F.get(f"__left{m}", "after") for m in measures}
    return each.select(
        "part",
        "filter_order",
        "step",
        F.get("__left__rows", "after").alias("kept"),
        gone["__rows"].alias("removed"),
        (F.get("__joint", F.expr("shiftleft(1, f)")) - gone["__rows"]).alias("redundant"),
        F.get("__lone", "f").alias("unique_fails"),
        *(gone[f"__lost_{k}"].alias(k) for k in lost),
        F.get("__shapley", "f").alias("shapley"),
    )


def flagged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of docs, by whole texts; see op11_filter_audit()."""
    figures = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), text_figures(F.col("text")).alias("x"))
    slim = staged(figures.select("doc_id", "part", "digest", *(F.expr(_within(c)).alias(name) for name, c in CONDITIONS.items())), "flags")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = slim.join(marks, F.col("doc_id") == F.col("__of"), "left").drop("__of")
    return with_copies(marked, "digest", "doc_id", COPY)


def _within(condition: str) -> str:
    for name in ("n_words", "n_distinct", "n_capitals", "n_chars", "has_signs"):
        condition = condition.replace(name, f"x.{name}")
    return condition


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source (null: the empty one), order of five filters and step, what the step does; 600 rows a source.

    A null text is empty: it fails A alone, and E where a smaller id has an empty or null text. Rows that share an id are
    no copies of each other by it, each counts; a null id has no labels and is nobody's copy. An id labelled twice is
    good (toxic) if any of its rows says so. No documents give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = flagged_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit_filters(rows, [*CONDITIONS, COPY], "part", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


ORACLE = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
f as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from d left join l using (doc_id)),
p as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
x as (select unnest([1, 2, 4, 8, 16]) as b, unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select x1.c || x2.c || x3.c || x4.c || x5.c as filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] as bits from x x1, x x2, x x3, x x4, x x5
  where x1.b + x2.b + x3.b + x4.b + x5.b = 31 and (x1.b | x2.b | x3.b | x4.b | x5.b) = 31),
s as (select filter_order, k::int as step, bits[k] as b, list_sum(list_prepend(0, bits[1:k - 1])) ::int as gone from o, range(1, 6) r(k)),
r as (select part, filter_order, step, b, sum(case when fails & (gone | b) = 0 then n else 0 end)::bigint as kept,
    sum(case when fails & gone = 0 and fails & b <> 0 then n else 0 end)::bigint as removed, sum(case when fails & gone <> 0 and fails & b <> 0 then n else 0 end)::bigint as redundant,
    sum(case when fails = b then n else 0 end)::bigint as unique_fails, sum(case when fails & gone = 0 and fails & b <> 0 then good else 0 end)::bigint as good_lost,
    sum(case when fails & gone = 0 and fails & b <> 0 then toxic else 0 end)::bigint as toxic_lost from p, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, b))::bigint as shapley from r
"""
