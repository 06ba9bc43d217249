"""Planar diagrams: validity, crossing signs, Seifert circles, writhe and genus, in array expressions per diagram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pd_verdict(pd: Column) -> Column:
    """Null where the code is valid, else what is wrong: nonempty, four labels each, each label twice, labels 0..2n-1 or 1..2n."""
    labels = F.flatten(pd)
    n2 = 2 * F.size(pd)
    low = F.array_min(labels)
    # Each label twice and all within 2n consecutive values: the sorted labels are low, low, low + 1, low + 1, ...
    paired = F.array_sort(labels) == F.flatten(F.transform(F.sequence(low, low + n2 - 1), lambda v: F.array(v, v)))
    return (
        F.when(F.coalesce(F.size(pd), F.lit(0)) <= 0, "empty")
        .when(F.exists(pd, lambda c: F.size(c) != 4), "a crossing has four labels")
        .when(~low.isin(0, 1), "labels begin at 0 or 1")
        .when(~paired, "each label occurs twice, without gaps")
    )


def from_one(pd: Column) -> Column:
    """Labels that begin at 0 moved up by one."""
    return F.when(F.array_min(F.flatten(pd)) == 0, F.transform(pd, lambda c: F.transform(c, lambda v: v + 1))).otherwise(pd)


def crossing_signs(pd: Column) -> Column:
    """+1 where d follows b on the strand, -1 where b follows d."""
    n2 = 2 * F.size(pd)
    return F.transform(pd, lambda c: F.when(F.get(c, 3) == F.pmod(F.get(c, 1), n2) + 1, 1).when(F.get(c, 1) == F.pmod(F.get(c, 3), n2) + 1, -1))


def checked(pds: DataFrame) -> DataFrame:
    """pds with labels from 1; a code that is no knot's raises. Without crossings it is the unknot's."""
    pd, name = F.col("pd"), F.coalesce(F.col("diagram").cast("string"), F.lit("null"))
    one = from_one(pd)
    along = F.forall(one, lambda c: F.get(c, 2) == F.get(c, 0) % (2 * F.size(one)) + 1) & F.forall(crossing_signs(one), lambda s: s.isNotNull())
    # Each arc enters one crossing, once; of two arcs either may.
    enter = F.flatten(F.zip_with(one, crossing_signs(one), lambda c, s: F.array(F.get(c, 0), F.when(s > 0, F.get(c, 1)).otherwise(F.get(c, 3)))))
    along = along & ((F.size(one) == 1) | (F.size(F.array_distinct(enter)) == 2 * F.size(one)))
    wrong = F.when(pd.isNull(), "null").when(F.size(pd) > 0, F.coalesce(pd_verdict(pd), F.when(~along, "labels do not follow one strand")))
    fine = F.when(wrong.isNull(), F.when(F.size(pd) > 0, one).otherwise(pd)).otherwise(F.raise_error(F.concat(F.lit("diagram "), name, F.lit(": "), wrong)).cast("array<array<int>>").cast(pds.schema["pd"].dataType))
    return pds.withColumn("pd", fine)


def merged_labels(n2: Column, pairs: Column) -> Column:
    """For arcs 1 ... n2 (one, where there are no crossings) the least label of each arc's class, after joining the pairs (struct x, y): a fold, no shuffle."""

    def join(labels, e):
        a, b = F.get(labels, e["x"] - 1), F.get(labels, e["y"] - 1)
        return F.transform(labels, lambda v: F.when((v == a) | (v == b), F.least(a, b)).otherwise(v))

    # Without crossings there is one arc, a circle.
    return F.aggregate(pairs, F.sequence(F.lit(1), F.greatest(n2, F.lit(1))), join)


def seifert_structure(pds: DataFrame) -> DataFrame:
    """(diagram, crossings, circles, writhe, genus, n_plus, n_minus): oriented smoothings join each incoming arc to the next outgoing one."""
    d = pds.withColumn("pd", from_one(F.col("pd"))).withColumn("s", crossing_signs(F.col("pd")))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    joins = F.flatten(
        F.zip_with("pd", "s", lambda c, s: F.array(pair(F.get(c, 0), F.when(s > 0, F.get(c, 3)).otherwise(F.get(c, 1))), pair(F.when(s > 0, F.get(c, 1)).otherwise(F.get(c, 3)), F.get(c, 2))))
    )
    d = d.withColumn("circles", F.size(F.array_distinct(merged_labels(2 * F.size("pd"), joins))))
    writhe = F.aggregate("s", F.lit(0), lambda a, x: a + x)
    n = F.size("pd")
    return d.select("diagram", n.alias("crossings"), "circles", writhe.alias("writhe"), F.expr("(size(pd) - circles + 1) div 2").cast("int").alias("genus"), ((n + writhe) / 2).cast("int").alias("n_plus"), ((n - writhe) / 2).cast("int").alias("n_minus"))
