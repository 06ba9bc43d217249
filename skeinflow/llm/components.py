"""Distributed connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.base import staged


def _near(edges: DataFrame, own_too: bool) -> DataFrame:
    """For each left end the least right end; written, so that a hub's rows can be split when it is joined back."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return staged(least.select("a", F.least("a", "m").alias("m")) if own_too else least, "star")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge, root the least node of its component; nodes of any orderable type.

    Large stars and small stars alternate until no edge changes; each halves the paths, so that rounds grow with the
    logarithm of the longest one. Each round groups with partial aggregation and joins one row per node back, so a hub
    is never gathered into one task, and is written to the shared folder. Null ends and loops are left out; repeated
    edges count once; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = staged(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_near(both, True), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large")
        near = _near(large, False)
        small = large.join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(near.select("a", "m"))
        e = staged(small.distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
