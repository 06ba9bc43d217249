"""Equal objects are worked out once, and every object has its rows."""

import pytest
from pyspark.sql import functions as F

from skeinflow.functions.once import once
from skeinflow.operators import grid, khovanov, second
from skeinflow.plans import isolation
from skeinflow.sources import fixtures


def _counted(spark, monkeypatch, module, name):
    """Objects that a kernel of this process' plan gets: the plan's rows before it."""
    seen = []
    monkeypatch.setattr(module, "once", lambda objects, columns, f: once(objects, columns, lambda d: (seen.append(d), f(d))[1]))
    return seen


@pytest.mark.parametrize("module, f", [(khovanov, lambda t: khovanov.khovanov_batch(t, "q")), (khovanov, khovanov.rasmussen_batch), (khovanov, khovanov.rasmussen_s), (khovanov, khovanov.boundary_entries), (khovanov, khovanov.khovanov_homology), (second, second.jones_frontier_batch), (isolation, lambda t: isolation.attempted(t, "jones_polynomial"))])
def test_equal_codes_once(spark, monkeypatch, module, f):
    names = ["3_1", "4_1"]
    one = fixtures.pd_table(spark, {n: fixtures.PD[n] for n in names})
    many = one.crossJoin(spark.range(7).withColumnRenamed("id", "k")).select(F.concat("diagram", F.lit("/"), "k").alias("diagram"), "pd")
    seen = _counted(spark, monkeypatch, module, f)
    got = {tuple(r) for r in f(many).collect()}
    assert seen[0].count() == 2 and seen[0].rdd.getNumPartitions() >= 4
    assert got == {(f"{r[0]}/{k}", *r[1:]) for r in f(one).collect() for k in range(7)}


@pytest.mark.parametrize("f", [grid.grading_histogram, grid.grid_boundary, grid.grid_poincare, grid.tau])
def test_equal_grids_once(spark, monkeypatch, f):
    one = fixtures.grid_table(spark).where("diagram in ('trefoil', 'staircase3')")
    many = one.crossJoin(spark.range(5).withColumnRenamed("id", "k")).select(F.concat("diagram", F.lit("/"), "k").alias("diagram"), "n", "o", "x")
    seen = _counted(spark, monkeypatch, grid, f)
    got = {tuple(r) for r in f(many).collect()}
    assert seen[0].count() == 2
    assert got == {(f"{r[0]}/{k}", *r[1:]) for r in f(one).collect() for k in range(5)}


def test_nulls_and_repeated_names(spark):
    rows = spark.createDataFrame([(1, None), (1, [1]), (None, [1]), (2, [1, 2])], "diagram long, x array<int>")
    got = once(rows, ["x"], lambda d: d.select("diagram", F.size(F.coalesce("x", F.array().cast("array<int>"))).alias("n")))
    assert sorted(map(str, got.collect())) == sorted(f"Row(diagram={d}, n={n})" for d, n in [(1, 0), (1, 1), (None, 1), (2, 2)])
