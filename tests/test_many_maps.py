"""Many small maps at once, and compressed maps that are made where they are, against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow import table_queries
from skeinflow.operators import algebra, csc, packed
from skeinflow.sources import derived, seeded

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(rng, cols, rows, share):
    m = rng.random((cols, rows)) < share
    return np.concatenate(([0], np.cumsum(m.sum(1)))).astype(np.int64), np.nonzero(m)[1], rows


def slices(df):
    return sorted(((r.cx is None, r.cx, r.deg, r.first, r.cols, r.rows, bytes(r.indptr), bytes(r.indices)) for r in df.select(*csc.FIELDS).collect()), key=repr)


# --- F9: kernels and cells -----------------------------------------------------------------------------------------


def test_ranks_of_many():
    rng = np.random.default_rng(3)
    sizes = [(1, 1), (3, 64), (64, 3), (65, 65), (40, 130), (255, 256), (256, 256), (257, 20), (20, 257), (300, 310), (4, 0)] + [tuple(rng.integers(1, 90, 2)) for _ in range(150)]
    maps = [made(rng, cols, rows, share) for cols, rows in sizes for share in (0, 0.02, 0.1, 0.5, 1)]
    # Repeated entries count once, in any order.
    maps.append((np.array([0, 3, 4]), np.array([5, 2, 5, 5]), 6))
    want = [algebra.f2_rank_sets([i[a:b].tolist() for a, b in zip(p[:-1], p[1:], strict=True)]) for p, i, _ in maps]
    for tier in ("sets", "bits", "words", "tables", "sparse"):
        assert csc.many_of(tier)(maps) == want and csc.many_of(tier)([]) == []
    with pytest.raises(RuntimeError, match="numba"):
        csc.many_of("compiled")


@pytest.mark.parametrize("tier", ["words", "tables", "sparse"])
def test_small_maps_are_worked_on_together(tier):
    rng, calls = np.random.default_rng(4), []
    maps = [made(rng, 30, 50, 0.3) for _ in range(400)]
    stacked = csc.STACKED[tier]
    packed.ranks_of_many(maps, lambda m: (calls.append(len(m)), stacked(m))[1], None)
    assert sum(calls) == 400 and len(calls) <= 2


def test_seeded_slices(spark):
    rows = [("x", 7, 40, 50, 0.25), ("y", 8, 5, 5, 0.0), ("z", 9, 5, 4, 1.0), ("no density", 9, 5, 4, None), ("no seed", None, 5, 4, 0.5), ("wide", 2, 4096, 3, 0.5), ("wider", 3, 9000, 2, 0.5), ("tall", 4, 2, 70000, 0.01)]
    m = spark.createDataFrame(rows, "cx string, seed long, cols int, rows int, density double")
    want = csc.from_entries(seeded.shapes(m), seeded.seeded_entries(m)).where("deg = 0")
    got = seeded.seeded_slices(m)
    assert slices(got) == slices(want) and got.dtypes == want.dtypes and seeded.seeded_slices(m.limit(0)).count() == 0
    assert [(r.rows, bytes(r.indices)) for r in seeded.seeded_slices(m.where("cx = 'no seed'").withColumn("cx", F.lit(None).cast("string"))).collect()] == [(4, b"")]
    with pytest.raises(Exception, match="at least 1"):
        seeded.seeded_slices(m.withColumn("rows", F.lit(0))).collect()


def test_seeded_slices_in_portions(monkeypatch):
    shape = [np.array(x) for x in ([0, 4096, 0], [3, 7, 5], [11, 4, 9], [1, 2, 3], [seeded.PRIME // 2] * 3)]
    whole = [x.to_pylist() for x in seeded._made(*shape)]
    for cells in (1, 7, 30, 1000):
        monkeypatch.setattr(seeded, "CELLS", cells)
        assert [x.to_pylist() for x in seeded._made(*shape)] == whole


def test_seeded_matrix_ranks_shuffles_no_cells(spark):
    df = table_queries.seeded_matrix_ranks(spark, SMALL)
    plan = plan_of(df)
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1 and df.rdd.getNumPartitions() >= 4
    assert df.count() == spark.read.parquet(f"{SMALL}/part.parquet").count()


# --- F10: complexes that are made where they are -------------------------------------------------------------------


def by_tables(spark, sf_dir):
    gen, bd = derived.order_complexes(spark, sf_dir)
    return csc.from_entries(gen, csc.odd_entries(bd))


def test_order_sets_span_the_same(spark):
    assert slices(csc.from_simplices(derived.order_sets(spark, SMALL))) == slices(by_tables(spark, SMALL))


def test_order_sets_of_odd_tables(spark, tmp_path):
    """Negative and null nations, orders without lines or customer, lines without order or supplier, a supplier and an order twice."""
    suppliers = [(1, 0), (2, 9), (3, -3), (4, None), (5, 7), (6, -7), (7, 4), (7, 5)]
    orders = [(10, 1), (11, 1), (12, 2), (13, 3), (14, None), (15, 4), (16, 5), (16, 6)]
    lines = [(10, 1), (10, 2), (10, 3), (10, 4), (11, 5), (11, 6), (11, 7), (11, 3), (12, 4), (12, 1), (14, 1), (14, 2), (15, 4), (16, 7), (16, 1), (99, 1), (12, 50)]
    for name, rows, columns in (("supplier", suppliers, "s_suppkey long, s_nationkey int"), ("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_suppkey long")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    want = by_tables(spark, str(tmp_path))
    got = csc.from_simplices(derived.order_sets(spark, str(tmp_path)))
    assert slices(got) == slices(want) and {r.cx for r in got.collect()} == {None, 1, 2, 5, 6}
    assert sorted(map(repr, csc.homology(got, sliced=False).collect())) == sorted(map(repr, csc.homology(want).collect()))


def test_simplices_of_many_vertices(spark, monkeypatch):
    monkeypatch.setattr(csc, "SPANNED", 2)
    sets = spark.createDataFrame([("sphere", [7, 11, 13, 14]), ("points", [1, 1 << 30, 4]), ("edge", [3]), ("none", []), ("zero", [0]), ("full", [(1 << 16) - 1])], "cx string, sets array<int>")
    c = csc.from_simplices(sets.coalesce(1))
    assert {(r.cx, r.deg): r.betti for r in csc.homology(c, sliced=False).collect()} == {("sphere", 0): 1, ("sphere", 2): 1, ("points", 0): 3, ("edge", 0): 1, ("full", 0): 1, ("full", 2): 455}
    assert {(r.cx, r.deg): (r.cols, r.rows, r.entries, r.verdict) for r in csc.map_shapes(c).collect() if r.cx == "full"} == {("full", 0): (16, 120, 240, None), ("full", 1): (120, 560, 1680, None), ("full", 2): (560, 0, 0, None)}


def test_one_slice_each(spark):
    gen = spark.createDataFrame([("b", 0, 5000), ("b", 1, 3)], "cx string, deg int, dim long")
    c = csc.from_entries(gen, spark.createDataFrame([("b", 0, 4999, 1), ("b", 0, 0, 2)], "cx string, deg int, col long, row long"))
    assert {(r.deg, r["rank"]) for r in csc.ranks(c).collect()} == {(0, 2), (1, 0)}
    with pytest.raises(Exception, match="more than one slice"):
        csc.ranks(c, sliced=False).collect()


def test_order_complexes_are_read_once(spark):
    for query in (table_queries.order_complex_homology, table_queries.order_complex_shapes):
        plan = plan_of(query(spark, SMALL))
        assert plan.count("Join") == 2 and plan.count("MapInArrow") == 2 and "Window" not in plan


# --- F28: shapes ---------------------------------------------------------------------------------------------------


def test_map_shapes(spark):
    def slice_of(ptr, idx, *shape):
        return (*shape, *(None if x is None else bytearray(np.array(x, csc.INDEX).tobytes()) for x in (ptr, idx)))

    rows = [("a", 0, *slice_of([0, 1, 3], [0, 1, 1], 0, 2, 2)), ("a", 0, *slice_of([0, 1], [2], 2, 1, 3)), ("a", 1, *slice_of([0, 3], [0, 1, 1], 0, 2, 2)), ("b", 0, *slice_of(None, [], 0, 1, 1)), ("b", 1, *slice_of([0, 0], None, 0, 1, 1)), (None, 0, *slice_of([0, 1], [0], 0, 1, 1))]
    c = spark.createDataFrame(rows, "cx string, deg int, first long, cols long, rows long, indptr binary, indices binary")
    got = {(r.cx, r.deg): (r.cols, r.rows, r.entries, r.verdict) for r in csc.map_shapes(c).collect()}
    bad = "not integers of four bytes"
    assert got == {("a", 0): (3, 3, 4, None), ("a", 1): (2, 2, 3, "indptr has 2 values for 2 columns"), ("b", 0): (1, 1, 0, bad), ("b", 1): (1, 1, None, bad), (None, 0): (1, 1, 1, None)}
    plan = plan_of(csc.map_shapes(c))
    assert "Join" not in plan and plan.count("MapInArrow") == 1
