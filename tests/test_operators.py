"""Laws that hold whatever the diagram, and what is refused."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from skeinflow.operators import algebra, classical, cube, diagrams, grid, khovanov
from skeinflow.plans import contract, placement
from skeinflow.sources import fixtures
from skeinflow.streaming import calibration


def test_torus_knots():
    for n in (3, 7, 15, 25):
        v = classical.seifert_of([1] * n)
        sym = [[v[i][j] + v[j][i] for j in range(n - 1)] for i in range(n - 1)]
        assert (abs(classical.determinant_of(sym)), classical.signature_of(sym)) == (n, 1 - n)
        assert classical.alexander_of(v) == [(-1) ** i for i in range(n)]
    assert classical.alexander_of(classical.seifert_of([1, 2] * 4)) == classical.alexander_of(classical.seifert_of([1, 2, 3] * 3))


def test_alexander_at_minus_one_is_the_determinant():
    rng = random.Random(3)
    for _ in range(60):
        b = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 10))]
        v = classical.seifert_of(b)
        sym = [[v[i][j] + v[j][i] for j in range(len(v))] for i in range(len(v))]
        a = classical.alexander_of(v)
        assert abs(sum(c * (-1) ** i for i, c in enumerate(a))) == abs(classical.determinant_of(sym))
        eig = np.linalg.eigvalsh(np.array(sym, float)) if v else np.zeros(0)
        assert classical.signature_of(sym) == int((eig > 1e-9).sum() - (eig < -1e-9).sum())


def test_empty_forms():
    v = classical.seifert_of([1])
    assert (v, classical.determinant_of(v), classical.signature_of(v), classical.alexander_of(v)) == ([], 1, 0, [1])


def test_rank_tiers_agree():
    rng = random.Random(5)
    for _ in range(40):
        cols = [{r: rng.choice([-2, -1, 1, 2]) for r in range(12) if rng.random() < 0.3} for _ in range(rng.randint(0, 14))]
        masks = [sum(1 << r for r, x in c.items() if x % 2) for c in cols]
        assert algebra.f2_rank(masks) == algebra.f2_rank_sets([r for r, x in c.items() if x % 2] for c in cols)
        assert algebra.rational_rank(cols) == algebra.rank_by_primes(cols)
        basis = algebra.f2_kernel(masks)
        assert len(basis) == len(masks) - algebra.f2_rank(masks)
        for who in basis:
            total = 0
            for i, m in enumerate(masks):
                total ^= m if who >> i & 1 else 0
            assert total == 0


def test_prefix_ranks():
    rng = random.Random(7)
    for _ in range(30):
        rows = [[rng.choice([0, 0, 0, -2, -1, 1, 3]) for _ in range(9)] for _ in range(rng.randint(0, 12))]
        got = algebra.prefix_ranks(np.array(rows, np.int64).reshape(len(rows), 9), algebra.PRIMES[0]).tolist()
        assert got == [algebra.rational_rank([dict(enumerate(r)) for r in rows[:k]]) for k in range(len(rows) + 1)]


def test_kernels_agree_with_tables(spark):
    pds = fixtures.pd_table(spark, {d: fixtures.PD[d] for d in ("3_1", "4_1")} | {"6_2": fixtures.LADDER["6_2"]})
    for tables, batch in ((khovanov.rasmussen_s(pds), khovanov.rasmussen_batch(pds)), (khovanov.khovanov_homology(pds, "q"), khovanov.khovanov_batch(pds, "q"))):
        assert {tuple(r) for r in tables.collect()} == {tuple(r) for r in batch.collect()}


def test_crossings_beyond_a_kernel():
    with pytest.raises(ValueError):
        khovanov.rasmussen_of(fixtures.torus_pd(23))


def test_kernel_and_native_jones_agree(spark):
    pds = fixtures.pd_table(spark, fixtures.PD | {"T(2,9)": fixtures.torus_pd(9)})
    a, b = ({tuple(r) for r in f(pds).collect()} for f in (cube.jones_polynomial, cube.jones_batch))
    assert a == b


def test_khovanov_is_a_complex_and_categorifies_jones(spark):
    pds = fixtures.pd_table(spark)
    _, bd = khovanov.as_complex(pds)
    assert algebra.d_squared(bd, "q").count() == 0
    kh = khovanov.khovanov_homology(pds)
    chi = {(r.diagram, r.j): r.c for r in kh.selectExpr("diagram", "j", "if(pmod(i, 2) = 0, dim, -dim) as x").groupBy("diagram", "j").sum("x").toDF("diagram", "j", "c").where("c <> 0").collect()}
    assert chi == {(r.diagram, r.j): r.chi for r in khovanov.euler_characteristic(pds).collect()}


@pytest.mark.parametrize("field", ["f2", "q"])
def test_khovanov_kernel_agrees(spark, field):
    pds = fixtures.pd_table(spark, fixtures.PD | {"T(2,7)": fixtures.torus_pd(7), "unknot": []})
    assert {tuple(r) for r in khovanov.khovanov_batch(pds, field).collect()} == {tuple(r) for r in khovanov.khovanov_homology(pds, field).collect()}


def test_torus_grids(spark):
    g = fixtures.grid_table(spark, {"T(2,3)": fixtures.torus_grid(2, 3), "T(2,5)": fixtures.torus_grid(2, 5)})
    hfk = {tuple(r) for r in grid.hfk_hat(g).collect()}
    assert {(m, a) for d, m, a, r in hfk if d == "T(2,5)"} == {(0, 2), (-1, 1), (-2, 0), (-3, -1), (-4, -2)}
    assert {r.diagram: r.tau for r in grid.tau(g).collect()} == {"T(2,3)": 1, "T(2,5)": 2}


def test_ranks_of_permutations():
    r = np.arange(720)
    assert (grid.ranked(grid.unranked(r, 6)) == r).all()


def test_markers_become_a_grid(spark):
    cells = [("t", r + 1, c + 1) for r, c in [(0, 4), (0, 1), (1, 3), (1, 0), (2, 2), (2, 4), (3, 1), (3, 3), (4, 0), (4, 2)]]
    g = grid.from_markers(spark.createDataFrame(cells, "diagram string, r int, c int"))
    assert abs(grid.tau(g).first().tau) == 1
    with pytest.raises(PySparkException):
        grid.from_markers(spark.createDataFrame(cells[:-1] + [("t", 1, 1)], "diagram string, r int, c int")).collect()


def test_labels_from_zero(spark):
    zero = {"3_1": [[v - 1 for v in c] for c in fixtures.PD["3_1"]]}
    a, b = (diagrams.seifert_structure(fixtures.pd_table(spark, x)).collect() for x in (zero, {"3_1": fixtures.PD["3_1"]}))
    assert a == b


def test_refusals(spark):
    with pytest.raises(PySparkException):
        classical.braid_invariants(fixtures.braid_table(spark, {"zero": [1, 0]})).collect()
    with pytest.raises(PySparkException):
        grid.grading_histogram(fixtures.grid_table(spark, {"large": fixtures.staircase(11)})).collect()
    with pytest.raises(ValueError):
        algebra.ranks(fixtures.complex_tables(spark)[1], "f3")
    with pytest.raises(ValueError):
        contract.compute(fixtures.pd_table(spark), "volume")
    with pytest.raises(PySparkException):
        contract.compute(fixtures.pd_table(spark), "jones_polynomial", cross_check=False).collect()


def test_contract_covers_all(spark):
    b = contract.compute(fixtures.braid_table(spark).where("diagram = '3_1'"), "signature").first()
    assert (b.value, b.known_answer_check, b.cross_backend_check, b.validated) == ("-2", "not_available", "pass", True)
    assert contract.compute(fixtures.pd_table(spark).where("diagram = '3_1'"), "rasmussen_invariant").first().value == "-2"
    assert contract.compute(fixtures.grid_table(spark).where("diagram = 'trefoil'"), "tau", validate=False).first().value == "1"


def test_cycles(spark):
    jobs = spark.createDataFrame([(x,) for x in "abc"], "job string")
    assert placement.cyclic_jobs(jobs, spark.createDataFrame([("a", "b"), ("b", "c")], "job string, dep string")).count() == 0
    assert {r.job for r in placement.cyclic_jobs(jobs, spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "job string, dep string")).collect()} >= {"a", "b"}


def test_long_chains_are_no_cycles(spark):
    chain = spark.createDataFrame([(f"j{i}", f"j{i + 1}") for i in range(130)], "job string, dep string")
    assert placement.cyclic_jobs(chain.select("job"), chain).count() == 0


def test_what_is_no_complex_raises(spark):
    gen, bd = fixtures.complex_tables(spark)
    for f in (algebra.homology, algebra.gaussian_homology):
        with pytest.raises(PySparkException, match="square"):
            f(gen, bd).collect()
    with pytest.raises(PySparkException, match="negative"):
        algebra.homology(gen, bd, verify=False).collect()
    with pytest.raises(ValueError):
        algebra.gaussian_homology(gen, bd, "f3")


def test_unknot(spark):
    t = fixtures.pd_table(spark, {"u": []})
    assert [tuple(r) for r in cube.jones_polynomial(t).collect()] == [tuple(r) for r in cube.jones_batch(t).collect()] == [("u", 0, 1)]
    assert [tuple(r) for r in khovanov.lee_homology(t).collect()] == [("u", 0, 2)]


def test_determinants_and_modular_ranks():
    rng = random.Random(8)
    for n in range(7):
        m = [[rng.randint(-9, 9) * 10 ** rng.randint(0, 5) for _ in range(n)] for _ in range(n)]
        plain = lambda a: 1 if not a else sum((-1) ** j * a[0][j] * plain([r[:j] + r[j + 1 :] for r in a[1:]]) for j in range(len(a)))
        assert classical.determinant_of(m) == plain(m)
    assert classical.determinant_of([[0, 1], [1, 0]]) == -1 and classical.determinant_of([[1, 2], [2, 4]]) == 0
    for _ in range(60):
        cols = [{r: rng.choice([-3, -1, 1, 2, 5]) for r in range(10) if rng.random() < rng.choice([0.1, 0.4])} for _ in range(rng.randint(0, 12))]
        assert algebra.modular_rank(cols, algebra.PRIMES[0]) == algebra.rational_rank(cols)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i:02d}:00", "gpu" if i % 3 else "cpu", float(i % 4), i / 7) for i in range(40)]
    log = spark.createDataFrame(rows, "t string, placement string, cost double, seconds double").selectExpr("cast(t as timestamp) as ts", "placement", "cost", "seconds")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = calibration.ewma_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    got = {r.placement: (round(r.rate, 9), r.n) for r in spark.table("rates").collect()}
    assert got == {r.placement: (round(r.rate, 9), r.n) for r in calibration.ewma_rates(log).collect()}
