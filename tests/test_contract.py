"""The result contract, second algorithms, refusals, isolated failures, run reports, predicted times and knot tables in files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.operators import algebra, classical, cube, diagrams, grid, khovanov, second
from skeinflow.plans import contract, isolation
from skeinflow.sources import fixtures, knot_table
from skeinflow.streaming import calibration

# --- second algorithms ---------------------------------------------------------------------------------------------


def test_frontier_and_cube():
    codes = [*fixtures.PD.values(), *fixtures.LADDER.values(), [], [[1, 2, 2, 1]], *(fixtures.torus_pd(n) for n in (3, 7, 11))]
    for code in codes:
        assert second.jones_by_frontier(code) == cube.jones_of(code, False)
    for code in ([[0, 4, 1, 3], [2, 0, 3, 5], [4, 2, 5, 1]], fixtures.PD["3_1"][::-1]):
        assert second.jones_by_frontier(code) == cube.jones_of(fixtures.PD["3_1"], False)
    long = second.jones_by_frontier(fixtures.torus_pd(101))
    assert len(long) == 101 and long[50] == 1 and set(long.values()) == {1, -1}
    with pytest.raises(ValueError):
        second.bracket_by_frontier([[1, 2, 3, 4]])


def test_burau_and_eigenvalues():
    rng = random.Random(4)
    words = [*fixtures.BRAIDS.values(), *([rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(1, 10))] for _ in range(60))]
    seen = set()
    for w in words:
        v = classical.seifert_of(w)
        a = classical.alexander_of(v)
        agrees = second.alexander_agrees(w, a)
        seen.add(agrees)
        assert agrees is not False and second.signature_by_eigenvalues(w) == classical.signature_of([[v[i][j] + v[j][i] for j in range(len(v))] for i in range(len(v))])
        if agrees and a != [0]:
            assert not second.alexander_agrees(w, [*a, 1]) and not second.alexander_agrees(w, [a[0] + 1, *a[1:]])
    assert seen == {True, None}


def test_jones_without_bound(spark):
    got = second.jones_frontier_batch(fixtures.pd_table(spark, {"t": fixtures.torus_pd(41)})).collect()
    assert {(r.exp, r.coef) for r in got} == {(20 + k, "1" if k % 2 == 0 else "-1") for k in range(42) if k != 1}


# --- the contract --------------------------------------------------------------------------------------------------


def test_every_invariant_has_its_provenance(spark):
    for name, (column, method, other) in contract.METHODS.items():
        table = {"braid": fixtures.braid_table, "pd": fixtures.pd_table, "n, o, x": fixtures.grid_table}[column](spark).where("diagram in ('3_1', 'trefoil')")
        r = contract.compute(table, name, validate=other is not None).first()
        assert (r.method, r.backend, r.cross_backend_check, r.validated) == (method, "spark", "pass" if other else "not_available", other is not None)
        assert r.version and r.inputs.startswith("{") and r.d_squared_check == ("pass" if "khovanov" in name else "not_applicable")
    with pytest.raises(Exception, match="not validated"):
        contract.compute(fixtures.grid_table(spark), "tau").collect()


def test_cross_checks_fail(spark):
    pds, braids, grids = fixtures.pd_table(spark).where("diagram = '3_1'"), fixtures.braid_table(spark).where("diagram = '3_1'"), fixtures.grid_table(spark).where("diagram = 'trefoil'")
    wrong = {"determinant": (braids, "5"), "signature": (braids, "2"), "alexander_polynomial": (braids, "[1,-3,1]"), "jones_polynomial": (pds, "[[0,1]]"), "khovanov_homology": (pds, "[[0,1,1],[0,-1,1]]"), "rasmussen_s": (pds, "2"), "hfk_hat": (grids, "[[0,0,1]]")}
    for name, (objects, value) in wrong.items():
        got = objects.select("diagram", F.lit(value).alias("value"))
        cross = contract.cross_checked(objects, got, name)
        assert [r.agrees for r in cross.collect()] == [False], name
        r = contract.finalized(got, name, got, cross=cross).first()
        # A known answer does not outweigh a second algorithm.
        assert (r.known_answer_check, r.cross_backend_check, r.validated) == ("pass", "fail", False)


def test_known_twice(spark):
    got = spark.createDataFrame([("a", "1"), ("b", "2")], "diagram string, value string")
    known = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "3"), ("c", None), ("b", None)], "diagram string, value string")
    assert sorted((r.diagram, r.known_answer_check) for r in contract.finalized(got, "x", known).collect()) == [("a", "pass"), ("b", "fail")]
    with pytest.raises(Exception, match="two known values of a"):
        contract.finalized(got, "x", known.union(spark.createDataFrame([("a", "9")], known.schema))).collect()


def test_verdicts_keep_all(spark):
    s = "diagram string, i int, j int, dim long"
    a = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 2, 1), ("z", 0, 0, 0), ("z", 1, 1, 1)], s)
    o = spark.createDataFrame([("a", 1, 1, 1), ("c", 1, 2, 1), ("z", 1, 1, 1)], s)
    assert {r.diagram: r.verdict for r in contract.verdicts(a, o).collect()} == {"a": "pass", "b": "mismatch", "c": "mismatch", "z": "pass"}


def test_integers_of_any_length(spark):
    assert classical.braid_determinants(fixtures.braid_table(spark, {"x": [1, -2] * 60})).first().determinant == str(lucas(120) - 2)
    with pytest.raises(Exception, match="64 bits"):
        classical.braid_invariants(fixtures.braid_table(spark, {"x": [1, -2] * 47})).collect()
    r = classical.braid_texts(fixtures.braid_table(spark, {"x": [1, -2] * 10})).first()
    assert r.determinant == str(lucas(20) - 2) and len(r.alexander) == 19
    texts = ["0", "-0", "7", "-7", "10", "-10", "9" * 30, "-" + "9" * 30, "1" + "0" * 30, "007", "+7"]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in pairs.select("a", "b", classical.compared_integers(F.col("a"), F.col("b")).alias("c")).collect():
        assert r.c == (int(r.a) > int(r.b)) - (int(r.a) < int(r.b)), (r.a, r.b)


def lucas(n):
    a, b = 2, 1
    for _ in range(n):
        a, b = b, a + b
    return a


# --- refusals ------------------------------------------------------------------------------------------------------

BAD_PDS = {"gap": [[1, 5, 2, 4], [3, 1, 4, 7], [5, 3, 7, 2]], "short": [[1, 2, 3]], "two": [[2, 3, 3, 2]], "strand": [[1, 3, 2, 4], [3, 1, 4, 2]]}


@pytest.mark.parametrize("name", BAD_PDS)
def test_engines_refuse_codes(spark, name):
    t = fixtures.pd_table(spark, {name: BAD_PDS[name]})
    for f in (cube.jones_polynomial, cube.kauffman_bracket, cube.state_histogram, khovanov.chain_dimensions, khovanov.khovanov_homology, khovanov.unreduced_size):
        with pytest.raises(Exception, match=f"diagram {name}"):
            f(t).collect()


def test_codes_that_are_fine(spark):
    t = fixtures.pd_table(spark, fixtures.PD | {"zero": [[0, 4, 1, 3], [2, 0, 3, 5], [4, 2, 5, 1]], "curl": [[1, 2, 2, 1]], "none": []})
    assert diagrams.checked(t).count() == len(fixtures.PD) + 3
    assert {(r.exp, r.coef) for r in cube.jones_polynomial(t.where("diagram = 'curl'")).collect()} == {(0, 1)}
    with pytest.raises(Exception, match="null"):
        diagrams.checked(spark.createDataFrame([("x", None)], t.schema)).collect()
    with pytest.raises(Exception, match="at most 24"):
        cube.state_histogram(fixtures.pd_table(spark, {"large": fixtures.torus_pd(25)})).collect()


@pytest.mark.parametrize("o, x", [([0, 0, 1], [1, 2, 0]), ([0, 1, 2], [0, 2, 1]), ([0, 1], [1, 0, 2]), (None, [0, 1])])
def test_engines_refuse_grids(spark, o, x):
    g = spark.createDataFrame([("bad", 3, o, x)], "diagram string, n int, o array<int>, x array<int>")
    for f in (grid.grading_histogram, grid.grid_poincare, grid.tau, grid.hfk_hat, grid.alexander_euler):
        with pytest.raises(Exception, match="grid bad"):
            f(g).collect()


def test_hfk_with_nothing_left_raises(spark, monkeypatch):
    # Homology that ends too early: the quotient is cut to nothing.
    one = spark.createDataFrame([("trefoil", 0, 0, 1)], "diagram string, m int, a int, dim long")
    monkeypatch.setattr(grid, "grid_poincare", lambda g: one)
    with pytest.raises(Exception, match="remainder"):
        grid.hfk_hat(fixtures.grid_table(spark).where("diagram = 'trefoil'")).collect()


def test_square_is_checked():
    i, j, (src, dst, sign) = khovanov.complex_of(fixtures.LADDER["7_4"])
    khovanov.check_square(src, dst, sign, len(i))
    for at in (0, len(src) // 2, len(src) - 1):
        wrong = sign.copy()
        wrong[at] *= -1
        with pytest.raises(ArithmeticError):
            khovanov.check_square(src, dst, wrong, len(i))


def test_square_is_checked_by_tables(spark):
    gen, bd = fixtures.complex_tables(spark)
    assert {r.cx for r in khovanov.square_gaps(bd).collect()} == {"not a complex", "acyclic"}  # over the integers 1 + 1 is no zero
    gen, bd = fixtures.complex_tables(spark, fixtures.COMPLEXES_Q)
    assert khovanov.square_gaps(bd).count() == 0
    t = fixtures.pd_table(spark)
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(khovanov.khovanov_homology(t)) == same(khovanov.khovanov_batch(t))
    assert same(khovanov.khovanov_homology(t, "q", verify=False)) == same(khovanov.khovanov_batch(t, "q"))
    with pytest.raises(Exception, match="crossings"):
        khovanov.khovanov_homology(fixtures.pd_table(spark, {"large": fixtures.torus_pd(21)})).collect()


def test_repeated_entries_are_added(spark):
    bd = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 0, 0, 0, 1), ("a", 0, 1, 0, 2), ("a", 0, 1, 0, -1)], "cx string, deg int, col long, row long, v long")
    for field, rank in (("f2", 1), ("f2_bits", 1), ("f2_sets", 1), ("q", 1), ("q_modular", 1)):
        assert algebra.ranks(bd, field).first()["rank"] == rank
    for field, rank in (("f2", 0), ("q", 1)):
        assert algebra.ranks(bd.where("col = 0"), field).first()["rank"] == rank


def test_large_grids_agree(spark):
    """Seven rows, in several spans: homology of T(2,5) and T(3,4), and their tau."""
    g = fixtures.grid_table(spark, {"T(2,5)": fixtures.torus_grid(2, 5), "T(3,4)": fixtures.torus_grid(3, 4)})
    assert {(r.m, r.a, r["rank"]) for r in grid.hfk_hat(g).where("diagram = 'T(3,4)'").collect()} == {(0, 3, 1), (-1, 2, 1), (-2, 0, 1), (-5, -2, 1), (-6, -3, 1)}
    assert {r.diagram: r.tau for r in grid.tau(g).collect()} == {"T(2,5)": 2, "T(3,4)": 3}


def test_permutations(spark):
    r = spark.createDataFrame([(i, 4 + i % 3, i % 24) for i in range(80)], "diagram long, n int, rank long")
    assert sorted(map(tuple, grid.ranks_of(grid.states_of(r)).select("diagram", "n", "rank").collect())) == sorted(map(tuple, r.collect()))
    for bad in ((1, 3, 6), (1, 3, -1)):
        with pytest.raises(Exception):
            grid.states_of(spark.createDataFrame([bad], r.schema)).collect()


# --- failures, reports, predictions --------------------------------------------------------------------------------


def test_one_bad_diagram_in_a_thousand(spark):
    good = fixtures.PD["4_1"]
    rows = [(str(i), good) for i in range(1000)]
    rows[500] = ("500", BAD_PDS["gap"])
    t = spark.createDataFrame([*rows, ("null", None), ("large", fixtures.torus_pd(25))], "diagram string, pd array<array<int>>")
    for name, n in (("jones_by_cube", 5), ("khovanov_homology", 10)):
        report = isolation.reported(isolation.attempted(t, name))
        got = report.rows.collect()
        failed = {r.diagram: r.error for r in got if r.error}
        assert set(failed) == {"500", "null", "large"} and len(got) == 999 * n + 3 and "crossings" in failed["large"]
        assert report.counts() == {"rows": 999 * n + 3, "results": 999 * n, "failures": 3, "refused": 3, "broken": 0, "error_chars": sum(map(len, failed.values()))}
    assert isolation.attempted(t, "jones_polynomial").where("error is not null").count() == 2
    with pytest.raises(ValueError):
        isolation.attempted(t, "volume")


@pytest.mark.parametrize("name", list(isolation._invariants()))
def test_attempts_agree_with_engines(spark, name):
    column = isolation._invariants()[name][0]
    t = {"pd": fixtures.pd_table, "braid": fixtures.braid_table}[column](spark)
    bad = spark.createDataFrame([("bad", [] if column == "braid" else [[1, 2]])], t.schema)
    got = isolation.attempted(t.union(bad), name).collect()
    assert [r.diagram for r in got if r.error] == ["bad"] and {r.diagram for r in got} == {"bad", *(r.diagram for r in t.collect())}
    assert isolation.attempted(t.limit(0), name).count() == 0


def test_broken_is_not_refused(spark):
    rows = spark.createDataFrame([("a", None), ("b", "ValueError: x"), ("c", "ArithmeticError: y"), ("d", "TypeError: z")], "diagram string, error string")
    r = isolation.reported(rows)
    assert r.rows.count() == 4 and r.counts() == {"rows": 4, "results": 1, "failures": 3, "refused": 1, "broken": 2, "error_chars": 13 + 18 + 12}
    assert isolation.reported(rows.limit(0)).rows.count() == 0


def test_abandoned_components(spark):
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("f", "e"), ("g", "h")], "job string, dep string")
    failed = spark.createDataFrame([("b",), ("e",), ("e",), ("alone",), (None,)], "job string")
    got = {r.job: r.status for r in isolation.abandoned(needs, failed).collect()}
    assert got == {"a": "abandoned", "b": "failed", "c": "abandoned", "d": "abandoned", "e": "failed", "f": "abandoned", "g": "open", "h": "open", "alone": "failed"}
    jobs = spark.createDataFrame([(x,) for x in ("a", "g", "h", "other", "alone")], "job string")
    assert sorted(r.job for r in isolation.runnable(jobs, needs, failed).collect()) == ["g", "h", "other"]
    assert {r.status for r in isolation.abandoned(needs, failed.limit(0)).collect()} == {"open"}


def test_predictions(spark):
    jobs = spark.createDataFrame([("a", "cpu", 2.0), ("b", "gpu", 2.0), ("c", "cpu", 0.0), ("d", "cpu", None), ("e", None, 1.0)], "job string, placement string, cost double")
    rates = spark.createDataFrame([("cpu", 1.5, 3)], "placement string, rate double, n long")
    assert {r.job: r.seconds for r in calibration.predicted_times(jobs, rates).collect()} == {"a": 3.0, "b": None, "c": None, "d": None, "e": None}
    assert {r.seconds for r in calibration.predicted_times(jobs, rates.limit(0)).collect()} == {None}
    with pytest.raises(Exception, match="two rates"):
        calibration.predicted_times(jobs, rates.union(rates)).collect()


def test_predictions_of_a_stream(spark, tmp_path):
    rows = [(f"2026-01-01 00:00:{i:02d}", "cpu" if i % 3 else "gpu", 1.0 + i, 2.0 * i + 1) for i in range(20)]
    log = spark.createDataFrame(rows, "t string, placement string, cost double, seconds double").select(F.to_timestamp("t").alias("ts"), "placement", "cost", "seconds")
    jobs = spark.createDataFrame([("a", "cpu", 2.0), ("b", "gpu", 3.0), ("c", "tpu", 1.0)], "job string, placement string, cost double")
    for part in (0, 1):
        log.where(F.second("ts") < 10 if part == 0 else F.second("ts") >= 10).coalesce(1).write.parquet(f"{tmp_path}/log{part}")
    import os
    import shutil

    os.makedirs(f"{tmp_path}/in")
    q = calibration.predicted_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), jobs).writeStream.outputMode("update").format("memory").queryName("predicted").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for part in (0, 1):
            for f in os.listdir(f"{tmp_path}/log{part}"):
                if f.endswith(".parquet"):
                    shutil.copy(f"{tmp_path}/log{part}/{f}", f"{tmp_path}/in/{part}-{f}")
            q.processAllAvailable()
    finally:
        q.stop()
    want = {r.job: r.seconds for r in calibration.predicted_times(jobs, calibration.ewma_rates(log)).collect()}
    last = {r.job: r.seconds for r in spark.sql("select job, max_by(seconds, n) as seconds from predicted group by job").collect()}
    assert last.keys() == {"a", "b"} and want["c"] is None
    assert all(abs(last[j] - want[j]) < 1e-9 for j in last)


# --- knot tables in files ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def knots(spark, tmp_path_factory):
    rows = spark.range(0, 300, 1, 3).select(F.concat(F.lit("k"), "id").alias("name"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("[[1,5,2,4]] é "), "id")).alias("pd_notation"), F.lit(" x ").alias("z"))
    path = f"{tmp_path_factory.mktemp('knots')}/table"
    head = spark.createDataFrame([("Name", "PD notation", "Z")], "name string, pd_notation string, z string")
    knot_table.written(rows.union(head), path)
    return rows, path


@pytest.mark.parametrize("size", [4 << 20, 997, 211])
def test_lines_of_any_range(spark, knots, size):
    rows, path = knots
    t = knot_table.knot_table(spark, path, size)
    assert sorted(map(tuple, t.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str) and t.rdd.getNumPartitions() >= (3 if size > 997 else 10)


def test_names_are_picked_by_the_scan(spark, knots):
    _, path = knots
    t = knot_table.knot_table(spark, f"file://{path}", 997)
    q = t.where("name = 'k7'").select("pd_notation")
    assert [r.pd_notation for r in q.collect()] == ["[[1,5,2,4]] é 7"] and "Filter (" not in q._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.name for r in t.where("name in ('k1', 'k2', 'no') and z = ' x '").collect()) == ["k1", "k2"]
    assert t.where("name = 'k1' and name = 'k2'").count() == 0 and t.where("name like 'k29%'").count() == 11
    assert t.where("pd_notation is null").count() == 100


def test_tables_that_are_none(spark, tmp_path):
    with pytest.raises(Exception, match="no knot table"):
        knot_table.knot_table(spark, f"{tmp_path}/nothing").collect()
    for name, text in (("twice", "name|a|a\n"), ("unnamed", "a|b\n"), ("ragged", "name|a\nx|1\ny\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="header|cells"):
            knot_table.knot_table(spark, f"{tmp_path}/{name}").collect()
    (tmp_path / "crlf").write_text("name|a\r\nx|1\r\n\r\ny|\r\n")
    assert [tuple(r) for r in knot_table.knot_table(spark, f"{tmp_path}/crlf").orderBy("name").collect()] == [("x", "1"), ("y", None)]
    with pytest.raises(Exception, match="separator"):
        knot_table.written(spark.createDataFrame([("a|b",)], "name string"), f"{tmp_path}/bad")


def test_kernels_by_entries():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        col, row, v = rng.integers(0, 8, n), rng.integers(0, 7, n), rng.integers(-3, 4, n)
        c, r, x = algebra.summed(col, row, v)
        assert len(set(zip(c.tolist(), r.tolist(), strict=True))) == len(c) and x.sum() == v.sum()
        assert algebra.KERNELS["q"](c, r, x) == algebra.KERNELS["q_modular"](c, r, x)
        assert algebra.KERNELS["f2"](c, r, x) == algebra.KERNELS["f2_bits"](c, r, x) == algebra.KERNELS["f2_sets"](c, r, x)
