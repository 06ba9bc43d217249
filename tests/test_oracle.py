"""The table of known values, on two rows of it."""

import pytest
from pyspark.errors import PySparkException

from skeinflow.operators import grid
from skeinflow.plans import contract
from skeinflow.sources import fixtures, oracle

COLUMNS = ["name", "determinant", "signature", "alexander_polynomial_vector", "jones_polynomial_vector", "khovanov_unreduced_integral_vector", "rasmussen_invariant", "pd_notation", "braid_notation", "grid_notation", "hfk_polynomial_vector", "ozsvath_szabo_tau_invariant", "three_genus"]
ROWS = [
    ("Name", *["text"] * 12),
    ("3_1", "3", "-2", "{0, 2, 1, -1, 1}", "{1, 4, 1, 0, 1, -1}", fixtures.KH_VECTORS["3_1 mirror"], "2", str(fixtures.PD["3_1"]).replace(" ", ""), "{1,1,1}", "[[1,5],[1,2],[2,4],[2,1],[3,3],[3,5],[4,2],[4,4],[5,1],[5,3]]", "[1,1,0;1,0,-1;1,-1,-2]", "1", "1"),
    ("11n_34", "1", "", "does not exist", None, "", "", "", "{{1,2,-3}}", "", "", "", ""),
    ("", *[""] * 12),
]


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.createDataFrame(ROWS, ", ".join(f"{c} string" for c in COLUMNS))
    return table, oracle.looked_up(table, spark.createDataFrame([("3_1",), ("K11n34",)], "diagram string"))


def test_look_up(spark, rows):
    table, found = rows
    assert {r.name for r in oracle.known_rows(table).collect()} == {"3_1", "11n_34"}
    assert {r.diagram: r.name for r in found.collect()} == {"3_1": "3_1", "K11n34": "11n_34"}
    with pytest.raises(PySparkException):
        oracle.looked_up(table, spark.createDataFrame([("9_99",)], "diagram string")).collect()
    assert [tuple(r) for r in oracle.floer_roster(table, 8).collect()] == [("3_1", 5)] and oracle.floer_roster(table, 4).count() == 0


def test_notations(rows):
    one = rows[1].where("diagram = '3_1'")
    assert oracle.pd_codes(one).first().pd == fixtures.PD["3_1"]
    assert oracle.braid_words(rows[1]).where("diagram = 'K11n34'").first().braid == [1, 2, -3]
    g = grid.from_markers(oracle.grid_markers(one))
    assert {(r.m, r.a, r["rank"]) for r in oracle.hfk_ranks(one).collect()} == {(0, 1, 1), (-1, 0, 1), (-2, -1, 1)}
    assert (oracle.tau_values(one).first().tau, abs(grid.tau(g).first().tau)) == (1, 1)


@pytest.mark.parametrize("name", ["determinant", "signature", "alexander_polynomial", "jones_polynomial", "khovanov_homology", "rasmussen_s", "volume"])
def test_known_answers_validate(spark, rows, name):
    known = oracle.known_answers(rows[1], name)
    values = {r.diagram: r.value for r in known.collect()}
    assert name == "determinant" or values["K11n34"] is None
    if name == "volume":
        assert values["3_1"] is None
    else:
        table = fixtures.braid_table(spark) if name in ("determinant", "signature", "alexander_polynomial") else fixtures.pd_table(spark)
        got = contract.compute(table.where("diagram = '3_1'"), name, known, validate=True).first()
        assert (got.known_answer_check, got.validated) == ("pass", True)
