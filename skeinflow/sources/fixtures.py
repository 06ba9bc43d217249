"""Published diagrams and small complexes as literal tables. Fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Planar diagrams: crossings counter-clockwise from the incoming under-strand, labels from 1.
PD = {
    "3_1": [[1, 5, 2, 4], [3, 1, 4, 6], [5, 3, 6, 2]],
    "4_1": [[4, 2, 5, 1], [8, 6, 1, 5], [6, 3, 7, 4], [2, 7, 3, 8]],
    "5_1": [[2, 8, 3, 7], [4, 10, 5, 9], [6, 2, 7, 1], [8, 4, 9, 3], [10, 6, 1, 5]],
    "5_2": [[1, 5, 2, 4], [3, 9, 4, 8], [5, 1, 6, 10], [7, 3, 8, 2], [9, 7, 10, 6]],
}
#: The diagrams that published timings are over: 3 to 8 crossings.
LADDER = {k: PD[k] for k in ("3_1", "4_1", "5_2")} | {
    "6_2": [[1, 8, 2, 9], [3, 11, 4, 10], [5, 1, 6, 12], [7, 2, 8, 3], [9, 7, 10, 6], [11, 5, 12, 4]],
    "7_4": [[2, 10, 3, 9], [4, 12, 5, 11], [6, 14, 7, 13], [8, 4, 9, 3], [10, 2, 11, 1], [12, 8, 13, 7], [14, 6, 1, 5]],
    "8_19": [[4, 2, 5, 1], [8, 4, 9, 3], [9, 15, 10, 14], [5, 13, 6, 12], [13, 7, 14, 6], [11, 1, 12, 16], [15, 11, 16, 10], [2, 8, 3, 7]],
}
BRAIDS = {"3_1": [1, 1, 1], "4_1": [1, -2, 1, -2], "5_1": [1] * 5, "T(2,7)": [1] * 7, "T(2,15)": [1] * 15, "T(2,25)": [1] * 25, "T(3,4)": [1, 2] * 4, "T(4,3)": [1, 2, 3] * 3, "T(4,5)": [1, 2, 3] * 5, "T(5,4)": [1, 2, 3, 4] * 4}
#: Grids: the column of the O and of the X in each row.
GRIDS = {
    "staircase3": ([0, 1, 2], [1, 2, 0]),
    "staircase4": ([0, 1, 2, 3], [1, 2, 3, 0]),
    "trefoil": ([4, 3, 2, 1, 0], [1, 0, 4, 3, 2]),
    "trefoil mirror": ([0, 1, 2, 3, 4], [2, 3, 4, 0, 1]),
    "figure-eight": ([3, 2, 0, 1, 4, 5], [1, 4, 3, 5, 0, 2]),
}
#: F2 complexes: dimensions by degree, and the boundary's entries (degree, column, row).
COMPLEXES = {
    "acyclic": ({0: 1, 1: 2, 2: 1}, [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 1, 0)]),
    "not a complex": ({0: 1, 1: 1, 2: 1}, [(0, 0, 0), (1, 0, 0)]),
    "merge": ({0: 2, 1: 1}, [(0, 0, 0)]),
    "circle": ({0: 1, 1: 1}, []),
}
#: Rational complexes: entries (degree, column, row, value).
COMPLEXES_Q = {
    "times two": ({0: 1, 1: 1}, [(0, 0, 0, 2)]),
    "signed": ({0: 1, 1: 2, 2: 1}, [(0, 0, 0, 1), (0, 0, 1, 1), (1, 0, 0, 1), (1, 1, 0, -1)]),
}
#: Names as tables write them.
NAMES = ["K11n34", "11a12", "10_124", " 3_1 ", "K12a1", "11n_34", ""]
#: Integral Khovanov vectors: (torsion, multiplicity, i, j); the trefoil's has one Z/2.
KH_VECTORS = {"3_1 mirror": "{{0,1,0,1};{0,1,0,3};{0,1,2,5};{0,1,3,9};{2,1,3,7}}", "unknot": "{{0,1,0,-1};{0,1,0,1}}"}
LAURENT = {"trefoil": "t + t^3 - t^4", "figure-eight": "t^-2 - t^-1 + 1 - t + t^2", "5_2": "t-t^2+2*t^3-t^4+t^5-t^6", "zero": "0"}
KH_POLYNOMIALS = {"3_1": "q + q^3 + t^2 q^5 + t^3 q^9", "torsion": "t^3 q^7", "multiple": "2 t^-1 q^-3 + q^-1"}
CPULISTS = {"a": "0-3,8", "b": "5", "c": "0-1,4-5,4", "d": ""}


def torus_pd(n: int) -> list[list[int]]:
    """T(2, n), n odd: crossings [a, a + n + 1, a + 1, a + n] for a = 1, 3, ..., labels modulo 2n in 1 ... 2n."""
    wrap = lambda x: (x - 1) % (2 * n) + 1
    return [[wrap(a), wrap(a + n + 1), wrap(a + 1), wrap(a + n)] for a in range(1, 2 * n, 2)]


def torus_grid(p: int, q: int) -> tuple[list[int], list[int]]:
    """T(p, q) on a grid of p + q rows."""
    n = p + q
    return list(range(n))[::-1], [(i + p) % n for i in range(n)][::-1]


def staircase(n: int) -> tuple[list[int], list[int]]:
    """The unknot on n rows: O on the diagonal, X one to the right."""
    if n < 2:
        raise ValueError("a staircase has two rows or more")
    return list(range(n)), [(i + 1) % n for i in range(n)]


def pd_table(spark: SparkSession, diagrams: dict | None = None) -> DataFrame:
    """(diagram, pd array<array<int>>)."""
    return spark.createDataFrame(list((diagrams or PD).items()), "diagram string, pd array<array<int>>")


def braid_table(spark: SparkSession, braids: dict | None = None) -> DataFrame:
    return spark.createDataFrame(list((braids or BRAIDS).items()), "diagram string, braid array<int>")


def grid_table(spark: SparkSession, grids: dict | None = None) -> DataFrame:
    return spark.createDataFrame([(k, len(o), o, x) for k, (o, x) in (grids or GRIDS).items()], "diagram string, n int, o array<int>, x array<int>")


def complex_tables(spark: SparkSession, complexes: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(gen(cx, deg, dim), bd(cx, deg, col, row, v)): value 1 in F2."""
    c = complexes or COMPLEXES
    gen = [(k, d, n) for k, (dims, _) in c.items() for d, n in dims.items()]
    bd = [(k, *e[:3], e[3] if len(e) > 3 else 1) for k, (_, entries) in c.items() for e in entries]
    return spark.createDataFrame(gen, "cx string, deg int, dim long"), spark.createDataFrame(bd, "cx string, deg int, col long, row long, v long")


def text_table(spark: SparkSession, rows: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows.items()), "diagram string, text string")


def values(rows: list[tuple], names: str) -> str:
    """The rows as SQL: (select * from (values ...) t(names))."""

    def lit(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return f"(select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names}))"
