"""Queries of the library by name, with the SQL that DuckDB checks them against.

Fixture queries are checked against published values, as SQL VALUES; those over the driver's tables against SQL written
from the definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions import text
from skeinflow.operators import algebra, classical, cube, diagrams, grid, khovanov
from skeinflow.plans import agreement, contract, cost, placement
from skeinflow.sources import derived, fixtures
from skeinflow.sources.fixtures import values
from skeinflow.streaming import calibration

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None, names=None, key: str = "diagram", table: str = "supplier") -> Callable[[Query], Query]:
    """names: the objects that sql speaks of, which the query deals to the rows of a table; see derived.dealt()."""

    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = derived.dealt_sql(sql, names, key, table) if names is not None else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.canonical(cube.jones_polynomial(fixtures.pd_table(spark)))


# Published results for the fixtures.
HISTOGRAM = [("3_1", 0, 3, 1), ("3_1", 1, 2, 3), ("3_1", 2, 1, 3), ("3_1", 3, 2, 1), ("4_1", 0, 3, 1), ("4_1", 1, 2, 4), ("4_1", 2, 1, 5), ("4_1", 2, 3, 1), ("4_1", 3, 2, 4), ("4_1", 4, 3, 1), ("5_1", 0, 5, 1), ("5_1", 1, 4, 5), ("5_1", 2, 3, 10), ("5_1", 3, 2, 10), ("5_1", 4, 1, 5), ("5_1", 5, 2, 1), ("5_2", 0, 3, 1), ("5_2", 1, 2, 5), ("5_2", 2, 1, 7), ("5_2", 2, 3, 3), ("5_2", 3, 2, 9), ("5_2", 3, 4, 1), ("5_2", 4, 3, 5), ("5_2", 5, 4, 1)]
JONES = {"3_1": (1, [1, 0, 1, -1]), "4_1": (-2, [1, -1, 1, -1, 1]), "5_1": (2, [1, 0, 1, -1, 1, -1]), "5_2": (1, [1, -1, 2, -1, 1, -1])}
STRUCTURE = [("3_1", 3, 2, -3, 1, 0, 3), ("4_1", 4, 3, 0, 1, 2, 2), ("5_1", 5, 2, -5, 2, 0, 5), ("5_2", 5, 4, -5, 1, 0, 5)]
KHOVANOV = {
    "3_1": [(-3, -9), (-3, -7), (-2, -7), (-2, -5), (0, -3), (0, -1)],
    "4_1": [(-2, -5), (-2, -3), (-1, -3), (-1, -1), (0, -1), (0, 1), (1, 1), (1, 3), (2, 3), (2, 5)],
    "5_1": [(-5, -15), (-5, -13), (-4, -13), (-4, -11), (-3, -11), (-3, -9), (-2, -9), (-2, -7), (0, -5), (0, -3)],
    "5_2": [(-5, -13), (-5, -11), (-4, -11), (-4, -9), (-3, -9), (-3, -7), (-2, -7), (-2, -7), (-2, -5), (-2, -5), (-1, -5), (-1, -3), (0, -3), (0, -1)],
}
KHOVANOV_Q = {"3_1": [(-3, -9), (-2, -5), (0, -3), (0, -1)], "4_1": [(-2, -5), (-1, -1), (0, -1), (0, 1), (1, 1), (2, 5)], "5_1": [(-5, -15), (-4, -11), (-3, -11), (-2, -7), (0, -5), (0, -3)], "5_2": [(-5, -13), (-4, -9), (-3, -9), (-2, -7), (-2, -5), (-1, -3), (0, -3), (0, -1)]}
BRAID_VALUES = [("3_1", 2, 3, -2, [1, -1, 1]), ("4_1", 2, 5, 0, [1, -3, 1]), ("5_1", 4, 5, -4, [1, -1] * 2 + [1]), ("T(2,7)", 6, 7, -6, [1, -1] * 3 + [1]), ("T(2,15)", 14, 15, -14, [1, -1] * 7 + [1]), ("T(2,25)", 24, 25, -24, [1, -1] * 12 + [1]), ("T(3,4)", 6, 3, -6, [1, -1, 0, 1, 0, -1, 1]), ("T(4,3)", 6, 3, -6, [1, -1, 0, 1, 0, -1, 1]), ("T(4,5)", 12, 5, -8, [1, -1, 0, 0, 1, 0, -1, 0, 1, 0, 0, -1, 1]), ("T(5,4)", 12, 5, -8, [1, -1, 0, 0, 1, 0, -1, 0, 1, 0, 0, -1, 1])]
STAIRCASE4 = [("staircase4", -3, -3, 1), ("staircase4", -2, -2, 6), ("staircase4", -1, -2, 4), ("staircase4", -1, -1, 6), ("staircase4", 0, -2, 1), ("staircase4", 0, -1, 4), ("staircase4", 0, 0, 1), ("staircase4", 1, -1, 1)]
HFK = [("staircase3", 0, 0, 1), ("staircase4", 0, 0, 1), ("trefoil", 0, 1, 1), ("trefoil", -1, 0, 1), ("trefoil", -2, -1, 1), ("trefoil mirror", 2, 1, 1), ("trefoil mirror", 1, 0, 1), ("trefoil mirror", 0, -1, 1), ("figure-eight", 1, 1, 1), ("figure-eight", 0, 0, 3), ("figure-eight", -1, -1, 1)]


def counted(table: dict[str, list[tuple]]) -> list[tuple]:
    return [(d, *c, cells.count(c)) for d, cells in table.items() for c in dict.fromkeys(cells)]


def _pds(spark, sf_dir, pds=None, table="supplier"):
    pds = fixtures.PD if pds is None else pds
    return derived.turned_diagrams(derived.dealt(spark, sf_dir, fixtures.pd_table(spark, pds), list(pds), table=table))


def _braids(spark, sf_dir, table="customer"):
    return derived.turned_braids(derived.dealt(spark, sf_dir, fixtures.braid_table(spark), list(fixtures.BRAIDS), table=table))


def _complex(spark, sf_dir, complexes):
    """(gen, bd) of complexes, dealt."""
    gen, bd = fixtures.complex_tables(spark, complexes)
    return derived.dealt(spark, sf_dir, gen, list(complexes), "cx").drop("turn"), derived.dealt(spark, sf_dir, bd, list(complexes), "cx").drop("turn")


def typed(rows: list[tuple], names: str, kinds: str) -> str:
    cols = ", ".join(f"{n}::{k} as {n}" for n, k in zip(names.split(", "), kinds.split(), strict=True))
    return f"select {cols} from {values(rows, names)}"


# --- diagrams ------------------------------------------------------------------------------------------------------

BAD = {"empty": [], "short": [[1, 2, 3]], "gap": [[1, 5, 2, 4], [3, 1, 4, 7], [5, 3, 7, 2]], "from 2": [[2, 3, 3, 2]], "from 0": [[0, 4, 1, 3], [2, 0, 3, 5], [4, 2, 5, 1]]}


@register(typed([(d, None) for d in fixtures.PD] + [("empty", "empty"), ("short", "a crossing has four labels"), ("gap", "each label occurs twice, without gaps"), ("from 2", "labels begin at 0 or 1"), ("from 0", None)], "diagram, verdict", "varchar varchar"), names=[*fixtures.PD, *BAD], table="customer")
def pd_validate(spark, sf_dir):
    return derived.dealt(spark, sf_dir, fixtures.pd_table(spark, fixtures.PD | BAD), [*fixtures.PD, *BAD], table="customer").select("diagram", diagrams.pd_verdict(F.col("pd")).alias("verdict"))


@register(typed(STRUCTURE, "diagram, crossings, circles, writhe, genus, n_plus, n_minus", "varchar int int int int int int"), names=fixtures.PD, table="customer")
def seifert_structure(spark, sf_dir):
    return diagrams.seifert_structure(_pds(spark, sf_dir, table="customer"))


@register(typed(HISTOGRAM, "diagram, ones, circles, n", "varchar int int bigint"), names=fixtures.PD)
def cube_states_histogram(spark, sf_dir):
    return cube.state_histogram(_pds(spark, sf_dir))


@register(f"""
with h as {values(HISTOGRAM, "diagram, ones, circles, n")}, c as (select diagram, max(ones) as c from h group by 1),
t as (select h.diagram, c - 2 * ones + 2 * (circles - 1) - 4 * k as exp, n * (case when circles % 2 = 1 then 1 else -1 end) * (factorial((circles - 1)::int) / (factorial(k::int) * factorial((circles - 1 - k)::int))) as v
  from h join c using (diagram), range(0, 10) r(k) where k < circles)
select diagram, exp::int as exp, sum(v)::bigint as coef from t group by 1, 2 having sum(v) <> 0""", names=fixtures.PD)
def kauffman_bracket(spark, sf_dir):
    return cube.kauffman_bracket(_pds(spark, sf_dir))


@register(typed([(d, low + i, c) for d, (low, cs) in JONES.items() for i, c in enumerate(cs) if c], "diagram, exp, coef", "varchar int bigint"), names=fixtures.PD)
def jones_polynomial(spark, sf_dir):
    return cube.jones_polynomial(_pds(spark, sf_dir))


@register("""select 'T(2,' || n || ')' as diagram, ((n - 1) / 2 + k)::int as exp, (case when k = 0 then 1 when k % 2 = 0 then 1 else -1 end)::bigint as coef
from range(3, 14, 2) a(n), range(0, 20) b(k) where k <= n and k <> 1""".replace("(n - 1) / 2", "(n - 1) // 2"), names=[f"T(2,{n})" for n in range(3, 14, 2)], table="customer")
def jones_torus_batch(spark, sf_dir):
    return cube.jones_batch(_pds(spark, sf_dir, {f"T(2,{n})": fixtures.torus_pd(n) for n in range(3, 14, 2)}, "customer"))


#: Published for the ladder's larger diagrams: lowest exponent and coefficients of Jones, s.
LADDER_JONES = {"6_2": (-1, [1, -1, 2, -2, 2, -2, 1]), "7_4": (1, [1, -2, 3, -2, 3, -2, 1, -1]), "8_19": (3, [1, 0, 1, 0, 0, -1])}


@register(typed([(d, low + i, c) for d, (low, cs) in LADDER_JONES.items() for i, c in enumerate(cs) if c], "diagram, exp, coef", "varchar int bigint"), names=list(LADDER_JONES), table="customer")
def jones_ladder(spark, sf_dir):
    return cube.jones_batch(_pds(spark, sf_dir, {d: fixtures.LADDER[d] for d in LADDER_JONES}, table="customer"))


@register(f"""with p as (select diagram, exp, sum(coef)::bigint as coef from {values([(d, low + i, c) for d, (low, cs) in (JONES | LADDER_JONES).items() if d in fixtures.LADDER for i, c in enumerate(cs)], "diagram, exp, coef")} group by 1, 2),
u as (select diagram, 2 * exp + k as j, coef from p, (values (-1), (1)) t(k))
select diagram, (-j)::int as j, sum(coef)::bigint as chi from u group by 1, 2 having chi <> 0""", names=list(fixtures.LADDER), table="customer")
def khovanov_ladder_euler(spark, sf_dir):
    """The graded Euler characteristic of homology over Q is the Jones polynomial times that of a circle."""
    h = khovanov.khovanov_batch(_pds(spark, sf_dir, fixtures.LADDER, table="customer"), "q")
    sign = F.when(F.pmod("i", F.lit(2)) == 0, 1).otherwise(-1)
    return h.groupBy("diagram", "j").agg(F.sum(sign * F.col("dim")).alias("chi")).where("chi <> 0")


# --- braids --------------------------------------------------------------------------------------------------------

NEXT_SQL = f"""letters as ({derived.LETTERS_SQL}),
lead_ as (select diagram, abs(letter)::int as strand, pos, sign(letter)::int as s, lead(pos) over w as next_pos, lead(sign(letter)::int) over w as s_next from letters window w as (partition by diagram, abs(letter) order by pos)),
g as (select *, (row_number() over (partition by diagram order by pos) - 1)::int as g from lead_ where next_pos is not null)"""
MATRIX_SQL = f"""{NEXT_SQL},
m as (select diagram, g as i, g as j, -s as v from g where s = s_next
union all select a.diagram, case when a.s_next > 0 then b.g else a.g end, case when a.s_next > 0 then a.g else b.g end, case when a.s_next > 0 then 1 else -1 end from g a join g b on a.diagram = b.diagram and a.strand = b.strand and a.next_pos = b.pos
union all select a.diagram, a.g, b.g, case when a.pos < b.pos then 1 else -1 end from g a join g b on a.diagram = b.diagram and b.strand = a.strand + 1
  and ((a.pos < b.pos and b.pos < a.next_pos and a.next_pos < b.next_pos) or (b.pos < a.pos and a.pos < b.next_pos and b.next_pos < a.next_pos)))"""


@register(f"with {NEXT_SQL} select diagram, g, strand, pos, next_pos::int as next_pos, s, s_next from g")
def braid_next_crossing(spark, sf_dir):
    return classical.next_crossings(derived.order_letters(spark, sf_dir)).select("diagram", "g", "strand", "pos", "next_pos", "s", "s_next")


@register(f"with {MATRIX_SQL} select diagram, i::int as i, j::int as j, v::int as v from m")
def seifert_matrix(spark, sf_dir):
    return classical.seifert_matrix(derived.order_letters(spark, sf_dir))


@register(f"with {MATRIX_SQL} select diagram, i, j, sum(v)::bigint as v from (select diagram, i::int as i, j::int as j, v from m union all select diagram, j, i, v from m) group by 1, 2, 3 having sum(v) <> 0")
def seifert_symmetrized(spark, sf_dir):
    return classical.symmetrized(classical.seifert_matrix(derived.order_letters(spark, sf_dir)))


@register(typed([(d, x) for d, _, x, _, _ in BRAID_VALUES], "diagram, determinant", "varchar bigint"), names=fixtures.BRAIDS, table="customer")
def knot_determinant(spark, sf_dir):
    return classical.braid_invariants(_braids(spark, sf_dir)).select("diagram", "determinant")


@register(typed([(d, x) for d, _, _, x, _ in BRAID_VALUES], "diagram, signature", "varchar int"), names=fixtures.BRAIDS, table="customer")
def knot_signature(spark, sf_dir):
    return classical.braid_invariants(_braids(spark, sf_dir)).select("diagram", "signature")


@register(typed([(d, i, c) for d, _, _, _, a in BRAID_VALUES for i, c in enumerate(a)], "diagram, exp, coef", "varchar int bigint"), names=fixtures.BRAIDS, table="customer")
def alexander_polynomial(spark, sf_dir):
    return classical.braid_invariants(_braids(spark, sf_dir)).select("diagram", F.posexplode("alexander").alias("exp", "coef"))


#: Determinants by Faddeev and LeVerrier's recursion: of V + V^T, whose roots are real, so that changes of sign count the positive ones,
#: and of V - 512 V^T, whose digits in base 512 are the Alexander polynomial's coefficients.
BASE_POWERS = "[" + ", ".join(f"{512**k}::hugeint" for k in range(14)) + "]"
BRAID_SQL = f"""with recursive {MATRIX_SQL}, orders_ as (select l_orderkey as diagram from lineitem group by 1), size as (select o.diagram, count(g.g)::int as n from orders_ o left join g using (diagram) group by 1),
cells as (select diagram, i, j, sum(v) as v, sum(w) as w from (select diagram, i::int as i, j::int as j, v, 0 as w from m union all select diagram, j, i, 0, v from m) group by 1, 2, 3),
grid as (select n.diagram, n.n, r.i, c.j, coalesce(v, 0) as v, coalesce(w, 0) as w from size n, range(13) r(i), range(13) c(j) left join cells on cells.diagram = n.diagram and cells.i = r.i and cells.j = c.j where r.i < n.n and c.j < n.n),
rows_ as (select diagram, n, i, t, list((v - t * w)::hugeint order by j) as r from grid, (values (-1), (512)) x(t) group by 1, 2, 3, 4),
f as (select diagram, n, t, 0 as k, list(r order by i) as a, [[0::hugeint for y in r] for r in list(r order by i)] as mm, 1::hugeint as c, [1::hugeint] as cs from rows_ group by 1, 2, 3
  union all select diagram, n, t, k + 1, a, mm, (-list_sum([list_sum([a[i][l] * mm[l][i] for l in range(1, n + 1)]) for i in range(1, n + 1)]) // (k + 1))::hugeint as c,
    list_append(cs, (-list_sum([list_sum([a[i][l] * mm[l][i] for l in range(1, n + 1)]) for i in range(1, n + 1)]) // (k + 1))::hugeint)
  from (select diagram, n, t, k, a, cs, [[list_sum([a[i][l] * mm[l][j] for l in range(1, n + 1)])::hugeint + case when i = j then c else 0 end for j in range(1, n + 1)] for i in range(1, n + 1)] as mm from f where k < n)),
done as (select diagram, n, t, cs, [x for x in cs if x <> 0] as nz, case when n % 2 = 0 then cs[n + 1] else -cs[n + 1] end as det from f where k = n),
signs as (select diagram, abs(det)::bigint as determinant, len([1 for q in range(1, len(nz)) if sign(nz[q]) <> sign(nz[q + 1])]) as up, n, cs from done where t = -1),
digits as (select diagram, [((det + list_sum([256 * b for b in {BASE_POWERS}[:n + 1]])) // {BASE_POWERS}[k]) % 512 - 256 for k in range(1, n + 2)] as d from done where t = 512),
span as (select diagram, d, list_min([k for k in range(1, len(d) + 1) if d[k] <> 0]) as lo, list_max([k for k in range(1, len(d) + 1) if d[k] <> 0]) as hi from digits)
select z.diagram, z.n as generators, coalesce(determinant, 1)::bigint as determinant,
  coalesce(2 * up - (z.n - (n_zero)), 0)::int as signature,
  (case when z.n = 0 then [1] when lo is null then [0] else [case when d[lo] < 0 then -y else y end for y in d[lo:hi]] end)::varchar as alexander
from size z left join (select *, (case when list_max([k for k in range(1, len(cs) + 1) if cs[k] <> 0]) is null then 0 else len(cs) - list_max([k for k in range(1, len(cs) + 1) if cs[k] <> 0]) end) as n_zero from signs) using (diagram) left join span using (diagram)"""


@register(BRAID_SQL)
def order_braid_invariants(spark, sf_dir):
    """Determinant, signature and Alexander polynomial (as text) of every order's braid."""
    got = classical.braid_invariants(derived.order_braids(spark, sf_dir))
    return got.select("diagram", "generators", "determinant", "signature", F.concat(F.lit("["), F.array_join("alexander", ", "), F.lit("]")).alias("alexander"))


# --- Khovanov ------------------------------------------------------------------------------------------------------

CHAIN_SQL = f"""chain as (select h.diagram, (ones - n_minus)::int as i, (2 * k - circles + ones + n_plus - 2 * n_minus)::int as j,
  sum(n * (factorial(circles::int) / (factorial(k::int) * factorial((circles - k)::int))))::bigint as dim
  from {values(HISTOGRAM, "diagram, ones, circles, n")} h join {values([(r[0], r[5], r[6]) for r in STRUCTURE], "diagram, n_plus, n_minus")} s using (diagram), range(0, 10) r(k) where k <= circles group by 1, 2, 3)"""


@register(f"with {CHAIN_SQL} select * from chain", names=fixtures.PD)
def chain_dimensions(spark, sf_dir):
    return khovanov.chain_dimensions(_pds(spark, sf_dir))


@register(f"with {CHAIN_SQL} select diagram, j, sum(case when i % 2 = 0 then dim else -dim end)::bigint as chi from chain group by 1, 2 having chi <> 0", names=fixtures.PD)
def khovanov_euler_characteristic(spark, sf_dir):
    return khovanov.euler_characteristic(_pds(spark, sf_dir))


@register(typed([("3_1", 45), ("4_1", 132), ("5_1", 615), ("5_2", 435)], "diagram, entries", "varchar bigint"), names=fixtures.PD)
def khovanov_boundary_f2(spark, sf_dir):
    return khovanov.boundary_entries(_pds(spark, sf_dir))


@register(typed([("not a complex", 0, 0, 0, 1)], "cx, deg, col, row, v", "varchar int bigint bigint bigint"), names=fixtures.COMPLEXES, key="cx")
def d_squared_f2(spark, sf_dir):
    _, bd = _complex(spark, sf_dir, fixtures.COMPLEXES)
    return algebra.d_squared(bd).union(khovanov.squares(_pds(spark, sf_dir)))


@register("select 'x' as cx, 0 as deg, 0::bigint as col, 0::bigint as row, 0::bigint as v where false")
def d_squared_q(spark, sf_dir):
    _, bd = _complex(spark, sf_dir, fixtures.COMPLEXES_Q)
    return algebra.d_squared(bd, "q").union(khovanov.squares(_pds(spark, sf_dir), "q", lee=True))


@register(typed(counted(KHOVANOV), "diagram, i, j, dim", "varchar int int bigint"), names=fixtures.PD)
def khovanov_f2(spark, sf_dir):
    return khovanov.khovanov_homology(_pds(spark, sf_dir))


@register(typed(counted(KHOVANOV_Q), "diagram, i, j, dim", "varchar int int bigint"), names=fixtures.PD)
def khovanov_q(spark, sf_dir):
    return khovanov.khovanov_homology(_pds(spark, sf_dir), "q")


@register(typed(counted(KHOVANOV), "diagram, i, j, dim", "varchar int int bigint"), names=fixtures.PD, table="customer")
def khovanov_f2_batch(spark, sf_dir):
    return khovanov.khovanov_batch(_pds(spark, sf_dir, table="customer"))


@register(typed(counted(KHOVANOV_Q), "diagram, i, j, dim", "varchar int int bigint"), names=fixtures.PD, table="customer")
def khovanov_q_batch(spark, sf_dir):
    return khovanov.khovanov_batch(_pds(spark, sf_dir, table="customer"), "q")


@register(typed([(d, 0, 2) for d in [*fixtures.PD, "unknot"]], "diagram, i, dim", "varchar int bigint"), names=[*fixtures.PD, "unknot"])
def lee_homology(spark, sf_dir):
    return khovanov.lee_homology(_pds(spark, sf_dir, fixtures.PD | {"unknot": []}))


@register(typed([("jones", 0, None, 1), ("khovanov", 0, -1, 1), ("khovanov", 0, 1, 1), ("chain", 0, -1, 1), ("chain", 0, 1, 1)], "what, i, j, n", "varchar int int bigint"), names={"jones": 0, "khovanov": 0, "chain": 0}, key="what")
def unknot_without_crossings(spark, sf_dir):
    """The empty code is one circle."""
    t = _pds(spark, sf_dir, {"unknot": []})
    none, what = F.lit(None).cast("int").alias("j"), lambda x: F.regexp_replace("diagram", "unknot", x).alias("what")
    out = cube.jones_polynomial(t).select(what("jones"), F.col("exp").alias("i"), none, F.col("coef").alias("n"))
    out = out.union(khovanov.khovanov_homology(t).select(what("khovanov"), "i", "j", "dim"))
    return out.union(khovanov.chain_dimensions(t).select(what("chain"), "i", "j", "dim"))


@register(typed([("3_1", -2), ("4_1", 0), ("5_1", -4), ("5_2", -2), ("unknot", 0)], "diagram, s", "varchar int"), names=[*fixtures.PD, "unknot"])
def rasmussen_s(spark, sf_dir):
    return khovanov.rasmussen_s(_pds(spark, sf_dir, fixtures.PD | {"unknot": []}))


@register(typed([("3_1", -2), ("4_1", 0), ("5_2", -2), ("6_2", -2), ("7_4", -2), ("8_19", -6), ("unknot", 0)], "diagram, s", "varchar int"), names=[*fixtures.LADDER, "unknot"], table="customer")
def rasmussen_batch(spark, sf_dir):
    return khovanov.rasmussen_batch(_pds(spark, sf_dir, fixtures.LADDER | {"unknot": []}, table="customer"))


@register("""select 'T(2,' || n || ')' as diagram, i::int as i, j::int as j, dim::bigint as dim from range(3, 12, 2) a(n),
  lateral (select 0 as i, 2 - n as j, 1 as dim union all select 0, -n, 1
    union all select -2 * k, 2 - n - 4 * k, 1 from range(1, 10) b(k) where 2 * k < n
    union all select -2 * k - 1, -2 - n - 4 * k, 1 from range(1, 10) b(k) where 2 * k < n) c""", names=[f"T(2,{n})" for n in range(3, 12, 2)])
def khovanov_torus_batch(spark, sf_dir):
    """Closed formulas of the torus knots on two strands, over Q."""
    return khovanov.khovanov_batch(_pds(spark, sf_dir, {f"T(2,{n})": fixtures.torus_pd(n) for n in range(3, 12, 2)}), "q")


@register("select 'T(2,' || n || ')' as diagram, (1 - n)::int as s from range(3, 14, 2) a(n)", names=[f"T(2,{n})" for n in range(3, 14, 2)], table="customer")
def rasmussen_torus_batch(spark, sf_dir):
    return khovanov.rasmussen_batch(_pds(spark, sf_dir, {f"T(2,{n})": fixtures.torus_pd(n) for n in range(3, 14, 2)}, "customer"))


# --- algebra -------------------------------------------------------------------------------------------------------

COMPLEXES_BEYOND = fixtures.COMPLEXES | {"beyond": ({0: 1, 1: 1}, [(0, 0, 1)])}
COMPLEXES_OVER_Q = fixtures.COMPLEXES_Q | {k: fixtures.COMPLEXES[k] for k in ("merge", "circle")}
RANKS = {"triangle": ({}, [(0, 0, 0, 1), (0, 0, 1, 1), (0, 1, 1, 1), (0, 1, 2, 1), (0, 2, 0, 1), (0, 2, 2, 1)]), "dependent": ({}, [(0, 0, 0, 1), (0, 0, 2, 1), (0, 1, 1, 1), (0, 1, 2, 1), (0, 2, 0, 2), (0, 2, 1, -1), (0, 2, 2, 1)]), "two": ({}, [(0, 0, 0, 2)])}


def _rank_table(spark, sf_dir):
    rows = [(k, *e) for k, (_, es) in RANKS.items() for e in es]
    return derived.dealt(spark, sf_dir, spark.createDataFrame(rows, "cx string, deg int, col long, row long, v long"), RANKS, "cx", "customer").drop("turn")


@register(typed([("triangle", 0, 2), ("dependent", 0, 2), ("two", 0, 0)], "cx, deg, rank", "varchar int bigint"), names=RANKS, key="cx", table="customer")
def f2_rank(spark, sf_dir):
    return algebra.ranks(_rank_table(spark, sf_dir), "f2")


@register(typed([("triangle", 0, 3), ("dependent", 0, 2), ("two", 0, 1)], "cx, deg, rank", "varchar int bigint"), names=RANKS, key="cx", table="customer")
def rational_rank(spark, sf_dir):
    return algebra.ranks(_rank_table(spark, sf_dir), "q")


@register(typed([("triangle", 0, 3), ("dependent", 0, 2), ("two", 0, 1)], "cx, deg, rank", "varchar int bigint"), names=RANKS, key="cx", table="customer")
def rank_mod_p(spark, sf_dir):
    return algebra.ranks(_rank_table(spark, sf_dir), f"p{algebra.PRIMES[0]}")


@register(typed([("triangle", 0, 0, c) for c in range(3)] + [("two", 0, 0, 0), ("dependent", 0, 0, 1), ("dependent", 0, 0, 2)], "cx, deg, basis, col", "varchar int int bigint"), names=RANKS, key="cx", table="customer")
def f2_kernel(spark, sf_dir):
    return algebra.kernel_basis(_rank_table(spark, sf_dir))


@register(typed([("circle", 0, 1), ("circle", 1, 1), ("merge", 0, 1)], "cx, deg, betti", "varchar int bigint"), names=fixtures.COMPLEXES, key="cx")
def homology_f2(spark, sf_dir):
    gen, bd = _complex(spark, sf_dir, fixtures.COMPLEXES)
    return algebra.homology(gen.where("cx not like 'not a complex%'"), bd.where("cx not like 'not a complex%'"))


@register(typed([(k, "the boundary's square is not zero" if k == "not a complex" else None) for k in fixtures.COMPLEXES] + [("beyond", "an entry is beyond the generators")], "cx, verdict", "varchar varchar"), names=COMPLEXES_BEYOND, key="cx")
def complex_verdicts(spark, sf_dir):
    """Which complexes homology() refuses."""
    return algebra.complex_verdicts(*_complex(spark, sf_dir, COMPLEXES_BEYOND))


@register(typed([("circle", 0, 1), ("circle", 1, 1), ("merge", 0, 1)], "cx, deg, betti", "varchar int bigint"), names=COMPLEXES_OVER_Q, key="cx")
def homology_q(spark, sf_dir):
    return algebra.homology(*_complex(spark, sf_dir, COMPLEXES_OVER_Q), "q")


@register(typed([("circle", 0, 1), ("circle", 1, 1), ("merge", 0, 1)], "cx, deg, betti", "varchar int bigint"), names=fixtures.COMPLEXES, key="cx")
def gaussian_homology(spark, sf_dir):
    gen, bd = _complex(spark, sf_dir, fixtures.COMPLEXES)
    return algebra.gaussian_homology(gen.where("cx not like 'not a complex%'"), bd.where("cx not like 'not a complex%'"))


@register(derived.TRADE_SQL)
def trade_matrix(spark, sf_dir):
    return derived.trade_matrix(spark, sf_dir)


#: Ranks by elimination without division, modulo 2 of the counts and modulo a prime of the signed ones.
TRADE_RANKS_SQL = f"""with recursive t as ({derived.TRADE_SQL}), cells as (select cx, deg, col, r.row, p, sum(case when t.row <> r.row then 0 when p = 2 then n else v end) % p as x from t, range(5) r(row), (values (2), (1000003)) q(p) group by cx, deg, col, r.row, p),
cols as (select cx, deg, col, p, list(x::bigint order by row) as c from cells group by cx, deg, col, p),
e as (select cx, deg, p, 0 as k, 0 as rank, list(c) as m from cols group by cx, deg, p
  union all select cx, deg, p, k + 1, rank + (top is not null)::int, case when top is null then m else [[(v[i] * top[k + 1] - v[k + 1] * top[i]) % p for i in range(1, 6)] for v in m] end
  from (select *, [v for v in m if v[k + 1] % p <> 0][1] as top from e where k < 5))
select cx, deg, max(rank) filter (p = 2)::bigint as rank_f2, max(rank) filter (p > 2)::bigint as rank_q from e where k = 5 group by 1, 2"""


@register(TRADE_RANKS_SQL)
def trade_matrix_ranks(spark, sf_dir):
    m = derived.trade_matrix(spark, sf_dir)
    f2 = algebra.ranks(m.withColumn("v", F.col("n")), "f2").withColumnRenamed("rank", "rank_f2")
    return f2.join(algebra.ranks(m, "q_modular").withColumnRenamed("rank", "rank_q"), ["cx", "deg"])


# --- grids ---------------------------------------------------------------------------------------------------------


GRIDS_AND_NONE = fixtures.GRIDS | {"twice": ([0, 0], [1, 1]), "shared": ([0, 1], [0, 1])}


def _grids(spark, sf_dir, *names):
    some = {k: v for k, v in fixtures.GRIDS.items() if not names or k in names}
    return derived.turned_grids(derived.dealt(spark, sf_dir, fixtures.grid_table(spark, some), some))


def _ranked_parts(spark, sf_dir):
    """A permutation of 4, 5 or 6 for each part, by rank."""
    n = F.lit(4) + (F.col("p_partkey") % 3).cast("int")
    return derived.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("diagram"), n.alias("n"), (F.col("p_partkey") * 7919 % F.factorial(n)).alias("rank"))


#: Permutations of 4, 5 and 6 in lexicographic order.
PERMS_SQL = """perms as (select n, []::int[] as l from range(4, 7) t(n) union all select n, list_append(l, v::int) from perms, range(6) r(v) where len(l) < n and v < n and not list_contains(l, v::int)),
  numbered as (select n, l, row_number() over (partition by n order by l) - 1 as rank from perms where len(l) = n),
  p as (select p_partkey as diagram, 4 + p_partkey % 3 as n, p_partkey * 7919 % factorial((4 + p_partkey % 3)::int)::bigint as rank from part)"""


@register(f"with recursive {PERMS_SQL} select diagram, (i - 1)::int as place, l[i] as value from p join numbered using (n, rank), range(1, 7) r(i) where i <= n")
def permutation_unrank(spark, sf_dir):
    return grid.states_of(_ranked_parts(spark, sf_dir)).select("diagram", F.posexplode("state").alias("place", "value"))


@register(f"with recursive {PERMS_SQL} select diagram, n::int as n, rank from p")
def permutation_rank(spark, sf_dir):
    return grid.ranks_of(grid.states_of(_ranked_parts(spark, sf_dir))).select("diagram", "n", "rank")


@register(typed(STAIRCASE4, "diagram, m, a, n", "varchar int int bigint"), names=["staircase4"])
def grading_histogram(spark, sf_dir):
    return grid.grading_histogram(_grids(spark, sf_dir, "staircase4"))


#: Homology of a grid of n rows is HFK by (1 + q^-1 t^-1)^(n - 1), and its Euler characteristic the Alexander polynomial by (1 - t^-1)^(n - 1).
GRID_SQL = f"""h as {values(HFK, "diagram, m, a, rank")}, n as {values([(k, len(o)) for k, (o, _) in fixtures.GRIDS.items()], "diagram, n")},
p as (select diagram, m - k as m, a - k as a, sum(rank * (factorial((n - 1)::int) / (factorial(k::int) * factorial((n - 1 - k)::int)))) as dim from h join n using (diagram), range(0, 10) r(k) where k < n group by 1, 2, 3)"""


@register(f"with {GRID_SQL} select diagram, a::int as a, sum(case when m % 2 = 0 then dim else -dim end)::bigint as chi from p group by 1, 2 having chi <> 0", names=fixtures.GRIDS)
def alexander_euler(spark, sf_dir):
    return grid.alexander_euler(_grids(spark, sf_dir))


@register(typed([("staircase3", 3, 1, 1), ("staircase4", 32, 1, 1), ("trefoil", 150, 1, 1), ("trefoil mirror", 150, 1, 1), ("figure-eight", 1380, 1, 1)], "diagram, entries, drop_m, keeps_a", "varchar bigint int int"), names=fixtures.GRIDS)
def grid_differential(spark, sf_dir):
    b = grid.grid_boundary(_grids(spark, sf_dir))
    return b.groupBy("diagram").agg(F.count("*").alias("entries"), F.max(F.col("m") - F.col("m_to")).alias("drop_m"), F.min((F.col("a") == F.col("a_to")).cast("int")).alias("keeps_a"))


#: States as permutations, gradings by counting pairs of points and markers, rectangles cell by cell on the torus.
STATES_SQL = f"""grids as {values([(k, len(o), o, x) for k, (o, x) in fixtures.GRIDS.items()], "diagram, n, o, x")},
perms as (select diagram, n, o, x, []::int[] as l from grids union all select diagram, n, o, x, list_append(l, v::int) from perms, range(10) r(v) where len(l) < n and v < n and not list_contains(l, v::int)),
levels as (select diagram, n, o, x, l, row_number() over (partition by diagram order by l) - 1 as rank,
  list_sum([len([1 for j in range(i + 1, n + 1) if l[i] < l[j]]) - len([1 for j in range(i, n + 1) if l[i] <= o[j]]) - len([1 for j in range(i + 1, n + 1) if o[i] < l[j]]) + len([1 for j in range(i + 1, n + 1) if o[i] < o[j]]) for i in range(1, n + 1)]) + 1 as m,
  list_sum([len([1 for j in range(i + 1, n + 1) if l[i] < l[j]]) - len([1 for j in range(i, n + 1) if l[i] <= x[j]]) - len([1 for j in range(i + 1, n + 1) if x[i] < l[j]]) + len([1 for j in range(i + 1, n + 1) if x[i] < x[j]]) for i in range(1, n + 1)]) + 1 as m_x
  from perms where len(l) = n),
states as (select *, (m - m_x - (n - 1)) // 2 as a from levels)"""


@register(f"""with recursive {STATES_SQL},
swaps as (select s.*, i, j, (j - i + n) % n as high, (l[j] - l[i] + n) % n as wide from states s, range(1, 11) p(i), range(1, 11) q(j) where i <= n and j <= n and i <> j),
empty as (select *, [case when k = least(i, j) then l[greatest(i, j)] when k = greatest(i, j) then l[least(i, j)] else l[k] end for k in range(1, n + 1)] as y from swaps
  where len([1 for d in range(0, high) if (o[(i - 1 + d) % n + 1] - l[i] + n) % n < wide or (d > 0 and (l[(i - 1 + d) % n + 1] - l[i] + n) % n < wide)]) = 0),
odd as (select diagram, m, a, rank, y from empty group by all having count(*) % 2 = 1)
select e.diagram, e.m::int as m, e.a::int as a, e.rank, t.rank as target, t.m::int as m_to, t.a::int as a_to from odd e join states t on t.diagram = e.diagram and t.l = e.y""")
def grid_differential_filtered(spark, sf_dir):
    return grid.grid_boundary(fixtures.grid_table(spark), "filtered")


@register(f"with {GRID_SQL} select diagram, m::int as m, a::int as a, dim::bigint as dim from p", names=fixtures.GRIDS)
def grid_poincare(spark, sf_dir):
    return grid.grid_poincare(_grids(spark, sf_dir))


@register(typed(HFK, "diagram, m, a, rank", "varchar int int bigint"), names=fixtures.GRIDS)
def hfk_hat(spark, sf_dir):
    return grid.hfk_hat(_grids(spark, sf_dir))


@register(typed([("staircase3", 0), ("staircase4", 0), ("trefoil", 1), ("trefoil mirror", 1), ("figure-eight", 1)], "diagram, genus", "varchar int"), names=fixtures.GRIDS)
def seifert_genus(spark, sf_dir):
    return grid.seifert_genus(_grids(spark, sf_dir))


@register(typed([("staircase3", 0), ("staircase4", 0), ("trefoil", 1), ("trefoil mirror", -1), ("figure-eight", 0)], "diagram, tau", "varchar int"), names=fixtures.GRIDS)
def tau(spark, sf_dir):
    return grid.tau(_grids(spark, sf_dir))


@register(typed([(k, None) for k in fixtures.GRIDS] + [("twice", "not permutations"), ("shared", "two markers in one cell")], "diagram, verdict", "varchar varchar"), names=GRIDS_AND_NONE, table="customer")
def grid_validate(spark, sf_dir):
    g = derived.dealt(spark, sf_dir, fixtures.grid_table(spark, GRIDS_AND_NONE), GRIDS_AND_NONE, table="customer")
    return g.select("diagram", grid.grid_verdict(F.col("n"), F.col("o"), F.col("x")).alias("verdict"))


# --- text ----------------------------------------------------------------------------------------------------------


#: What stands before a part's number, and in the normalised name.
NAME_PARTS = [("K11n", "11n_"), ("11a", "11a_"), ("10_", "10_"), (" 3_", "3_"), ("K12a", "12a_"), ("11n_", "11n_"), ("", "")]


@register(f"select raw || p_partkey || ' ' as raw, name || p_partkey as name from part join (values {', '.join(f"('{r}', '{n}', {i})" for i, (r, n) in enumerate(NAME_PARTS))}) v(raw, name, i) on p_partkey % {len(NAME_PARTS)} = i")
def normalize_names(spark, sf_dir):
    front = F.get(F.array(*(F.lit(r) for r, _ in NAME_PARTS)), F.col("p_partkey") % len(NAME_PARTS))
    raw = derived.read(spark, sf_dir, "part").select(F.concat(front, F.col("p_partkey"), F.lit(" ")).alias("raw"))
    return raw.select("raw", text.normalize_name(F.col("raw")).alias("name"))


@register(typed([("3_1 mirror", 0, 1, 1), ("3_1 mirror", 0, 3, 1), ("3_1 mirror", 2, 5, 1), ("3_1 mirror", 3, 9, 1), ("3_1 mirror", 3, 7, 1), ("3_1 mirror", 2, 7, 1), ("unknot", 0, -1, 1), ("unknot", 0, 1, 1)], "diagram, i, j, dim", "varchar int int bigint"), names=fixtures.KH_VECTORS, table="customer")
def uct_mod2(spark, sf_dir):
    return text.khovanov_mod2(text.khovanov_rows(derived.dealt(spark, sf_dir, fixtures.text_table(spark, fixtures.KH_VECTORS), fixtures.KH_VECTORS, table="customer").drop("turn")))


@register(typed([("unknot", 0, 1, 1), ("unknot", 0, -1, 1)], "diagram, i, j, dim", "varchar int int bigint"), names=["unknot"], table="customer")
def mirror_table(spark, sf_dir):
    return text.mirrored(text.khovanov_mod2(text.khovanov_rows(derived.dealt(spark, sf_dir, fixtures.text_table(spark, {"unknot": fixtures.KH_VECTORS["unknot"]}), ["unknot"], table="customer").drop("turn"))))


@register(typed([("trefoil", 1, 1), ("trefoil", 3, 1), ("trefoil", 4, -1), ("figure-eight", -2, 1), ("figure-eight", -1, -1), ("figure-eight", 0, 1), ("figure-eight", 1, -1), ("figure-eight", 2, 1), ("5_2", 1, 1), ("5_2", 2, -1), ("5_2", 3, 2), ("5_2", 4, -1), ("5_2", 5, 1), ("5_2", 6, -1)], "diagram, exp, coef", "varchar int bigint"), names=fixtures.LAURENT, table="customer")
def laurent_parse(spark, sf_dir):
    return text.laurent_terms(derived.dealt(spark, sf_dir, fixtures.text_table(spark, fixtures.LAURENT), fixtures.LAURENT, table="customer").drop("turn"))


@register(typed([("3_1", 0, 1, 1), ("3_1", 0, 3, 1), ("3_1", 2, 5, 1), ("3_1", 3, 9, 1), ("torsion", 3, 7, 1), ("multiple", -1, -3, 2), ("multiple", 0, -1, 1)], "diagram, i, j, dim", "varchar int int bigint"), names=fixtures.KH_POLYNOMIALS, table="customer")
def khovanov_poly_parse(spark, sf_dir):
    return text.khovanov_terms(derived.dealt(spark, sf_dir, fixtures.text_table(spark, fixtures.KH_POLYNOMIALS), fixtures.KH_POLYNOMIALS, table="customer").drop("turn"))


@register(typed([("a", c) for c in (0, 1, 2, 3, 8)] + [("b", 5)] + [("c", c) for c in (0, 1, 4, 5)], "diagram, core", "varchar int"), names=fixtures.CPULISTS, table="customer")
def cpulist_parse(spark, sf_dir):
    return derived.dealt(spark, sf_dir, fixtures.text_table(spark, fixtures.CPULISTS), fixtures.CPULISTS, table="customer").drop("turn").select("diagram", F.explode(text.cpulist(F.col("text"))).alias("core"))


# --- plans ---------------------------------------------------------------------------------------------------------

NATION_GEN = "select c_mktsegment as cx, (c_nationkey % 4)::int as deg, count(*) as dim from customer group by 1, 2"
BLOCK_SQL = f"""gen as ({NATION_GEN}), b as (select g.cx, g.deg, g.dim as cols, coalesce(h.dim, 0) as rows from gen g left join gen h on g.cx = h.cx and h.deg = g.deg + 1),
c as (select *, case when cols <= 0 or rows <= 0 then 0 else (cols + least(cols, rows)) * ((rows + 63) // 64) * 8 end as bytes, case when cols <= 0 or rows <= 0 then 0 else cols * least(cols, rows) * ((rows + 63) // 64) end as ops from b)"""


def _segment_gen(spark, sf_dir):
    c = derived.read(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("cx"), F.expr("cast(c_nationkey % 4 as int)").alias("deg")).agg(F.count("*").alias("dim"))


@register(f"with {BLOCK_SQL} select cx, deg, cols, rows::bigint as rows, bytes::bigint as bytes, ops::bigint as ops from c")
def block_cost(spark, sf_dir):
    return cost.blocks(_segment_gen(spark, sf_dir))


@register(f"with {BLOCK_SQL} select cx, sum(cols)::bigint as total_dim, max(bytes)::bigint as peak_bytes, arg_max(deg, (bytes, -deg))::int as peak_deg, sum(ops)::bigint as ops from c group by 1")
def predicted_size(spark, sf_dir):
    return cost.predicted_size(_segment_gen(spark, sf_dir))


@register(f"with {BLOCK_SQL} select cx, max(bytes)::bigint as peak_bytes, (10 * 1048576 + floor(max(bytes) * 0.5))::bigint as bitint_bytes, (40 * 1048576 + max(bytes))::bigint as unknown_bytes from c group by 1")
def reduce_host_bytes(spark, sf_dir):
    s = cost.predicted_size(_segment_gen(spark, sf_dir))
    return s.select("cx", "peak_bytes", cost.host_bytes(F.col("peak_bytes"), F.lit("bitint")).alias("bitint_bytes"), cost.host_bytes(F.col("peak_bytes"), F.lit("other")).alias("unknown_bytes"))


@register(f"with {BLOCK_SQL}, p as (select cx, max(bytes)::bigint as peak_bytes from c group by 1) select cx, peak_bytes, case when peak_bytes <= 65536 and peak_bytes >= 16384 then 'packed-gpu' else 'bitint' end as backend, peak_bytes <= 65536 as fits_gpu from p")
def route_backend(spark, sf_dir):
    return cost.routed(cost.predicted_size(_segment_gen(spark, sf_dir)), gpu_bytes=65536, gpu_least=16384).select("cx", "peak_bytes", "backend", "fits_gpu")


@register(f"""with recursive {STATES_SQL}, h as (select diagram, a, m, count(*) as cols from states group by all),
b as (select diagram, a, m, cols, coalesce((select t.cols from h t where t.diagram = h.diagram and t.a = h.a and t.m = h.m - 1), 0) as rows from h),
p as (select diagram, a, max(case when rows = 0 then 0 else (cols + least(cols, rows)) * ((rows + 63) // 64) * 8 end) as peak from b group by 1, 2)
select diagram, sum(peak)::bigint as all_bytes, max(peak)::bigint as floor_bytes from p group by 1""", names=fixtures.GRIDS)
def grading_peaks(spark, sf_dir):
    return cost.batch_bytes(grid.grading_histogram(_grids(spark, sf_dir)))


PATHS = [("fits", 0, "cpu_pinned", 2, 50, 0), ("device", 0, "gpu", 1, 10, 100), ("device", 1, "cpu_unpinned", 4, 10, 0), ("wide", 0, "cpu_pinned", 3, 10, 0), ("big", 0, "cpu_unpinned", 1, 2048, 0), ("big", 1, "cpu_pinned", 1, 2048, 0)]


def _machine(spark):
    return spark.createDataFrame([(0, [0, 1], 100), (1, [2, 3], 200)], "node int, cores array<int>, ram long")


def _paths(spark):
    return spark.createDataFrame(PATHS, "job string, ord int, placement string, cores int, ram long, vram long")


@register(typed([("fits", True, 0, None), ("device", True, 1, None), ("wide", False, None, "cpu_pinned exceeds_cores: needs 3 cores, has 2"), ("big", False, None, "cpu_unpinned exceeds_ram: needs 2.0 KiB, has 250 B; cpu_pinned exceeds_ram: needs 2.0 KiB, has 250 B")], "job, feasible, path, gaps", "varchar boolean int varchar"))
def job_feasibility(spark, sf_dir):
    gaps = placement.capability_gaps(_paths(spark), _machine(spark), spark.createDataFrame([], "vram long"), 250)
    return placement.job_feasibility(gaps)


@register(typed([(0, 1, 60), (1, 2, 150), (1, 3, 150)], "node, core, free_ram", "int int bigint"))
def ledger_free(spark, sf_dir):
    used = spark.createDataFrame([("a", 0, [0], 40, 10), ("b", 1, [], 30, 50)], "job string, node int, cores array<int>, declared long, actual long")
    f = placement.free_resources(_machine(spark), used)
    return f.select("node", F.explode("free_cores").alias("core"), "free_ram")


DAG_SQL = "needs as (select 's' || l_suppkey as job, 'p' || l_partkey as dep from lineitem union select 'n' || s_nationkey, 's' || s_suppkey from supplier)"


def _dag(spark, sf_dir):
    """(job, dep): every nation-supplier and supplier-part edge of the tables."""
    l, s = derived.read(spark, sf_dir, "lineitem"), derived.read(spark, sf_dir, "supplier")
    parts = l.select(F.concat(F.lit("s"), "l_suppkey").alias("job"), F.concat(F.lit("p"), "l_partkey").alias("dep"))
    return parts.union(s.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"))).distinct()


@register(f"""with {DAG_SQL}, jobs as (select job from needs union select dep from needs), done as (select job from jobs where job[1] = 'p' and job[2:]::bigint % 100 = 0)
select job from jobs where job not in (select job from done) and job not in (select job from needs where dep not in (select job from done))""")
def dag_ready(spark, sf_dir):
    n = _dag(spark, sf_dir)
    jobs = n.select("job").union(n.select("dep")).distinct()
    return placement.ready_jobs(jobs, n, jobs.where("job like 'p%' and cast(substring(job, 2) as bigint) % 100 = 0"))


@register(f"""with recursive {DAG_SQL}, sym as (select job as a, dep as b from needs union select dep, job from needs),
reach as (select a, a as b from sym union select r.a, s.b from reach r join sym s on r.b = s.a) select a as node, min(b) as root from reach group by 1""")
def dag_components(spark, sf_dir):
    return placement.lineage_components(_dag(spark, sf_dir))


@register("select 'c' || c_custkey as job, 'part of a cycle' as verdict from customer where c_custkey between 1 and 3 union all select 'x', 'needs y, which is not declared' union all select 'x', 'declared twice'")
def job_graph_verdicts(spark, sf_dir):
    """A tree of all suppliers, a cycle of three, a job declared twice with a need that nobody declares."""
    s = derived.read(spark, sf_dir, "supplier").select("s_suppkey")
    tree = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("job"), F.expr("concat('s', cast(s_suppkey div 2 as string))").alias("dep"))
    needs = tree.where("dep <> 's0'").union(spark.createDataFrame([("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("x", "y")], "job string, dep string"))
    jobs = tree.select("job").union(spark.createDataFrame([("c1",), ("c2",), ("c3",), ("x",), ("x",)], "job string"))
    return placement.graph_verdicts(jobs, needs)


@register("""with x as (select event_type as placement, value / (1 + event_id % 7) as x, row_number() over (partition by event_type order by ts) as k, count(*) over (partition by event_type) as n from events)
select placement, round(sum(0.3 * pow(0.7, n - k) * x) + max(case when k = 1 then x end) * pow(0.7, max(n)), 6) as rate, max(n)::bigint as n from x group by 1""")
def ewma_calibration(spark, sf_dir):
    e = derived.read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("placement"), (1 + F.col("event_id") % 7).alias("cost"), F.col("value").alias("seconds"))
    return calibration.ewma_rates(e).withColumn("rate", F.round("rate", 6))


@register(typed([(50, 0.0, "fresh"), (49, None, "warm"), (10, 10.0, "fresh"), (10, 9.9, "warm")], "vram, seconds, route", "int double varchar"))
def route_execution(spark, sf_dir):
    t = spark.createDataFrame([(50, 0.0), (49, None), (10, 10.0), (10, 9.9)], "vram int, seconds double")
    return t.withColumn("route", placement.execution_route(F.col("vram"), F.lit(100), F.col("seconds"), F.lit(1.0)))


#: By diagram what the library and another tool have, as (i, j, dim): equal, mirrored, different, and missing on either side.
TWO_TABLES = {
    "same": ([(1, 2, 1), (0, 0, 3)], [(1, 2, 1), (0, 0, 2), (0, 0, 1)]),
    "mirrored": ([(1, 2, 1), (0, 1, 1)], [(-1, -2, 1), (0, -1, 1)]),
    "different": ([(1, 2, 1)], [(1, 3, 1)]),
    "here only": ([(1, 2, 1)], []),
    "there only": ([], [(1, 2, 1)]),
}


@register(typed([("same", "pass"), ("mirrored", "mirror"), ("different", "mismatch"), ("here only", "mismatch"), ("there only", "mismatch")], "diagram, verdict", "varchar varchar"), names=TWO_TABLES, table="customer")
def verdict(spark, sf_dir):
    sides = (spark.createDataFrame([(d, *c) for d, both in TWO_TABLES.items() for c in both[k]], "diagram string, i int, j int, dim long") for k in (0, 1))
    return contract.verdicts(*(derived.dealt(spark, sf_dir, s, TWO_TABLES, table="customer").drop("turn") for s in sides))


@register("""select event_type as tool, 'x' as invariant,
case min(case when value < 5 then 1 when value < 30 then 2 when value < 90 then 3 else 4 end) when 1 then 'mismatch' when 2 then 'mirror' when 3 then 'pass' else 'oracle' end as verdict from events group by 1""")
def report_worst_verdict(spark, sf_dir):
    e = derived.read(spark, sf_dir, "events")
    v = F.when(F.col("value") < 5, "mismatch").when(F.col("value") < 30, "mirror").when(F.col("value") < 90, "pass").otherwise("oracle")
    return contract.worst_verdicts(e.select(F.col("event_type").alias("tool"), F.lit("x").alias("invariant"), v.alias("verdict")))


@register("""with b as (select event_type as tool, user_id % 50 as d, min(value) as s from events group by 1, 2) select tool, 'x' as invariant, round(quantile_cont(s, 0.5) * 1000, 6) as ms from b group by 1""")
def median_timing(spark, sf_dir):
    e = derived.read(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.lit("x").alias("invariant"), (F.col("user_id") % 50).alias("diagram"), F.col("value").alias("seconds"))
    return contract.median_ms(e).withColumn("ms", F.round("ms", 6))


# --- agreement with other tools ------------------------------------------------------------------------------------

#: What tools print, made up for the fixtures' published values.
PRINTED = {
    "3_1": "Loading\nJONES {1: 1, 3: 1, 4: -1}\nALEXANDER {-1: -1, 0: 1, 1: -1}\nSIGNATURE -2\nDETERMINANT 3\nKHOVANOV {(-3, -9): (0,), (-2, -7): (2,), (-2, -5): (0,), (0, -3): (0,), (0, -1): (0,)}",
    "4_1": "JONES {9: 9}\nJONES {-2: 1, -1: -1, 0: 1, 1: -1, 2: 1}\r\nSIGNATURE 0\nALEXANDER {0: 1, 1: -3, 2: 1}\nKHOVANOV {(2, 5): (0, 4, 3)}\nEND",
    "5_1": "JONES {-2: 1, -4: 1, -5: -1, -6: 1, -7: -1, 3: 0}\nALEXANDER {0: 1, 1: -1, 2: 2, 3: -1, 4: 1}",
}
FIELDS = [(d, line.split(" ", 1)[0], line.split(" ", 1)[1]) for d, t in PRINTED.items() for line in t.splitlines() if " " in line and "9: 9}" not in line]


def _printed(spark, sf_dir, tag=None, names=PRINTED):
    f = agreement.tagged_fields(derived.dealt(spark, sf_dir, fixtures.text_table(spark, PRINTED), names).drop("turn"))
    return f.where(F.col("tag") == tag) if tag else f


@register(typed(FIELDS, "diagram, tag, value", "varchar varchar varchar"), names=PRINTED)
def tagged_fields(spark, sf_dir):
    return _printed(spark, sf_dir)


@register(typed([("3_1", -3, -9, 1, 0), ("3_1", -2, -7, 0, 1), ("3_1", -2, -5, 1, 0), ("3_1", 0, -3, 1, 0), ("3_1", 0, -1, 1, 0), ("4_1", 2, 5, 1, 1)], "diagram, i, j, free, even", "varchar int int int int"), names=PRINTED)
def cell_fields(spark, sf_dir):
    return agreement.cell_fields(_printed(spark, sf_dir, "KHOVANOV"))


@register(typed([("3_1", "pass", "pass"), ("4_1", "pass", "pass"), ("5_1", "mirror", "mismatch"), ("5_2", "mismatch", None)], "diagram, jones, alexander", "varchar varchar varchar"), names=fixtures.PD)
def printed_verdicts(spark, sf_dir):
    """Polynomials as this library has them against printed ones; 5_2 isn't printed, and has no braid here."""
    jones = agreement.jones_verdicts(cube.jones_batch(_pds(spark, sf_dir)), agreement.polynomial_fields(_printed(spark, sf_dir, "JONES", fixtures.PD)))
    own = classical.braid_invariants(derived.turned_braids(derived.dealt(spark, sf_dir, fixtures.braid_table(spark).where("diagram in ('3_1', '4_1', '5_1')"), fixtures.PD))).select("diagram", F.posexplode("alexander").alias("exp", "coef"))
    alexander = agreement.alexander_verdicts(own, agreement.polynomial_fields(_printed(spark, sf_dir, "ALEXANDER", fixtures.PD)))
    return jones.withColumnRenamed("verdict", "jones").join(alexander.withColumnRenamed("verdict", "alexander"), "diagram", "left")


@register(typed([("a", "x: 2", "q + q^3*t^2", None), ("b", "", None, 7), ("c", None, "q", None), ("d", None, None, None), ("3_1", None, None, 3)], "diagram, field, polynomial, strands", "varchar varchar varchar int"))
def tool_lines(spark, sf_dir):
    """One reader of each kind over the same texts."""
    texts = {"a": "time 3\ns-invariant : x: 2 \ns-invariant: 5\n q^9 \n q + q^3*t^2\t\nq = 1", "b": "s-invariant:", "c": "no s-invariant\nq", "d": "", "3_1": "t + 1"}
    names = F.when(F.col("diagram") == "b", "7_1").when(F.col("diagram") == "c", "8_1").when(F.col("diagram") == "d", "1_1").otherwise(F.col("diagram"))
    t = fixtures.text_table(spark, texts)
    return t.select("diagram", agreement.field_after_colon(F.col("text"), "s-invariant").alias("field"), agreement.last_polynomial(F.col("text")).alias("polynomial"), agreement.torus_strands(names).alias("strands"))


@register(typed([("3_1", 1, 1), ("3_1", 3, 1), ("3_1", 4, -1), ("mirror", -1, 1), ("mirror", -3, 1), ("mirror", -4, -1)], "diagram, exp, coef", "varchar int bigint"))
def root_exponents(spark, sf_dir):
    """A Jones polynomial in the root of t, and its mirror."""
    p = agreement.halved_exponents(text.laurent_terms(fixtures.text_table(spark, {"3_1": "x^2 + x^6 - x^8"}), "x"))
    return p.union(agreement.negated_exponents(p).withColumn("diagram", F.lit("mirror")))


def _order_terms(spark, sf_dir):
    """A polynomial for each order: the line's number is the exponent, what it sells is the coefficient."""
    l = derived.read(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("diagram"), F.col("l_linenumber").cast("int").alias("exp")).agg((1 + F.sum("l_partkey")).cast("long").alias("coef"))


@register("select l_orderkey as diagram, case l_orderkey % 3 when 0 then 'pass' when 1 then 'mirror' else 'mismatch' end as verdict from lineitem group by l_orderkey")
def jones_agreement(spark, sf_dir):
    """Orders' polynomials against themselves, negated in a third of the orders, changed in another."""
    native = _order_terms(spark, sf_dir)
    kind = F.col("diagram") % 3
    oracle = native.withColumns({"exp": F.when(kind == 1, -F.col("exp")).otherwise(F.col("exp")), "coef": F.when(kind == 2, F.col("coef") + 1).otherwise(F.col("coef"))})
    return agreement.jones_verdicts(native, oracle)


@register("select l_orderkey as diagram, case when l_orderkey % 5 = 4 and count(distinct l_linenumber) > 1 then 'mismatch' else 'pass' end as verdict from lineitem group by l_orderkey")
def alexander_agreement(spark, sf_dir):
    """Orders' polynomials against themselves times a unit; in a fifth of the orders each exponent is doubled too, which only a lone term survives."""
    native = _order_terms(spark, sf_dir)
    sign = F.when(F.col("diagram") % 2 == 0, 1).otherwise(-1)
    oracle = native.withColumns({"exp": F.when(F.col("diagram") % 5 == 4, 2 * F.col("exp")).otherwise(F.col("exp")) + F.col("diagram") % 7 - 3, "coef": sign * F.col("coef")})
    return agreement.alexander_verdicts(native, oracle)


@register("select s_suppkey as diagram, case when s_nationkey - 12 = s_suppkey % 25 - 12 then 'pass' when s_nationkey - 12 = 12 - s_suppkey % 25 then 'mirror' else 'mismatch' end as verdict from supplier")
def scalar_agreement(spark, sf_dir):
    s = derived.read(spark, sf_dir, "supplier")
    return agreement.scalar_verdicts(s.select(F.col("s_suppkey").alias("diagram"), (F.col("s_nationkey") - 12).alias("value")), s.select(F.col("s_suppkey").alias("diagram"), (F.col("s_suppkey") % 25 - 12).alias("value")))


from skeinflow import table_queries  # noqa: E402, F401  registers more queries
