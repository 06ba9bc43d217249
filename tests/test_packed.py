"""Packed words, compressed columns and seeded matrices against plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.operators import algebra, csc, packed
from skeinflow.sources import derived, seeded


def matrix(rng, cols, rows, share):
    m = rng.random((cols, rows)) < share
    return m, np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1]


def plain(m):
    return algebra.f2_rank_sets([np.flatnonzero(x).tolist() for x in m])


def test_kernels_agree():
    rng = np.random.default_rng(5)
    for cols, rows in [(1, 1), (3, 64), (64, 3), (65, 65), (130, 190), (40, 1)] + [tuple(rng.integers(1, 150, 2)) for _ in range(60)]:
        for share in (0, 0.01, 0.1, 0.5, 1):
            m, ptr, idx = matrix(rng, cols, rows, share)
            want = plain(m)
            p = packed.pack(ptr, idx, rows)
            words, tables = packed.leads_by_words(p), packed.leads_by_tables(p)
            assert len(words) == want and words.tolist() == tables.tolist() == sorted(set(words.tolist()), reverse=True)
            assert packed.sparse_rank(np.repeat(np.arange(cols), np.diff(ptr)), idx) == want
            independent = packed.first_independent(ptr, idx, rows)
            for k in (0, cols // 2, cols):
                assert (independent < k).sum() == plain(m[:k])
            assert {t: csc.kernel_of(t)(ptr, idx, rows) for t, ok, _ in csc.available_tiers() if ok} == dict.fromkeys(["sets", "bits", "words", "tables", "sparse"], want)


def test_pack_and_leading():
    p = packed.pack(np.array([0, 3, 3, 4]), np.array([5, 70, 5, 127]), 128)
    assert [packed.leading(v) for v in p] == [70, -1, 127] and p[0, 0] == 1 << 5 and p[0, 1] == 1 << 6
    assert packed.pack(np.array([0]), np.array([], np.int64), 0).shape == (0, 1)
    # A repeated entry counts once; every word of a vector is looked at.
    assert packed.sparse_rank(np.array([0, 0, 1]), np.array([3, 3, 3])) == 1
    assert packed.words_rank(np.eye(200, 200, dtype=bool) @ np.zeros((200, 4), np.uint64)) == 0


def test_tiers():
    assert {t for t, ok, _ in csc.available_tiers() if not ok} == {"compiled"} and csc.BEST in csc.TIERS
    with pytest.raises(ValueError, match="unknown tier"):
        csc.kernel_of("abacus")
    with pytest.raises(RuntimeError, match="numba"):
        csc.kernel_of("compiled")


GEN = [("a", 0, 3), ("a", 1, 2), ("b", 0, 1), ("b", 1, 70000), ("b", 2, 5)]
ENTRIES = [("a", 0, 0, 1), ("a", 0, 0, 0), ("a", 0, 0, 1), ("a", 0, 2, 1), ("b", 0, 0, 69999), ("b", 1, 69999, 4), ("b", 1, 3, 0)]


def tables(spark, entries=ENTRIES):
    return spark.createDataFrame(GEN, "cx string, deg int, dim long"), spark.createDataFrame(entries, "cx string, deg int, col long, row long")


def test_compressed_form(spark, monkeypatch):
    monkeypatch.setattr(csc, "SLICE", 2000)
    c = csc.from_entries(*tables(spark)).cache()
    assert {(r.cx, r.deg): (r.n, r.cols, r.rows) for r in c.groupBy("cx", "deg").agg(F.count("*").alias("n"), F.sum("cols").alias("cols"), F.max("rows").alias("rows")).collect()} == {("a", 0): (1, 3, 2), ("a", 1): (1, 2, 0), ("b", 0): (1, 1, 70000), ("b", 1): (35, 70000, 5), ("b", 2): (1, 5, 0)}
    assert sorted(map(tuple, csc.differential(c).collect())) == sorted(set(ENTRIES))
    assert {(r.cx, r.deg): r.entries for r in csc.nnz(c).collect()} == {("a", 0): 3, ("a", 1): 0, ("b", 0): 1, ("b", 1): 2, ("b", 2): 0}
    assert csc.verdicts(c).where("verdict is not null").count() == 0
    first = c.where("cx = 'a' and deg = 0").first()
    assert np.frombuffer(first.indptr, csc.INDEX).tolist() == [0, 2, 2, 3] and np.frombuffer(first.indices, csc.INDEX).tolist() == [0, 1, 1]
    for tier in ("sets", "bits", "words", "tables", "sparse"):
        assert {(r.cx, r.deg): r["rank"] for r in csc.ranks(c.where("cx = 'a' or deg <> 1"), tier).collect()} == {("a", 0): 2, ("a", 1): 0, ("b", 0): 1, ("b", 2): 0}
    assert {(r.cx, r.deg): r["rank"] for r in csc.ranks(c).collect()}[("b", 1)] == 2


@pytest.mark.parametrize("bad", [("a", 0, 3, 0), ("a", 0, 0, 2), ("a", 1, 0, 0), ("a", 0, -1, 0), ("c", 0, 0, 0)])
def test_entries_beyond(spark, bad):
    with pytest.raises(Exception, match="beyond the generators"):
        csc.from_entries(*tables(spark, [*ENTRIES, bad])).collect()


def test_dimensions(spark):
    with pytest.raises(Exception, match="at least 1"):
        csc.from_entries(spark.createDataFrame([("a", 0, 0)], "cx string, deg int, dim long"), tables(spark)[1].limit(0)).collect()
    none = csc.from_entries(spark.createDataFrame([("a", 0, 2)], "cx string, deg int, dim long"), tables(spark)[1].limit(0))
    assert [(r.cx, r.deg, r.betti) for r in csc.homology(none).collect()] == [("a", 0, 2)]
    assert csc.homology(none.limit(0)).count() == 0


def test_verdicts(spark):
    def slice_of(ptr, idx, cols, rows):
        return bytearray(np.array(ptr, csc.INDEX).tobytes()), bytearray(np.array(idx, csc.INDEX).tobytes()), cols, rows

    cases = {"ok": slice_of([0, 1, 3], [0, 1, 1], 2, 2), "short": slice_of([0, 3], [0, 1, 1], 2, 2), "start": slice_of([1, 1, 3], [0, 1, 1], 2, 2), "falls": slice_of([0, 3, 2], [0, 1], 2, 2), "ends": slice_of([0, 1, 2], [0, 1, 1], 2, 2), "beyond": slice_of([0, 1, 3], [0, 2, 1], 2, 2), "below": slice_of([0, 1, 3], [0, -1, 1], 2, 2), "bytes": (bytearray(b"abc"), bytearray(), 1, 1), "null": (None, bytearray(), 1, 1)}
    df = spark.createDataFrame([(k, 0, 0, cols, rows, p, i) for k, (p, i, cols, rows) in cases.items()], "cx string, deg int, first long, cols long, rows long, indptr binary, indices binary")
    got = {r.cx: r.verdict for r in csc.verdicts(df).collect()}
    assert got == {"ok": None, "short": "indptr has 2 values for 2 columns", "start": "indptr does not start at 0", "falls": "indptr falls", "ends": "indptr does not end at the number of entries", "beyond": "a row is beyond the dimension above", "below": "a row is beyond the dimension above", "bytes": "not integers of four bytes", "null": "not integers of four bytes"}


def test_packed_columns(spark):
    df = spark.createDataFrame([("a", 0, [[3, 1, 3], [], [2]]), ("b", 0, [])], "cx string, deg int, columns array<array<bigint>>")
    got = {r.cx: (r.cols, r.indptr, r.indices) for r in csc.packed_columns(df).collect()}
    assert got == {"a": (3, [0, 3, 3, 4], [3, 1, 3, 2]), "b": (0, [0], [])}


def test_seeded_cells(spark):
    m = spark.createDataFrame([("x", 7, 40, 50, 0.25), ("y", 8, 5, 5, 0.0), ("z", 9, 5, 4, 1.0)], "cx string, seed long, cols int, rows int, density double")
    got = {(r.cx, r.col, r.row) for r in seeded.seeded_entries(m.repartition(3)).collect()}
    col, row = np.divmod(np.arange(2000), 50)
    want = seeded.cells(np.full(2000, 7), col, row) < int(0.25 * seeded.PRIME)
    assert {(c, r) for x, c, r in got if x == "x"} == set(zip(col[want].tolist(), row[want].tolist(), strict=True))
    assert sum(x == "z" for x, *_ in got) == 20 and not any(x == "y" for x, *_ in got)
    x = seeded.cells(np.full(1 << 16, 3), *np.divmod(np.arange(1 << 16), 256))
    assert abs((x < seeded.PRIME // 2).mean() - 0.5) < 0.01 and 0 <= x.min() and x.max() < seeded.PRIME
    bits = (x < seeded.PRIME // 2).reshape(256, 256)
    assert abs(np.corrcoef(bits[:-1].ravel(), bits[1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(bits[:, 1:].ravel(), bits[:, :-1].ravel())[0, 1]) < 0.02


def test_timed_tiers(spark):
    m = spark.createDataFrame([(i, i, 30, 30, 0.5) for i in range(3)], "cx long, seed long, cols int, rows int, density double")
    rows = csc.timed_tiers(csc.from_entries(seeded.shapes(m), seeded.seeded_entries(m)).where("deg = 0"), ("bits", "tables"), 2).collect()
    assert len(rows) == 6 and all(r.seconds > 0 for r in rows) and len({(r.cx, r["rank"]) for r in rows}) == 3


def test_order_complexes(spark):
    gen, bd = derived.order_complexes(spark, "/root/testdata/sf0.001")
    assert algebra.complex_verdicts(gen, bd, "q").where("verdict is not null").count() == 0
    want = {(r.cx, r.deg): r.betti for r in algebra.homology(gen, bd.where("deg < 9"), "f2").collect()}
    assert {(r.cx, r.deg): r.betti for r in csc.homology(csc.from_entries(gen, csc.odd_entries(bd))).collect()} == want


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_sorted_groups(size):
    import pyarrow as pa

    from skeinflow.functions.batches import sorted_groups

    a, b = [None, None, None, "p", "p", "q", "q", "q"], [1, 1, 2, 2, None, None, 3, 3]
    whole = pa.RecordBatch.from_pydict({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.int32()), "i": list(range(8))})
    batches = [whole.slice(0, 0), *(whole.slice(k, size) for k in range(0, 8, size))]
    assert [g.column("i").to_pylist() for g in sorted_groups(iter(batches), ["a", "b"])] == [[0, 1], [2], [3], [4], [5], [6, 7]]
    assert list(sorted_groups(iter([]), ["a"])) == []


def test_ranks_of_null_and_many_maps(spark):
    rows = [(None, 0, 0, 0, 1), (None, 0, 1, 0, 1), (None, 1, 0, 0, 2), ("a", 0, 0, 0, 1)] + [(f"c{i:04d}", 0, k, k % 2, 1) for i in range(2500) for k in range(3)]
    bd = spark.createDataFrame(rows, "cx string, deg int, col long, row long, v long")
    got = {(r.cx, r.deg): r["rank"] for r in algebra.ranks(bd).collect()}
    assert len(got) == 2503 and got[None, 0] == 1 and got[None, 1] == 0 and got["a", 0] == 1 and got["c0007", 0] == 2
