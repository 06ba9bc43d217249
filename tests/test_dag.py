"""Job graphs over every row of small tables, against union-find and plain Python."""

from skeinflow import registry

LINES = [(1, 100, 1.0), (1, 200, 2.0), (2, 200, 50.0), (2, 3, 5.0), (3, 7, 1.0), (4, 300, 9.0), (4, 300, 9.0), (5, 51, 46.0)]
SUPPLIERS = [(1, 0), (2, 1), (3, 2), (4, 3), (5, 2), (6, 4)]


def edges():
    return {(f"s{s}", f"p{p}") for s, p, _ in LINES} | {(f"n{n}", f"s{s}") for s, n in SUPPLIERS}


def tables(spark, tmp_path):
    spark.createDataFrame(LINES, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_components_of_every_row(spark, tmp_path):
    root = {x: x for e in edges() for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges():
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {x: top(x) for x in root}
    got = {r.node: r.root for r in registry.queries()["dag_components"](spark, tables(spark, tmp_path)).collect()}
    assert got == want and len(set(want.values())) == 4


def test_ready_of_every_row(spark, tmp_path):
    done = {"p100", "p200", "p300"}
    want = {j for e in edges() for j in e if j not in done and all(dep in done for job, dep in edges() if job == j)}
    got = [r.job for r in registry.queries()["dag_ready"](spark, tables(spark, tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {"s1", "s4", "s6", "p3"} <= want


def test_rounds_get_smaller(spark, monkeypatch):
    """Edges are drawn between what is left: a star of stars is two rounds, and every checkpoint but the labels' shrinks."""
    from pyspark.sql.classic.dataframe import DataFrame

    from skeinflow.plans import placement

    sizes, plain = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *x: (out := plain(self, *x), sizes.append((out.columns, out.count())))[0])
    edges = [(f"n{i % 5}", f"s{i}") for i in range(50)] + [(f"s{i}", f"p{i * 7 % 40}") for i in range(200) if i < 50] + [("p3", "p3"), ("lone", None)]
    got = {r.node: r.root for r in placement.lineage_components(spark.createDataFrame(edges, "job string, dep string")).collect()}
    drawn = [n for c, n in sizes if c == ["a", "b"]]
    assert drawn == sorted(drawn, reverse=True) and drawn[-1] == 0 and drawn[0] < 100
    want = {x: x for e in edges for x in e if x}
    while any(a and b and want[a] != want[b] for a, b in edges):
        for a, b in edges:
            if a and b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
