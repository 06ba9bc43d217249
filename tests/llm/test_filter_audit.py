"""The filter audit against applying the filters one by one."""

from itertools import permutations

import pytest
from helpers import SPACED, documents
from pyspark.sql import functions as F
from test_llm import corpus, prose

from skeinflow.llm import filter_audit


def plain(rows, filters, lost):
    """rows: (part, set of failed filters, set of the lost conditions that hold). The result's rows by applying each order."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed = {f: 0 for f in filters}
        for order in permutations(filters):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                removed[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), *(sum(k in r[2] for r in gone) for k in lost), f]
        for key, x in out.items():
            if key[0] == part:
                x[-1] = removed[x[-1]]
    return out


def result(df):
    names = [c for c in df.columns if c not in ("part", "filter_order", "step")]
    rows = {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def write(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string, A boolean").write.parquet(f"{tmp_path}/labels.parquet")


def test_query(spark, tmp_path):
    texts = [*corpus(), None, "", "", "A# b", "ABC DEF", prose(250), "x y " * 150, *("copy " * 210,) * 5, *(f"{prose(220)} {'%' * (i % 2)}" for i in range(6))]
    ids = [None, 3, 3, *range(3, len(texts))]
    sources = [None if i % 5 == 0 else "" if i % 5 == 1 else f"s{i % 5}" for i in range(len(texts))]
    rows = [(i, t, "en", s, 0) for i, t, s in zip(ids, texts, sources, strict=True)]
    docs = spark.createDataFrame(rows, documents(spark, []).schema).withColumn("part", F.lit("taken")).withColumn("A", F.lit(True)).withColumn("digest", F.lit(1))
    labels = [(i, (i or 0) % 2, (i or 0) % 3 == 0 and 1 or 0, "p", True) for i in [None, *range(0, len(texts), 2), 4, 4]] + [(3, None, 1, "p", None), (5, 1, None, "p", None), (5, 0, 0, "p", None)]
    write(spark, tmp_path, docs, labels)
    good, toxic = {i for i, q, *_ in labels if q == 1}, {i for i, _, x, *_ in labels if x == 1}
    least = {}
    for i, t in zip(ids, texts, strict=True):
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = []
    for i, t, s in zip(ids, texts, sources, strict=True):
        t = t or ""
        w = SPACED.findall(t)
        tests = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]}
        want.append((s or "", {f for f, bad in tests.items() if bad}, {k for k, of in (("good", good), ("toxic", toxic)) if i is not None and i in of}))
    assert {f for r in want for f in r[1]} == set("ABCDE")
    assert result(filter_audit.op11_filter_audit(spark, str(tmp_path))) == plain(want, "ABCDE", ("good", "toxic"))


def test_empty(spark, tmp_path):
    write(spark, tmp_path, documents(spark, []), [])
    assert filter_audit.op11_filter_audit(spark, str(tmp_path)).collect() == []


def test_any_filters(spark):
    rows = [("p" if i % 3 else None, bool(i & 1), None if i % 7 == 0 else bool(i & 2), bool(i & 4), i) for i in range(60)]
    df = spark.createDataFrame(rows, "src string, x boolean, y boolean, z boolean, kept long")
    got = result(filter_audit.audit_filters(df, ["x", "y", "z"], "src", {"odd": F.col("kept") % 2 == 1}))
    want = [(p, {n for n, v in zip("xyz", flags, strict=True) if v}, {"odd"} if i % 2 else set()) for p, *flags, i in rows]
    assert got == plain(want, "xyz", ("odd",))
    assert filter_audit.audit_filters(df.limit(0), ["x", "y"], "src").collect() == []
    for bad in ([], ["x", "x"], [f"f{i}" for i in range(9)]):
        with pytest.raises(ValueError):
            filter_audit.audit_filters(df, bad, "src")
