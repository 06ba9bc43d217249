"""The Merkle manifest against a tree built node by node."""

import hashlib
import zlib

import pytest
from helpers import documents
from pyspark.sql import functions as F

from skeinflow.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, for each node what stands beside its way up)."""
    beside, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(beside, at, strict=True):
            run = range(i - i % 2, min(i - i % 2 + 2, len(nodes)))
            way.append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], beside


def plain(rows):
    """rows of (doc_id, text, lang, source, n_chars); the result's rows."""
    made = {}
    for i, t, lang, s, n in rows:
        made.setdefault(lang, []).append((i is not None, i or 0, leaf(i, s, lang, n, t), i, s, n, t))
    order = sorted(made, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(made[x], key=lambda r: r[:3])]) for x in order}
    root, above = tree([trees[x][0] for x in order]) if order else (None, [])
    out = []
    for x, over in zip(order, above, strict=True):
        for (*_, h, i, s, n, t), own in zip(sorted(made[x], key=lambda r: r[:3]), trees[x][1], strict=True):
            now = leaf(i, s, x, n + 1, t) if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else h
            for left, right in own + over:
                now = sha(*left, now, *right)
            out.append((i, h, trees[x][0], root, sha(*(y for left, right in own + over for y in left + right)), now, now == root))
    return out


def key(r):
    return tuple(str(x) for x in r)


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, documents(spark, []).schema).withColumn("node", F.lit("taken")).withColumn("__key", F.lit(1)).withColumn("pos", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)
    return got


def test_query(spark, tmp_path):
    rows = [(i * 3, f"text {i} é" if i % 4 else None, "en" if i % 3 else "dé", f"s{i}" if i % 5 else None, i if i % 6 else None) for i in range(-20, 700)]
    rows += [(None, "a", "en", "s", 1), (None, "b", "en", "s", 1), (5, "x", None, "s", 1), (7, "", None, "", 0), (8, "lone", "zz", "s", 4), (9, "three", "aa", "s", 1), (12, "of", "aa", "s", 1), (10, "them", "aa", "s", 1)]
    rows += [(30, "again", "en", "s", 5)] * 3 + [(30, "other", "en", "s", 5)] + [(4000, "long " * 50000, "en", "s", 250000)]
    got = check(spark, tmp_path, rows)
    assert 0 < sum(not r.verified for r in got) < len(got) / 4


@pytest.mark.parametrize("n", [0, 1, 2, 257])
def test_sizes(spark, tmp_path, n):
    check(spark, tmp_path, [(i, str(i), "en", "s", i) for i in range(n)])


def test_deep_trees(spark, monkeypatch):
    """Blocks of four nodes: a tree of many tables, groups of sizes around its powers, one row repeated."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    sizes = [1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 257]
    rows = [(i, f"g{n}", "same" if i % 2 else "x") for n in sizes for i in range(n)] + [(1, "g5", "x")] * 40
    made = merkle.manifest(spark.createDataFrame(rows, "path long, root string, leaf string"), "path", "root", ("leaf", "path"))
    groups = {}
    for i, g, t in rows:
        groups.setdefault(g, []).append((i, leaf(t, i)))
    order = sorted(groups)
    want = {g: tree([h for _, h in sorted(groups[g])]) for g in order}
    assert {r.root: r.subroot for r in made.subroots.collect()} == {g: want[g][0] for g in order}
    assert made.root == tree([want[g][0] for g in order])[0]
    rows = made.proofs.withColumn("top", merkle.folded(F.col("leaf"), F.col("path_"))).collect()
    assert len(rows) == sum(map(len, groups.values())) and {r.top for r in rows} == {made.root}


def test_what_changes_the_root(spark):
    docs = documents(spark, [f"t{i}" for i in range(20)])
    root = merkle.manifest(docs).root
    assert merkle.manifest(docs.repartition(3)).root == root
    assert merkle.manifest(docs.where("doc_id <> 3")).root != root
    assert merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit("t3 ")).otherwise(F.col("text")))).root != root
    assert merkle.manifest(docs.limit(0)).root is None
