"""Links of vectors against comparing all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import components
from pyspark.sql import functions as F

from skeinflow.llm import near_vectors


def cosine(a, b):
    if any(v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v) for v in (a, b)) or len(a) != len(b):
        return -1
    a, b = (np.array(v, float) / max(map(abs, v)) for v in (a, b))
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def plain(rows, threshold=0.95):
    links = [(i, j) for i in range(len(rows)) for j in range(i) if cosine(rows[i][1], rows[j][1]) >= threshold]
    count, root = np.zeros(len(rows), int), components(len(rows), links)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    least = [min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return [(k, int(n), c, k == c) for (k, _), n, c in zip(rows, count, least, strict=True)]


def key(r):
    return tuple(str(x) for x in r)


def check(spark, rows, kind="float", threshold=0.95, **extra):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({k: F.lit(v) for k, v in extra.items()})
    got = near_vectors.near_vectors(df, threshold=threshold)
    names = got.columns[-3:]
    assert sorted((tuple(r) for r in got.select("vec_id", *names).collect()), key=key) == sorted(plain(rows, threshold), key=key)
    return got


def around(rng, centre, spread, n):
    return [(centre + spread * rng.standard_normal(len(centre))).astype(np.float32).tolist() for _ in range(n)]


def test_odd_vectors(spark):
    a, b = [3.0, 1.0, 0.0], [19.0, 5.0, 3.0, 2.0, 1.0]
    vectors = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], a, a, [6.0, 2.0, 0.0], [-0.0, 2.0, 0.0], [0.0, 2.0, -0.0], [3.0, 1.0], [-3.0, -1.0, 0.0]]
    vectors += [[1e-30, 1e-31, 0.0], [1e30, 1e29, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0], b, [5.0], [7.0], [-2.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(6, a), (None, a), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (3, b)]
    got = check(spark, rows, N_Links="taken", component_id=1, kept="taken", __unit=2, unit=3, ball=4, id="taken")
    assert got.columns[-3:] == ["n_links_", "component_id_", "kept_"]
    check(spark, [(i, v and [x if x is None else x * 1e200 for x in v]) for i, v in rows], "double")


def test_empty(spark):
    assert check(spark, []).columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    check(spark, [(1, None), (2, [0.0])])


def test_groups(spark):
    """Near copies in balls, groups too wide for a ball, chains, a third of all rows alike, and strangers."""
    rng = np.random.default_rng(3)
    e = np.eye(16)
    vectors = [v for i in range(4) for v in around(rng, e[i], 0.02, 40)]
    vectors += [v for v in around(rng, e[5], 0.05, 90)] + [v for v in around(rng, e[6], 0.065, 90)]
    vectors += [(math.cos(t) * e[7] + math.sin(t) * e[8]).tolist() for t in np.linspace(0, 1.5, 40)]
    vectors += [e[9].tolist()] * 200 + rng.standard_normal((200, 16)).tolist()
    check(spark, [(int(i), v) for i, v in zip(rng.permutation(len(vectors)) * 3, vectors, strict=True)], "double")


def test_lists_grow(spark, monkeypatch):
    """Lists of two, parts of four and blocks of three: all links of groups with no two in one ball are found."""
    for name, value in (("NEIGHBOURS", 2), ("ORDERS", 1), ("LOCAL", 8), ("BLOCK", 3), ("BALL_ROUNDS", 1)):
        monkeypatch.setattr(near_vectors, name, value)
    rng = np.random.default_rng(4)
    centres = np.eye(48)[:3]
    vectors = [v for c in centres for v in around(rng, c, 0.031, 40)] + rng.standard_normal((60, 48)).tolist()
    got = check(spark, list(enumerate(vectors)), "double")
    assert got.agg(F.max("n_links")).first()[0] > 30


def test_other_threshold(spark):
    rng = np.random.default_rng(5)
    check(spark, list(enumerate(rng.standard_normal((150, 4)).tolist())), "double", threshold=0.8)
    with pytest.raises(ValueError):
        near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), threshold=1.5)


def test_audit_counts_what_is_missing(spark):
    units = [np.eye(4)[i % 2].tobytes() for i in range(4)]
    members = spark.createDataFrame([(i, u, 1 + i) for i, u in enumerate(units)], "id long, unit binary, w long")
    links = spark.createDataFrame([(i, u, 0) for i, u in enumerate(units)], "id long, unit binary, n_links long")
    # Rows 0 and 2 (1 + 3) and rows 1 and 3 (2 + 4) are alike: each is linked with all others of its kind.
    assert near_vectors.audit(links, members, 0.95) == (0, 2 * (4 - 1) + 2 * (6 - 1))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_whole_groups(size):
    keys = [0, 0, 0, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    batch = pa.RecordBatch.from_pydict({"k": keys, "v": list(range(len(keys)))})
    out = list(near_vectors.whole_groups((batch.slice(i, size) for i in range(0, len(keys), size)), ["k"]))
    assert [v for b in out for v in b.column("v").to_pylist()] == list(range(len(keys)))
    assert sum(len(set(b.column("k").to_pylist())) for b in out) == 5
