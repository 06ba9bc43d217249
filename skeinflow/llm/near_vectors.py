"""Links of vectors at or above a cosine, by NN-descent over the centres of tight balls.

Equal vectors are one class. Classes within half the linking angle of a centre are its ball: all of them are linked with
each other, so a group of near copies of any size is a few balls, and no pair of its members is ever written. A graph of
the centres' nearest neighbours is refined by comparing neighbours of neighbours until a round finds no pair that may be
linked; centres whose lists hold nothing else get longer lists. Pairs of balls are then judged by their centres and radii
where these decide it, else by their members, block against block.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged
from skeinflow.llm.components import connected_components
from skeinflow.llm.kernels import utf8

THRESHOLD = 0.95
#: First length of the neighbour lists; orders by random hyperplanes that they start from.
NEIGHBOURS, ORDERS = 8, 4
#: Neighbours of one centre that are compared at once; a centre with more has its neighbours dealt anew in each round.
LOCAL = 128
#: Rounds of gathering balls and of refining lists at most; the latter raises.
BALL_ROUNDS, MOST_ROUNDS = 8, 200
#: Vectors compared with all others to audit the links, the share of their links that must be found, attempts.
AUDITED, RECALL, ATTEMPTS = 512, 0.999, 4
#: Members of a ball in a block.
BLOCK = 1024
#: Radians that angles of half precision may be off, and those of double precision.
LOOSE, TIGHT = 4e-3, 1e-7
STATE = "id long, unit binary, r float, k int, near array<long>, gap array<float>, fresh int, full boolean"


def matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Binary values of one length as rows."""
    data, off = utf8(column)
    return np.frombuffer(data.tobytes(), dtype).reshape(len(off) - 1, -1) if len(off) > 1 else np.zeros((0, 0), dtype)


def by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Indexes of the values of each length."""
    size = np.diff(utf8(column)[1])
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def units(column: pa.ListArray) -> list[bytes | None]:
    """Unit vectors as doubles; None for null and zero vectors and those with a null or non-finite component."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start, out = np.cumsum(size) - size, [None] * len(column)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        x = values[start[rows][:, None] + np.arange(n)]
        most = np.abs(x).max(1)
        ok = np.isfinite(x).all(1) & (most > 0)
        # By a power of two, which is exact, so that squares neither overflow nor vanish.
        x = np.ldexp(x[ok], -np.frexp(most[ok])[1][:, None])
        x = x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0
        for i, v in zip(rows[ok].tolist(), x, strict=True):
            out[i] = v.tobytes()
    return out


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by keys, cut so that no group is in two of them."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if held:
            before = [held[-1].column(k)[-1].as_py() for k in keys]
            if not same.all() or any(c[0] != b for c, b in zip(cols, before, strict=True)):
                if not same.all():
                    held.append(batch.slice(0, last))
                    yield joined()
                    held = [batch.slice(last)]
                else:
                    yield joined()
                    held = [batch]
            else:
                held.append(batch)
        else:
            if last:
                yield batch.slice(0, last)
            held = [batch.slice(last)]
    if held:
        yield joined()


def ordered(nodes: DataFrame, seed: int, unit: str, dtype: str) -> DataFrame:
    """nodes by the signs of 62 random projections, dealt by ranges: alike vectors are likely to be in one batch."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for rows in by_length(batch.column(unit)):
                x = matrix(batch.column(unit).take(pa.array(rows)), dtype).astype(np.float32)
                planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], 62)).astype(np.float32)
                code[rows] = (x @ planes > 0) @ (np.int64(1) << np.arange(62, dtype=np.int64)[::-1])
            yield batch.append_column("code", pa.array(code))

    schema = nodes.schema.simpleString()[len("struct<") : -1] + ",code:bigint"
    out = nodes.mapInArrow(coded, schema).withColumn("size", F.octet_length(unit))
    return out.repartitionByRange("size", "code", "id").sortWithinPartitions("size", "code", "id").drop("size", "code")


def gathered(classes: DataFrame, most: float, rounds: int = BALL_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(id, unit, r) of the balls, and (id, ball) of the classes that are in a ball of another.

    A round sorts the centres left by another order; within a batch a centre takes in others, with all they hold, as long
    as its radius stays within most. Rounds end when one takes in less than a hundredth. What stays apart though it
    could be in one ball costs comparisons, and no link.
    """

    def take_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            into, r = ids.copy(), batch.column("r").to_numpy().copy()
            for rows in by_length(batch.column("unit")):
                x = matrix(batch.column("unit").take(pa.array(rows)), "<f8")
                close = x @ x.T >= math.cos(most)
                np.fill_diagonal(close, False)
                some = np.flatnonzero(close.any(1))
                apart, alive = angles(x[some], x[some]), np.ones(len(some), bool)
                for i in np.argsort(-r[rows[some]], kind="stable").tolist():
                    if alive[i]:
                        reach = apart[i] + r[rows[some]]
                        js = alive & (reach <= most)
                        js[i] = False
                        if js.any():
                            into[rows[some[js]]] = ids[rows[some[i]]]
                            r[rows[some[i]]] = max(r[rows[some[i]]], reach[js].max())
                            alive[js] = False
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), pa.array(r), pa.array(into)], ["id", "unit", "r", "into"])

    now, maps = classes.select("id", "unit", F.lit(0.0).alias("r")), []
    for turn in range(rounds):
        done = staged(ordered(now, 1000 + turn, "unit", "<f8").mapInArrow(take_in, "id long, unit binary, r double, into long"), "balls")
        maps.append(done.where("id <> into").select("id", "into"))
        now = done.where("id = into").drop("into")
        left, gone = now.count(), maps[-1].count()
        if 100 * gone < left + gone:
            break
    inside = maps[-1]
    for earlier in reversed(maps[:-1]):
        final = inside.select(F.col("id").alias("__id"), F.col("into").alias("__into"))
        inside = earlier.join(final, F.col("into") == F.col("__id"), "left").select("id", F.coalesce("__into", "into").alias("into")).union(inside)
        inside = staged(inside, "inside")
    return now, inside.select("id", F.col("into").alias("ball"))


def _lists(rows: np.ndarray, near: np.ndarray, gap: np.ndarray, n: int) -> tuple[pa.ListArray, pa.ListArray]:
    """List columns of n rows out of flat values that are sorted by row."""
    off = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(off, pa.array(near)), pa.ListArray.from_arrays(off, pa.array(gap.astype(np.float32)))


def _found(ids: np.ndarray, rows: np.ndarray, near: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    """Candidates as rows of STATE: only ids and lists."""
    lists, n = _lists(rows, near, gap, len(ids)), len(ids)
    none = [pa.nulls(n, t) for t in (pa.binary(), pa.float32(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(ids), *none, *lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_())], [c.split()[0] for c in STATE.split(", ")])


def nearest(gap: np.ndarray, k: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, gap) of the k[i] least values of each row below bar[i], by row."""
    most = min(int(k.max()), gap.shape[1])
    at = np.argpartition(gap, most - 1, axis=1)[:, :most] if most < gap.shape[1] else np.broadcast_to(np.arange(most), gap.shape)
    value = np.take_along_axis(gap, at, 1)
    rows, cols = np.nonzero((value < bar[:, None]) & np.isfinite(value))
    return rows, at[rows, cols], value[rows, cols]


def least(node: np.ndarray, near: np.ndarray, gap: np.ndarray, k: np.ndarray, late: np.ndarray | None = None) -> np.ndarray:
    """Places of the k[i] least gaps of each node i to different others, by node and gap; of equal pairs the first that isn't late."""
    order = np.lexsort((gap, np.zeros(len(gap), bool) if late is None else late, near, node))
    one = np.ones(len(order), bool)
    one[1:] = (node[order][1:] != node[order][:-1]) | (near[order][1:] != near[order][:-1])
    order = order[one]
    order = order[np.lexsort((near[order], gap[order], node[order]))]
    of = node[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < k[of]]


def first_lists(nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """Candidates of each node: the nearest of the batch that one order puts it in."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, r = batch.column("id").to_numpy(), batch.column("r").to_numpy()
            for rows in by_length(batch.column("unit")):
                if len(rows) > 1:
                    x = matrix(batch.column("unit").take(pa.array(rows)), "<f2").astype(np.float32)
                    gap = angles(x, x) - r[rows][:, None] - r[rows]
                    np.fill_diagonal(gap, np.inf)
                    i, j, g = nearest(gap, np.full(len(rows), k), np.full(len(rows), np.inf))
                    yield _found(ids[rows], i, ids[rows][j], g)

    return ordered(nodes, seed, "unit", "<f2").mapInArrow(compare, STATE)


def merged(rows: DataFrame, limit: float) -> DataFrame:
    """The states with all candidates in their lists: the k with the least gaps; fresh: new ones that may be linked;

    full: whether the list has no room and nothing in it that can't be linked.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["id"]):
            ids, of = np.unique(batch.column("id").to_numpy(), return_inverse=True)
            state = batch.column("unit").is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(state)
            k = batch.column("k").take(pa.array(at)).to_numpy()
            size = batch.column("near").value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), size)
            g, old = of[row], state[row]
            near, gap = batch.column("near").flatten().to_numpy(), batch.column("gap").flatten().to_numpy()
            at_ = least(g, near, gap, k, ~old)
            g, old, near, gap = g[at_], old[at_], near[at_], gap[at_]
            many = np.bincount(g, minlength=len(ids))
            fresh = np.bincount(g, ~old & (gap <= limit), len(ids)).astype(np.int32)
            full = (many == k) & (np.bincount(g, gap <= limit, len(ids)) == k)
            taken = batch.take(pa.array(at))
            lists = _lists(g, near, gap, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids), taken.column("unit"), taken.column("r"), taken.column("k"), *lists, pa.array(fresh), pa.array(full)], [c.split()[0] for c in STATE.split(", ")])

    return staged(rows.repartition("id").sortWithinPartitions("id", F.col("unit").isNull()).mapInArrow(merge, STATE), "graph")


def neighbours_of_neighbours(state: DataFrame, turn: int) -> DataFrame:
    """Candidates: any two that have a node in their lists, or are in its list, are compared at that node.

    A node with more than LOCAL such neighbours has them dealt into parts of about that size, by another hash each round:
    none is left out, and two that miss each other meet in a later round, or at another node.
    """
    forth = state.select(F.col("id").alias("centre"), F.explode("near").alias("member"))
    ends = staged(forth.union(forth.select("member", "centre")).distinct(), "ends")
    hubs = ends.groupBy(F.col("centre").alias("hub")).count().where(F.col("count") > LOCAL)
    dealt = ends.join(staged(hubs, "hubs"), F.col("centre") == F.col("hub"), "left")
    part = F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64("member", F.lit(turn)), F.ceil(F.col("count") / LOCAL))).otherwise(0)
    bar = F.when(F.size("near") < F.col("k"), F.lit(float("inf"))).otherwise(F.element_at("gap", -1)).cast("float")
    own_ = state.select("id", "unit", "r", "k", F.coalesce(bar, F.lit(float("inf")).cast("float")).alias("bar"))
    met = dealt.select("centre", part.alias("part"), "member").join(own_, F.col("member") == F.col("id")).drop("member")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["centre", "part"]):
            ids, r, k, bar = (batch.column(c).to_numpy() for c in ("id", "r", "k", "bar"))
            x = [matrix(batch.column("unit").take(pa.array(rows)), "<f2").astype(np.float32) for rows in by_length(batch.column("unit"))]
            where = np.empty(batch.num_rows, np.int64)
            which = np.empty(batch.num_rows, np.int64)
            for n, rows in enumerate(by_length(batch.column("unit"))):
                where[rows], which[rows] = np.arange(len(rows)), n
            c, p = batch.column("centre").to_numpy(), batch.column("part").to_numpy()
            cut = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1]), True])
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    v = x[which[a]][where[a:b]]
                    gap = angles(v, v) - r[a:b, None] - r[a:b]
                    np.fill_diagonal(gap, np.inf)
                    i, j, g = nearest(gap, k[a:b], bar[a:b])
                    out.append((i + a, ids[j + a], g))
            if out:
                # What a batch has for one node is one row, or a hub would get one from each node beside it.
                i, j, g = map(np.concatenate, zip(*out, strict=True))
                nodes, first, of = np.unique(ids, return_index=True, return_inverse=True)
                at = least(of[i], j, g, k[first])
                rows, of = np.unique(of[i[at]], return_inverse=True)
                yield _found(nodes[rows], of, j[at], g[at])

    return met.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(compare, STATE)


def neighbour_graph(nodes: DataFrame, theta: float, k: int = NEIGHBOURS, orders: int = ORDERS, seed: int = 0) -> DataFrame:
    """NN-descent: for each node (id, unit of half precision, r) the k others with the least gaps, angle less both radii.

    Lists start from several orders and are refined by neighbours of neighbours until a round finds no pair that may be
    linked; lists that hold nothing but such pairs are then doubled, and so on until none does.
    """
    limit = theta + LOOSE
    start = nodes.select("id", "unit", F.col("r").cast("float").alias("r"), F.lit(k).alias("k"), F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("gap"), F.lit(0).alias("fresh"), F.lit(False).alias("full"))
    for turn in range(orders):
        start = start.union(first_lists(nodes, k, 100 * seed + turn))
    state = merged(start, limit)
    for turn in range(MOST_ROUNDS):
        state = merged(state.union(neighbours_of_neighbours(state, turn)), limit)
        fresh, full = state.agg(F.sum("fresh"), F.sum(F.col("full").cast("int"))).first()
        if not fresh:
            if not full:
                return state
            state = state.withColumn("k", F.when(F.col("full"), 2 * F.col("k")).otherwise(F.col("k")))
    raise RuntimeError(f"the neighbour graph did not settle in {MOST_ROUNDS} rounds")


def judged_pairs(state: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """(a, b, whole) of the balls with a link between them, or perhaps one: whole if all their members are linked.

    By the centres in double precision; two single vectors are compared outright.
    """
    theta = math.acos(threshold)
    near = F.filter(F.arrays_zip("near", "gap"), lambda x: x["gap"] <= theta + LOOSE)
    pairs = state.select("id", F.inline(near)).select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(balls.select(F.col("id").alias(side), F.col("unit").alias(f"unit_{side}"), F.col("r").alias(f"r_{side}")), side)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column("r_a").to_numpy() + batch.column("r_b").to_numpy()
            keep, whole = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for rows in by_length(batch.column("unit_a")):
                x, y = (matrix(batch.column(c).take(pa.array(rows)), "<f8") for c in ("unit_a", "unit_b"))
                cos = (x * y).sum(1)
                apart = np.arccos(np.clip(cos, -1, 1))
                single = r[rows] == 0
                whole[rows] = np.where(single, cos >= threshold, apart + r[rows] <= theta - TIGHT)
                keep[rows] = np.where(single, cos >= threshold, apart - r[rows] <= theta + TIGHT)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(whole)], ["a", "b", "whole"]).filter(pa.array(keep))

    return staged(pairs.mapInArrow(judge, "a long, b long, whole boolean"), "pairs")


def linked_members(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): n rows linked to class a, b null, for each block that a is compared with; and (a, b, 0) for linked balls.

    members: id, ball, w (rows), unit. A ball's members are in blocks of about BLOCK; two blocks meet in one row, and only
    counts come out, so that balls of any size are compared in bounded memory and without a row for a pair.
    """
    used = pairs.select(F.col("a").alias("ball")).union(pairs.select("b")).distinct()
    mine = staged(members.join(used, "ball"), "members")
    many = mine.groupBy("ball").count()
    dealt = mine.join(many, "ball").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / BLOCK)))
    blocks = staged(dealt.groupBy("ball", "block").agg(F.collect_list(F.struct("id", "w", "unit")).alias("m")).select("ball", "m.id", "m.w", "m.unit"), "blocks")
    for side in "ab":
        pairs = pairs.join(blocks.select(F.col("ball").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("id", "w", "unit"))), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, other, count = [], [], []
            for i in range(batch.num_rows):
                id_a, w_a, id_b, w_b = (batch.column(c)[i].values.to_numpy() for c in ("id_a", "w_a", "id_b", "w_b"))
                x, y = (matrix(batch.column(c)[i].values, "<f8") for c in ("unit_a", "unit_b"))
                linked = x @ y.T >= threshold
                if linked.any():
                    for ids, n in ((id_a, linked @ w_b), (id_b, w_a @ linked)):
                        who.append(ids[n > 0])
                        count.append(n[n > 0])
                        other.append(np.full(len(who[-1]), -1))
                    who.append(np.array([batch.column("a")[i].as_py()]))
                    other.append(np.array([batch.column("b")[i].as_py()]))
                    count.append(np.zeros(1, np.int64))
            if who:
                b = np.concatenate(other)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), pa.array(b, mask=b < 0), pa.array(np.concatenate(count).astype(np.int64))], ["a", "b", "n"])

    return staged(pairs.mapInArrow(compare, "a long, b long, n long"), "linked")


def link_counts(state: DataFrame, balls: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(id, unit, n_links, component_id) of each class: rows linked to one of its rows, the least key reachable."""
    pairs = judged_pairs(state, balls, threshold)
    sums = staged(members.groupBy("ball").agg(F.sum("w").alias("rows"), F.min("least").alias("least")), "sums")
    linked = linked_members(pairs.where("not whole"), members, threshold)
    whole = pairs.where("whole").select("a", "b")
    sizes = sums.select(F.col("ball").alias("b"), "rows")
    beside = whole.union(whole.select("b", "a")).join(sizes, "b").groupBy("a").agg(F.sum("rows").alias("beside"))
    part = linked.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = connected_components(whole.union(linked.where("b is not null").select("a", "b")))
    of = sums.join(roots, F.col("ball") == F.col("node"), "left").select("ball", "rows", "least", F.coalesce("root", "ball").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    per = staged(of.join(least, "root").join(beside.withColumnRenamed("a", "ball"), "ball", "left").select("ball", "component_id", (F.col("rows") - 1 + F.coalesce("beside", F.lit(0))).alias("many")), "per_ball")
    out = members.join(per, "ball").join(part.withColumnRenamed("a", "id"), "id", "left")
    return staged(out.select("id", "unit", (F.col("many") + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "links")


def audit(links: DataFrame, members: DataFrame, threshold: float, queries: int = AUDITED) -> tuple[int, int]:
    """(links found, links there are) of a sample of classes by hash, each compared with all rows: the recall's two parts.

    A bounded number of vectors is broadcast, and every task sends one row for each batch and vector with links.
    """
    asked = links.orderBy(F.xxhash64("unit"), "id").limit(queries).select("id", "unit", "n_links").collect()
    if not asked:
        return 0, 0
    by_size: dict[int, np.ndarray] = {}
    for size in {len(r.unit) for r in asked}:
        by_size[size] = np.stack([np.frombuffer(r.unit, "<f8") for r in asked if len(r.unit) == size])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = 0, batch.column("w").to_numpy()
            for rows in by_length(batch.column("unit")):
                x = matrix(batch.column("unit").take(pa.array(rows)), "<f8")
                if (q := by_size.get(8 * x.shape[1])) is not None:
                    n += int(((q @ x.T >= threshold) @ w[rows]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    there = members.select("unit", "w").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    # Each finds itself as often as it is there, and its own row isn't a link.
    return sum(r.n_links for r in asked), there - len(asked)


def near_vectors(df: DataFrame, vec: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """df with n_links, component_id and kept (a taken name gets a _): links are pairs of rows with cosine >= threshold.

    n_links counts the other rows that a row is linked with, equal ones among them; component_id is the least key
    reachable by links; kept says that it is the row's own. A vector that is null, empty, zero or holds a null or
    non-finite component is linked with nothing, and so are vectors of different lengths. A null key is never the least
    unless all of a component are null; rows that share a key count each. An empty table stays empty.

    Every link that comes out is one. Lists are refined until an audit of AUDITED vectors against all rows finds RECALL of
    their links; should that fail ATTEMPTS times, each with lists twice as long and other orders, a warning says so.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    n_links, component, kept, unit = own(df, "n_links", "component_id", "kept", "__unit")
    k, spark = F.col(quoted(key)), df.sparkSession
    listed = df.withColumn(unit, F.col(quoted(vec)).cast("array<double>"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.num_columns - 1, unit, pa.array(units(batch.column(batch.num_columns - 1)), pa.binary()))

    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*df.schema.fields]).add(unit, BinaryType())
    rows = staged(listed.mapInArrow(make, schema), "vectors")
    classes = rows.where(F.col(unit).isNotNull()).groupBy(F.col(unit).alias("unit")).agg(F.min(k).alias("least"), F.count("*").alias("w"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    balls, inside = gathered(classes, math.acos(threshold) / 2 - TIGHT)
    members = classes.join(inside, "id", "left").select("id", "unit", "least", "w", F.coalesce("ball", "id").alias("ball"))
    members = staged(members, "members")

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit_ = [np.frombuffer(u.as_py(), "<f8").astype("<f2").tobytes() for u in batch.column("unit")]
            yield batch.set_column(1, "unit", pa.array(unit_, pa.binary()))

    nodes = staged(balls.select("id", "unit", "r").mapInArrow(halve, "id long, unit binary, r double"), "nodes")
    for attempt in range(ATTEMPTS):
        graph = neighbour_graph(nodes, math.acos(threshold), NEIGHBOURS << attempt, ORDERS << attempt, attempt)
        links = link_counts(graph, balls, members, threshold)
        found, there = audit(links, members, threshold)
        if found >= RECALL * there:
            break
    else:
        warnings.warn(f"near_vectors: {found} of {there} links of the audited vectors were found", stacklevel=2)
    per = links.select(F.col("unit").alias("__of"), F.col("n_links").alias("__n"), F.col("component_id").alias("__component"))
    plain = [F.col(quoted(c)) for c in df.columns]
    with_links = rows.where(F.col(unit).isNotNull()).join(per, F.col(unit) == F.col("__of")).select(*plain, F.col("__n").alias(n_links), F.col("__component").alias(component))
    alone = rows.where(F.col(unit).isNull()).select(*plain, F.lit(0).cast("long").alias(n_links), k.alias(component))
    out = with_links.union(alone)
    return out.withColumn(kept, k.eqNullSafe(F.col(component)))


def op12_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector its links at a cosine of 0.95 or more, its component and whether it is the one that stays; see near_vectors()."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return near_vectors(vectors).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


ORACLE = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
ok as (select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
link as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
n as (select a, count(*) as n_links from link group by 1),
c as (select a, least(a, min(b)) as component_id from reach group by 1)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from v left join n on n.a = vec_id left join c on c.a = vec_id
"""
