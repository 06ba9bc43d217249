"""Jaccard join of documents on word shingles in metric space, exact, and its components.

Distances of shingle sets (one minus Jaccard) obey the triangle inequality. Almost all pairs of documents share nothing
and lie at distance one, where no document cuts anything off as a pivot. So sets are first freed of those that have too
many shingles to themselves to be linked with anything, and the first regions are around virtual pivots, parts of
documents: a set is dealt to classes by hash, more classes than a linked pair may differ in shingles, and sets meet
where a whole class is equal (some class must be, by pigeonhole). Sets that meet in turn form regions. In a region
document pivots do cut: each set belongs to its nearest pivot's Voronoi cell, sets within the triangle inequality's
window are replicated to the pivot's region, and regions are joined recursively, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.base import drop_staged, own, quoted, staged
from skeinflow.llm.components import connected_components
from skeinflow.llm.kernels import Words, mix, pieces, ranges, trim, windows, word_key
from skeinflow.llm.sketches import bits_for, maybe_repeated, merged, partial_rows

U = np.uint64
#: Keys of 8 bytes that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Words of a shingle; per cent of the union that linked sets share.
SHINGLE, PERCENT = 3, 90
#: Bytes of text that a task deals with together; sets that are compared all with all; pivots of a region.
PIECE, LEAF, PIVOTS = 4 << 20, 256, 8
#: Bytes of sets of a region beyond which Spark splits it, and rounds of pivots after which what is still larger is compared in blocks.
REGION_BYTES, ROUNDS = 32 << 20, 6
#: Shingles in so many sets, and in such a part of them, are common; of common ones so many are told apart at most.
COMMON, COMMON_PART, MOST_COMMON = 64, 1 / 400, 200_000


# --- sets ----------------------------------------------------------------------------------------------------------


def shingle_sets(column: pa.Array, k: int = SHINGLE, secret: bytes | None = None) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; of fewer words the whole sequence as one; else empty."""
    w = Words(column, lower=True, key=secret)
    g = windows(w.hash, k)
    out = []
    short = {n: windows(w.hash, n) for n in set(w.count[w.count < k].tolist()) if n}
    for a, n in zip(w.ptr[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(g[a : a + n - k + 1]))
        else:
            out.append(mix(short[n][a : a + 1] ^ U(n)) if n else np.zeros(0, U))
    return out


def set_id(s: np.ndarray) -> tuple[bytes, int]:
    """A 128-bit id of a set, and the 64-bit key that it goes by among candidates."""
    two = np.array([mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U) + U(len(s)), mix(s + U(0x9E3779B97F4A7C15)).sum(dtype=U)], U)
    return two.tobytes(), int(mix(two)[0].view(np.int64))


# --- virtual pivots ------------------------------------------------------------------------------------------------


def band_of(n: int) -> tuple[int, int, int]:
    """(band, least size, size beyond it): bands of sizes 1-9, 10-14, 15-21, ... half as large again each."""
    b, lo, hi = 0, 1, 10
    while n >= hi:
        b, lo, hi = b + 1, hi, hi + hi // 2
    return b, lo, hi


@lru_cache(4096)
def spare_classes(least: int, apart: int) -> int:
    """Classes beyond what differences take up, so many that sets of the band rarely have more empty ones."""
    for spare in range(2, apart + 3):
        m = apart + 1 + spare
        empty = m * exp(-least / m)
        if empty + 4 * sqrt(empty) + 0.5 <= spare:
            break
    return spare


def most_apart(hi: int, percent: int) -> int:
    """The most shingles that two linked sets of sizes below hi differ in: the symmetric difference is (100 - p) / (100 + p) of the sizes' sum at most."""
    return 2 * (hi - 1) * (100 - percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the set's classes. Linked sets that aren't equal have one in common.

    Sets meet in the band of the larger one: a set signs for its own band and for those of the larger sizes that it may
    be linked to. There are more classes than differences by some to spare, so that among the equal ones is one that
    isn't empty. Common shingles (sorted hashes) are left out of classes at first: what is left of linked sets differs
    in no more. A set with more empty classes than those to spare, as its linked ones must have too where only empty
    classes are equal, signs with all its shingles as well, and then for empty classes too if it must.
    """
    n, out = len(s), []
    if not n:
        return np.zeros(0, U)
    rare = s
    if common is not None and len(common):
        rare = s[common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s]
    top = n * 100 // percent
    at = band_of(n)
    bands = {at}
    while at[2] <= top:
        at = band_of(at[2])
        bands.add(at)
    for band, lo, hi in bands:
        apart = most_apart(hi, percent)
        if not apart:
            continue
        spare = spare_classes(max(1, lo * percent // 100), apart)
        m = apart + 1 + spare
        for turn, part in enumerate((rare, s)):
            c = (mix(part ^ U(band + 1)) % U(m)).astype(np.int64)
            value = np.zeros(m, U)
            np.add.at(value, c, mix(part + U(0x632BE59BD9B4E019)))
            count = np.bincount(c, minlength=m)
            sign = mix(value + mix(np.arange(m, dtype=U) + U(band << 32 | turn << 31)) + count.astype(U))
            few = (count == 0).sum() <= spare
            out.append(sign if turn and not few else sign[count > 0])
            if few:
                break
    return np.concatenate(out) if out else np.zeros(0, U)


def common_shingles(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many sets (node, elements) have. It only spares candidates: any list would do.

    Tasks send what they see four times or more; the most frequent reach the driver, MOST_COMMON at most.
    """

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sets_as_given(batches):
            if held:
                tokens, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[n > 3].view(np.int64)), pa.array(n[n > 3])], ["token", "n"])

    least = max(COMMON, int(sets.count() * COMMON_PART))
    seen = sets.select("node", "elements").mapInArrow(see, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.token for r in seen.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect()], np.int64).view(U))


SIGNED = "bucket int, signs binary, keys binary, ends binary"


def _star(signs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signs, the least key of each, and edges (2 x n, distinct) from its other keys to that one."""
    o = np.lexsort((keys, signs))
    signs, keys = signs[o], keys[o]
    first = np.flatnonzero(np.append(True, signs[1:] != signs[:-1]))
    least = np.repeat(keys[first], np.diff(np.append(first, len(signs))))
    other = keys != least
    edges = np.unique(np.stack((keys[other], least[other]), 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return signs[first], keys[first], edges


def _cuts(a: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
    return list(zip(first, np.append(first[1:], len(a)) if len(a) else [], strict=True))


def _batch(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in names.split(", ")])


TOKENS = "bucket int, chunk long, tokens binary, docs binary, spare binary"
COUNTS = "chunk long, docs binary, counts binary, spare binary"


def sets_of_texts(column: str, k: int, secret: bytes) -> Callable:
    """For not_alone(): pieces of a text column as {key: set}."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, np.ndarray]]:
        for batch in pieces(batches, column, PIECE):
            yield {set_id(s)[1]: s for piece in pieces(iter([batch]), column) for s in shingle_sets(piece.column(column), k, secret) if len(s)}

    return groups


def sets_as_given(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, np.ndarray]]:
    """For not_alone(): rows (node, elements) as {key: set}, 4 MB or so together."""
    held, size = {}, 0
    for batch in batches:
        for key, raw in zip(batch.column("node").to_pylist(), batch.column("elements"), strict=True):
            held[key] = np.frombuffer(raw.as_buffer(), U)
            size += held[key].nbytes
            if size > PIECE:
                # The batch's memory isn't ours to keep.
                yield held
                held, size = {}, 0
        held = {k: v.copy() for k, v in held.items()}
    yield held


def not_alone(rows: DataFrame, groups: Callable, percent: int, buckets: int, share: float = 1.0) -> DataFrame:
    """(node): keys of the sets that may be linked with another one.

    Linked sets x and y have |x without y| <= (100 - p) % of |x|, so a set with more shingles than that of its own
    is linked with none. share is the part of all hashes that is counted: of all texts twice (100 - p) % finds most such
    sets; those left over are counted whole. Shingles go out by bucket, those that a piece holds twice once and without
    a document, and come back as numbers for each piece's documents.
    """
    part = U(min((1 << 64) - 1, int((1 << 64) * share)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches):
            if not whole:
                continue
            size = [len(s) for s in whole.values()]
            sets = {key: s[mix(s ^ U(0x7FB5D329728EA185)) <= part] for key, s in whole.items()}
            keys = np.fromiter(sets, np.int64, len(sets))
            tokens = np.concatenate(list(sets.values()))
            doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets.values()])
            tokens, first, n = np.unique(tokens, return_index=True, return_counts=True)
            doc = np.where(n > 1, -1, doc[first]).astype(np.int32)
            bucket = (mix(tokens) % U(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            chunk = int(mix(np.array([mix(keys.view(U)).sum(dtype=U) + U(len(keys))], U))[0].view(np.int64))
            rows = [(int(bucket[o[a]]), chunk, tokens[o[a:b]].tobytes(), doc[o[a:b]].tobytes(), None) for a, b in _cuts(bucket[o])]
            rows.append((buckets + chunk % buckets, chunk, None, keys.tobytes(), (np.array(size) * (100 - percent) // 100).astype(np.int32).tobytes()))
            yield _batch(rows, TOKENS, pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, tokens, docs, out = [], [], [], []
        for batch in batches:
            for c, t, d, s in zip(*(batch.column(x).to_pylist() for x in ("chunk", "tokens", "docs", "spare")), strict=True):
                if t is None:
                    out.append((c, d, None, s))
                else:
                    chunks.append(c), tokens.append(np.frombuffer(t, U)), docs.append(np.frombuffer(d, np.int32))
        if chunks:
            of = np.repeat(np.arange(len(chunks)), [len(t) for t in tokens])
            doc = np.concatenate(docs)
            _, first, n = np.unique(np.concatenate(tokens), return_index=True, return_counts=True)
            lone = np.sort(first[n == 1])
            lone = lone[doc[lone] >= 0]
            for a, b in _cuts(of[lone]):
                who, times = np.unique(doc[lone[a:b]], return_counts=True)
                out.append((chunks[of[lone[a]]], who.astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), None))
        yield _batch(out, COUNTS, pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = spare = np.zeros(0, np.int64)
        who, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for batch in batches:
            for d, c, s in zip(*(batch.column(x).to_pylist() for x in ("docs", "counts", "spare")), strict=True):
                if c is None:
                    keys, spare = np.frombuffer(d, np.int64), np.frombuffer(s, np.int32)
                else:
                    who.append(np.frombuffer(d, np.int32)), times.append(np.frombuffer(c, np.int32))
        lone = np.bincount(np.concatenate(who), np.concatenate(times), len(keys))
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(keys[lone <= spare])], ["node"])

    counted = rows.mapInArrow(send, TOKENS).groupBy("bucket").applyInArrow(count, COUNTS)
    return counted.groupBy("chunk").applyInArrow(settle, "node long")


def candidate_edges(sets: DataFrame, percent: int, buckets: int, common: np.ndarray | None = None) -> DataFrame:
    """(a, b): keys of sets (node, elements) that share a signature, as stars. A task settles its own and sends each

    signature once, with one key, so a signature that a third of all sets share is a row for each half million at most.
    """

    shared = sets.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(x) for x in parts.values()]
            if not sum(sizes):
                return
            signs, keys, edges = _star(np.concatenate(list(parts.values())), np.repeat(np.fromiter(parts, np.int64, len(parts)), sizes))
            bucket = (signs % U(buckets)).astype(np.int64)
            o = np.argsort(bucket, kind="stable")
            rows = [(int(bucket[o[a]]), signs[o[a:b]].tobytes(), keys[o[a:b]].tobytes(), None) for a, b in _cuts(bucket[o])]
            if len(edges):
                rows.append((buckets + int(signs[0] % U(buckets)), None, None, edges.tobytes()))
            yield _batch(rows, SIGNED, pa.int32(), pa.binary(), pa.binary(), pa.binary())

        for batch in batches:
            for key, raw in zip(batch.column("node").to_pylist(), batch.column("elements"), strict=True):
                if key not in parts:
                    parts[key] = signatures(np.frombuffer(raw.as_buffer(), U), percent, shared.value)
                    held += len(parts[key])
                if held > 1 << 19:
                    yield from flush()
                    parts, held = {}, 0
        yield from flush()

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, keys, edges = [], [], [np.zeros((0, 2), np.int64)]
        for batch in batches:
            for s, c, e in zip(*(batch.column(x).to_pylist() for x in ("signs", "keys", "ends")), strict=True):
                if e is None:
                    signs.append(np.frombuffer(s, U)), keys.append(np.frombuffer(c, np.int64))
                else:
                    edges.append(np.frombuffer(e, np.int64).reshape(-1, 2))
        if signs:
            edges.append(_star(np.concatenate(signs), np.concatenate(keys))[2])
        both = np.concatenate(edges)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return sets.select("node", "elements").mapInArrow(sign, SIGNED).groupBy("bucket").applyInArrow(meet, "a long, b long")


# --- regions -------------------------------------------------------------------------------------------------------


class Region:
    """Sets of one region in memory; join() gives links that connect what is linked, not every pair."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        # A shingle of one set alone is in no intersection.
        keep = count > 1
        number = np.cumsum(keep) - 1
        self.columns = int(keep.sum())
        held = keep[column]
        self.flat = number[column[held]]
        owner = np.repeat(np.arange(len(sets)), self.size)[held]
        self.ptr = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.links: list[tuple[int, int]] = []

    def part(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row among ids, column) of all their shingles."""
        n = self.ptr[ids + 1] - self.ptr[ids]
        return np.repeat(np.arange(len(ids)), n), self.flat[ranges(self.ptr[ids], n)]

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)

    def join(self) -> list[tuple[int, int]]:
        self._join(np.flatnonzero(self.size > 0))
        return self.links

    def _join(self, ids: np.ndarray) -> None:
        eps = 1 - self.percent / 100
        # Sets farther than that from all pivots form a region of their own; within eps of it is still below one.
        far = 1 - 2 * eps
        while len(ids) > 1:
            # Who has too many shingles to itself here is linked with no one here.
            row, column = self.part(ids)
            shared = np.bincount(row[np.bincount(column, minlength=self.columns)[column] > 1], minlength=len(ids))
            may = 100 * shared >= self.percent * self.size[ids]
            if may.all():
                break
            ids = ids[may]
        if len(ids) <= LEAF:
            return self._all(ids)
        pivots = ids[:: -(-len(ids) // PIVOTS)]
        row, column = self.part(ids)
        d = np.empty((len(ids), len(pivots)))
        for j, p in enumerate(pivots):
            mine = np.zeros(self.columns, bool)
            mine[self.flat[self.ptr[p] : self.ptr[p + 1]]] = True
            shared = np.bincount(row[mine[column]], minlength=len(ids))
            d[:, j] = 1 - shared / (self.size[ids] + self.size[p] - shared)
            self.links += [(int(p), int(x)) for x in ids[self.linked(shared, self.size[ids], self.size[p])] if x != p]
        near, slack = d.min(1), 1e-9
        regions = [ids[near > far]]
        for j in range(len(pivots)):
            inside = d[:, j] <= np.minimum(far + eps, near + 2 * eps) + slack
            # What links to the pivot is joined already; it matters only to others, and only within eps of them.
            core = inside & (d[:, j] <= eps - slack)
            shell = inside & ~core
            if shell.any():
                regions.append(ids[shell | core & (d[:, j] >= d[shell, j].min() - eps - slack)])
        # Where windows overlap so much that parts cost more than half of the whole, the whole is compared at once.
        if 2 * sum(len(r) ** 2 for r in regions) > len(ids) ** 2:
            self._all(ids)
        else:
            for r in regions:
                self._join(r)

    def _all(self, ids: np.ndarray) -> None:
        """All with all, as blocks of matrix products over the shared columns; labels say what is joined so far."""
        n = len(ids)
        if n < 2:
            return
        row, column = self.part(ids)
        used, column = np.unique(column, return_inverse=True)
        o = np.argsort(column, kind="stable")
        row, column = row[o], column[o]
        width, block = max(64, min(len(used), (4 << 20) // n)), max(64, (4 << 20) // n)
        cuts = np.searchsorted(column, np.arange(0, len(used) + width, width))
        size, label = self.size[ids].astype(float), np.arange(n)
        for at in range(0, n, block):
            shared = np.zeros((min(block, n - at), n), np.float32)
            for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                x = np.zeros((n, width), np.float32)
                x[row[lo:hi], column[lo:hi] - i * width] = 1
                shared += x[at : at + block] @ x.T
            hit = self.linked(shared.astype(float), size[at : at + block, None], size[None])
            for k in np.flatnonzero(hit.sum(1) > 1).tolist():
                found = label[hit[k]]
                if (found != found[0]).any():
                    groups, first = np.unique(found, return_index=True)
                    mates = np.flatnonzero(hit[k])[first]
                    self.links += [(int(ids[at + k]), int(ids[m])) for m in mates.tolist() if m != at + k]
                    label[np.isin(label, groups)] = groups[0]


LINK = "a binary, b binary"


def _join_regions(members: DataFrame, percent: int, total: int) -> DataFrame:
    """Links of regions that fit into memory; many small ones share a task's group, which holds 8 MB of sets or so."""
    groups = max(64, total // (8 << 20))

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        root = np.array(table.column("root"))
        ids, raw = table.column("sid").to_pylist(), table.column("elements").to_pylist()
        o = np.lexsort((np.arange(len(root)), root))
        cut = np.flatnonzero(np.append(True, root[o][1:] != root[o][:-1])) if len(o) else []
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(o)) if len(o) else [], strict=True):
            if b - a > 1:
                here = sorted(o[a:b].tolist(), key=lambda i: ids[i])
                out += [(ids[here[x]], ids[here[y]]) for x, y in Region([np.frombuffer(raw[i], U) for i in here], percent).join()]
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    return members.withColumn("g", F.pmod(F.xxhash64("root", F.lit(5)), F.lit(groups))).groupBy("g").applyInArrow(join, LINK)


ROUND = "root long, sid binary, elements binary, d double, a binary, b binary"


def _pivot_round(big: DataFrame, percent: int, no: int) -> DataFrame:
    """One Voronoi split of regions too large for a task: rows of the new regions, with the distance to their pivot, and links.

    A pivot for each of PIVOTS slots of a region, by hash; regions' pivots, a bounded row each, are joined to the members.
    """
    slot = F.pmod(F.xxhash64("sid", F.lit(no)), F.lit(PIVOTS))
    one = big.groupBy("root", slot.alias("slot")).agg(F.min_by(F.struct("sid", "elements"), F.xxhash64("sid", F.lit(no + 99))).alias("p"))
    pivots = staged(one.groupBy("root").agg(F.collect_list(F.struct("slot", "p.sid", "p.elements")).alias("pivots")), "pivots")
    eps, slack = 1 - percent / 100, 1e-9
    far = 1 - 2 * eps

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s = np.frombuffer(r["elements"], U)
                d, linked = [], []
                for p in r["pivots"]:
                    t = np.frombuffer(p["elements"], U)
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    both = len(s) + len(t) - shared
                    d.append(1 - shared / both)
                    if p["sid"] != r["sid"] and 100 * shared >= percent * both:
                        rows.append((0, None, None, None, r["sid"], p["sid"]))
                near = min(d)
                for p, x in zip(r["pivots"], d, strict=True):
                    if x <= min(far + eps, near + 2 * eps) + slack:
                        rows.append((hash((r["root"], p["slot"], no)) >> 1, r["sid"], r["elements"], x, None, None))
                if near > far:
                    rows.append((hash((r["root"], -1, no)) >> 1, r["sid"], r["elements"], 2.0, None, None))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in ROUND.split(", ")])

    return staged(big.join(pivots, "root").mapInArrow(split, ROUND), "round")


def _join_blocks(large: DataFrame, percent: int, most: int) -> DataFrame:
    """Links of regions that pivots don't make smaller, (root, sid, elements, n): parts of half the bytes that fit, each two of them in a task of their own.

    Exact whatever the region looks like; its cost grows with the square of the region's size, spread over tasks.
    """
    parts = F.ceil(2 * F.col("n") / most).cast("long")
    mine = large.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts")))
    pairs = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = pairs.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("root"), "sid", "elements")
    total = pairs.agg(F.sum(F.length("elements"))).first()[0] or 0
    return _join_regions(pairs, percent, total)


def region_links(members: DataFrame, percent: int = PERCENT, most: int = REGION_BYTES) -> DataFrame:
    """(a, b) links among members (root, sid, elements) of each region, enough to connect whatever is linked in it."""
    eps, out = 1 - percent / 100, None
    for no in range(ROUNDS + 1):
        sizes = staged(members.groupBy("root").agg(F.sum(F.length("elements")).alias("n")), "sizes")
        total, large = sizes.agg(F.sum("n"), F.max("n")).first()
        if not total:
            break
        fits = sizes.where(F.col("n") <= most)
        part = _join_regions(members.join(fits.select("root"), "root", "left_semi"), percent, total)
        part = staged(part, "links")
        out = part if out is None else out.union(part)
        if large <= most:
            break
        if no == ROUNDS:
            out = out.union(staged(_join_blocks(members.join(sizes.where(F.col("n") > most), "root"), percent, most), "links"))
            break
        rows = _pivot_round(members.join(sizes.where(F.col("n") > most).select("root"), "root", "left_semi"), percent, no)
        out = out.union(rows.where("a is not null").select("a", "b"))
        rows = rows.where("a is null")
        shell = staged(rows.where(F.col("d") > eps - 1e-9).groupBy("root").agg(F.min("d").alias("least")), "shell")
        before, members = members, staged(rows.join(shell, "root").where(F.col("d") >= F.col("least") - eps - 1e-9).select("root", "sid", "elements"), "members")
        drop_staged(before, sizes, shell)
    return out if out is not None else members.sparkSession.createDataFrame([], LINK)


# --- the join ------------------------------------------------------------------------------------------------------


def _with_sets(docs: DataFrame, text: str, names: list[str], bitmaps, bits: int, k: int, secret: bytes, keep_text: bool) -> DataFrame:
    """docs with n, sid, key and, for the first of equal sets of a piece whose key is a candidate's, the set."""
    rest = [c for c in docs.columns if keep_text or c != text]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE):
            seen: set[bytes] = set()
            for piece in pieces(iter([batch]), text):
                sets = shingle_sets(piece.column(text), k, secret)
                ids = [set_id(s) for s in sets]
                keys = np.array([i[1] for i in ids], np.int64)
                member = maybe_repeated(mix(keys.view(U)), bitmaps.value, bits)
                held = []
                for s, (sid, _), m in zip(sets, ids, member.tolist(), strict=True):
                    held.append(s.tobytes() if m and len(s) and sid not in seen else None)
                    seen.add(sid)
                added = [pa.array([len(s) for s in sets], pa.int64()), pa.array([i[0] for i in ids], pa.binary()), pa.array(keys), pa.array(held, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), *added], [*rest, *names])

    kinds = (T.LongType(), T.BinaryType(), T.LongType(), T.BinaryType())
    schema = T.StructType([*docs.select(*map(quoted, rest)).schema.fields, *(T.StructField(n, t) for n, t in zip(names, kinds, strict=True))])
    return docs.mapInArrow(find, schema)


def _members(nodes: DataFrame) -> tuple[list[np.ndarray], int]:
    """A Bloom filter of candidates' keys, of bounded size, by the sketches' blocks: it only spares sets the way."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = mix(np.array(batch.column(0)).view(U))
                got = partial_rows(keys, np.full(len(keys), 2))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int32()), *(pa.array([r[i] for r in got], pa.binary()) for i in (1, 2))], ["block", "once", "more"])

    bits = bits_for(nodes.count())
    return merged(nodes.mapInArrow(rows, "block int, once binary, more binary"), bits), bits


def near_duplicates(docs: DataFrame, text: str = "text", ident: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT, keep_text: bool = False, root: str | None = None) -> DataFrame:
    """docs (without the text, unless it is kept) with n_shingles and component_id; a taken name gets a _.

    root names a column for the component itself, by a set of it: where ids repeat, component_id may not tell two apart.

    Sets are of distinct shingles of k words [^\\x20\\x09-\\x0D]+ after A-Z is lower-cased; a text of fewer words has its
    whole sequence as one. Sets link when they share `percent` per cent of their union or more, whole texts compared.
    component_id is the least id that links lead to. Null and empty texts have no shingles and no links: they keep
    their own id. Repeated ids and rows are rows of their own; null ids are never the least unless all are null; an
    empty table gives no rows. Shingles are compared as 64-bit hashes of words hashed under a key of the run.
    """
    spark = docs.sparkSession
    n, component, sid, key, elements, same, least_id = own(docs, "n_shingles", "component_id", "__sid", "__key", "__set", "__same", "__least")
    # The estimate of the input's size sets only how finely hashes are dealt.
    size = min(1 << 50, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    buckets = min(1 << 20, max(64, size >> 21))
    secret = word_key()
    may = staged(not_alone(docs.select(F.col(quoted(text)).alias("t")), sets_of_texts("t", k, secret), percent, buckets, (100 - percent) / 50), "may")
    bitmaps, bits = _members(may)
    drop_staged(may)
    rows = staged(_with_sets(docs, text, [n, sid, key, elements], spark.sparkContext.broadcast(bitmaps), bits, k, secret, keep_text), "sets")
    sets = rows.where(F.col(elements).isNotNull()).select(F.col(key).alias("node"), F.col(sid).alias("sid"), F.col(elements).alias("elements"))
    # Copies of a set from several pieces are one from here on, so their shingles count once.
    distinct = staged(sets.dropDuplicates(["node", "sid"]), "distinct")
    may = staged(not_alone(distinct.select("node", "elements"), sets_as_given, percent, buckets), "may")
    # Keys are broadcast if their number, counted, allows it: then no set is shuffled to meet them.
    sets = staged(distinct.join(F.broadcast(may) if may.count() <= MOST_BROADCAST else may, "node", "left_semi"), "sets")
    drop_staged(distinct, may)
    classes = staged(connected_components(candidate_edges(sets, percent, buckets, common_shingles(sets)).distinct()), "classes")
    few = classes.count() <= MOST_BROADCAST
    members = staged(sets.join(F.broadcast(classes) if few else classes, "node").select("root", "sid", "elements"), "members")
    drop_staged(sets, classes)
    links = connected_components(region_links(members, percent))
    drop_staged(members)
    least = rows.where(F.col(n) > 0).select(F.col(sid).alias("s"), F.col(quoted(ident)).alias("i")).groupBy("s").agg(F.min("i").alias("m"))
    named = staged(least.join(links, F.col("s") == F.col("node"), "left").select("s", "m", F.coalesce("root", "s").alias("r")), "named")
    whole = named.groupBy("r").agg(F.min("m").alias("c"))
    answer = staged(named.join(whole, "r").select(F.col("s").alias(same), F.col("c").alias(least_id), *([F.col("r").alias(root)] if root else [])), "answer")
    out = rows.join(answer, F.col(sid) == F.col(same), "left")
    return out.withColumn(component, F.when(F.col(n) > 0, F.col(least_id)).otherwise(F.col(quoted(ident)))).drop(same, least_id, sid, key, elements)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its component, also where texts are null, empty, repeated; as in near_duplicates()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive d as (select row_number() over () as rid, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct rid, array_to_string(w[i:i+2], ' ') as g from d, range(1, 1000000) r(i) where len(w) > 0 and i <= greatest(len(w) - 2, 1)),
n as (select rid, count(*) as n from g group by 1),
pair as (select a.rid as a, b.rid as b, count(*) as i from g a join g b on a.g = b.g and a.rid < b.rid group by 1, 2),
link as (select a, b from pair join n x on x.rid = a join n y on y.rid = b where 100 * i >= 90 * (x.n + y.n - i)),
sym as (select a, b from link union select b, a from link),
reach as (select a, a as b from sym union select r.a, s.b from reach r join sym s on r.b = s.a),
c as (select reach.a as rid, min(doc_id) as c from reach join d on d.rid = reach.b group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(c, doc_id) as component_id from d left join n using (rid) left join c using (rid)
"""
