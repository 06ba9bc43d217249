"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network with a calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged
from skeinflow.llm.kernels import mix, pieces, span_hashes, utf8

U = np.uint64
#: Word buckets, dimensions of their vectors, nonzeros of an index vector, words on either side that are context.
#: Over 460,000 words, held-out loss was 0.022 with 2**15 buckets, 0.017, 0.012 and 0.011 with 2**16 to 2**18, 0.013 with 2**20.
BUCKETS, DIMS, NONZEROS, REACH = 1 << 17, 32, 2, 2
#: Labelled rows that the network is fitted on at most (a sample by hash; everything else covers all data), hidden units.
MOST_FIT, HIDDEN = 20_000, 48
#: Blocks in which tasks' sums of vectors are added up, and parts of the tasks that are added up first.
BLOCKS, MEETINGS = 64, 8
#: Forms of sums, told apart by their size, and the largest number that each holds.
SUMS = ((np.int16, 2**15 - 1), (np.int32, 2**31 - 1), (np.float64, 2**53))
#: Classes of bytes whose runs are words: spaces between words, letters and non-ASCII, digits, other signs.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[0x80:] = CLASSES[65:91] = CLASSES[97:123] = 1
CLASSES[48:58] = 2
CLASSES[[0x20, 9, 10, 11, 12, 13]] = 0
FEATURES = 2 * DIMS + 4


def bucketed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, bounds of texts): words are runs of letters, of digits or of other signs, in their case."""
    data, off = utf8(column)
    n = len(data)
    kind = CLASSES[data]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < off[1:]]] = True
    edge = np.append(np.flatnonzero(new), n)
    start, stop = edge[:-1], edge[1:]
    keep = kind[start] > 0 if n else np.zeros(0, bool)
    start, stop = start[keep], stop[keep]
    return (span_hashes(data, start, stop) % U(BUCKETS)).astype(np.int64), np.searchsorted(start, off)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzeros of each bucket's sparse ternary index vector, from hashes."""
    h = mix(np.arange(BUCKETS * NONZEROS, dtype=U) + U(0x9E3779B9)).reshape(BUCKETS, NONZEROS)
    return (h % U(DIMS)).astype(np.int64), np.where((h >> U(40)) & U(1), 1.0, -1.0)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x DIMS: for each bucket the sum of the index vectors of what stands near its words, over all documents.

    A task adds up its own documents; sums meet block by block. What reaches the driver, and is broadcast later, is of
    a fixed size whatever the corpus: BUCKETS x DIMS numbers. Words that share a bucket share a vector.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        acc, any_ = np.zeros(BUCKETS * DIMS), False
        for piece in pieces(batches, text):
            w, ptr = bucketed(piece.column(text))
            doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            for reach in range(1, REACH + 1):
                same = doc[reach:] == doc[:-reach]
                a, b = w[:-reach][same], w[reach:][same]
                for j in range(NONZEROS):
                    np.add.at(acc, a * DIMS + places[b, j], signs[b, j])
                    np.add.at(acc, b * DIMS + places[a, j], signs[a, j])
            any_ = True
        if any_:
            # Whole numbers, of as few bytes as they fit; doubles hold them up to 2**53.
            most = np.abs(acc).max()
            parts = acc.astype(next(kind for kind, limit in SUMS if most <= limit)).reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(BUCKETS * DIMS // BLOCKS)
        for batch in batches:
            for raw in batch.column("sums"):
                raw = raw.as_py()
                acc += np.frombuffer(raw, next(kind for kind, _ in SUMS if len(raw) == np.dtype(kind).itemsize * len(acc)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([acc.tobytes()], pa.binary())], ["block", "sums"])

    kind = "block int, sums binary"
    parts = docs.select(F.col(quoted(text)).alias(text)).mapInArrow(gather, kind)
    # In two steps, so that a block's sums of all tasks don't meet in one task at once.
    parts = parts.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(MEETINGS))).groupBy("block", "some").applyInArrow(add, kind).groupBy("block").applyInArrow(add, kind)
    out = np.zeros((BLOCKS, BUCKETS * DIMS // BLOCKS))
    for r in parts.collect():
        out[r.block] = np.frombuffer(r.sums)
    out = out.reshape(BUCKETS, DIMS)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: mean and spread of its words' vectors, how alike neighbours are (next, and next but one), the mean's length, log words.

    Zeros for a text without words.
    """
    w, ptr = bucketed(column)
    n = np.diff(ptr)
    out = np.zeros((len(n), FEATURES), np.float32)
    have = np.flatnonzero(n > 0)
    if not len(have):
        return out
    v = vectors[w]
    size = n[have, None].astype(np.float32)
    mean = np.add.reduceat(v, ptr[:-1][have], axis=0) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(v * v, ptr[:-1][have], axis=0) / size - mean * mean, 0))
    out[have, :DIMS], out[have, DIMS : 2 * DIMS] = mean, spread
    doc = np.repeat(np.arange(len(n)), n)
    for i, reach in enumerate((1, 2)):
        if len(w) > reach:
            alike = np.einsum("ij,ij->i", v[reach:], v[:-reach]) * (doc[reach:] == doc[:-reach])
            out[:, 2 * DIMS + i] = np.bincount(doc[:-reach], alike, len(n)) / np.maximum(n - reach, 1)
    out[have, 2 * DIMS + 2] = np.linalg.norm(mean, axis=1)
    out[:, 2 * DIMS + 3] = np.log1p(n)
    return out


@dataclass
class Network:
    """Scale, two layers and a temperature; score() gives probabilities of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature that suits the others best.

    Without rows, or with one label alone, all scores are the share of label 1 (0.5 without rows), a little inwards.
    """
    rng = np.random.default_rng(seed)
    x, y = x.astype(float), y.astype(float)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(y) == 0 or y.min() == y.max():
        net.b2 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return net
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[train].mean(0), x[train].std(0) + 1e-6
    net.w1, net.w2 = rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z = (x - net.mean) / net.scale
    parts, t = [net.w1, net.b1, net.w2, np.zeros(1)], 0
    m, s = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    size = min(256, len(train))
    for epoch in range(epochs):
        step = rate * (1 + np.cos(np.pi * epoch / epochs)) / 2
        for at in range(0, len(train), size):
            rows = train[at : at + size]
            a = z[rows] @ parts[0] + parts[1]
            h = np.maximum(a, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(g, parts[2]) * (a > 0)
            t += 1
            for i, grad in enumerate((z[rows].T @ back + decay * parts[0], back.sum(0), h.T @ g + decay * parts[2], np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.999 * s[i] + 0.001 * grad * grad
                parts[i] = parts[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        train = rng.permutation(train)
    net.w1, net.b1, net.w2, net.b2 = *parts[:3], float(parts[3][0])
    if len(held):
        logit = net.logits(x[held])
        loss = lambda temp: np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / temp).mean()
        net.temperature = min(np.exp(np.linspace(np.log(0.2), np.log(10), 80)), key=loss).item()
    return net


def with_features(docs: DataFrame, vectors: np.ndarray, text: str, name: str) -> DataFrame:
    """docs without the text column, with pooled features (array of float) instead."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rest = [c for c in docs.columns if c != text]

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, 1 << 20):
            x = pooled(piece.column(text), shared.value)
            column = pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in rest), column], [*rest, name])

    schema = docs.select(*map(quoted, rest)).withColumn(name, F.array().cast("array<float>")).schema
    return docs.mapInArrow(pool, schema)


def held_out(doc_id) -> F.col:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 3, is 1. A null id is not held out; it has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(features: DataFrame, labels: DataFrame, ident: str, label: str, column: str, most: int = MOST_FIT) -> Network:
    """A network from the labelled rows that aren't held out: all of them, or a sample by hash of `most` or so.

    Null ids and labels are left out; an id with several labels has their rounded mean; an id's different texts are rows of their own.
    """
    known = labels.select(F.col(quoted(ident)).alias("id"), F.col(quoted(label)).alias("label")).dropna().groupBy(F.col("id").alias("__i")).agg((F.avg("label") >= 0.5).cast("int").alias("__y"))
    rows = features.select(F.col(quoted(ident)).alias("id"), F.col(column).alias("x")).where(~held_out(F.col("id"))).join(known, F.col("id") == F.col("__i")).select("__i", "x", "__y")
    # Rows that are alike in id and features are one: an id that is repeated a million times is no million rows here.
    rows = staged(rows.distinct(), "known")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("__i", "x", F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    got = rows.orderBy("__i", "x").toArrow()
    x = np.array(got.column("x").combine_chunks().flatten(), float).reshape(-1, FEATURES)
    return fit(x, np.array(got.column("__y")))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "quality") -> DataFrame:
    """docs (without the text) with held_out, score and predicted; a taken name gets a _.

    Word vectors come from all texts; texts alone decide a score. Null and empty texts pool to zeros and are scored as
    such. Each row is scored by itself, repeated ones alike; an empty table gives no rows.
    """
    held, score, predicted, x = own(docs, "held_out", "score", "predicted", "__x")
    features = staged(with_features(docs, word_vectors(docs, text), text, x), "features")
    net = features.sparkSession.sparkContext.broadcast(fit_quality(features, labels, ident, label, x))
    names = [c for c in features.columns if c != x]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array(batch.column(x).flatten(), float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(net.value.score(values))], [*names, score])

    out = features.mapInArrow(rate, features.drop(x).withColumn(score, F.lit(0.0)).schema)
    return out.withColumns({held: held_out(F.col(quoted(ident))), predicted: (F.col(score) >= 0.5).cast("int")})


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null and empty texts have a score too, repeated rows the same one, as in score_quality()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")
