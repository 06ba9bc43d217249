"""Removal of word windows that occur more than once, behind a count-min prefilter that loses none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged
from skeinflow.llm.kernels import WORD_BASE, WORD_BASE_2, Words, mix, pieces, sliding, starts_of, windows, word_key
from skeinflow.llm.sketches import bits_for, maybe_repeated, merged, partial_rows

U = np.uint64
#: Words of a window, and of the part of it that stands for it in the sketch.
WINDOW, PART = 35, 12
#: Bytes of text that a task looks at together; keys that it holds before it writes a sketch.
PIECE, KEYS = 4 << 20, 1 << 21
SKETCH = "block int, once binary, more binary"
FOUND = "bucket int, keys binary, doc binary, pos binary, stop binary, docs binary"
SPANS = "text_id binary, spans binary"


def window_parts(words: Words, k: int = WINDOW, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of k words the least hash among its parts; whether it lies in one text; the least parts themselves.

    Windows of equal words have equal least parts, at places of their own, so a window that occurs twice has a part
    that is counted twice. A twelfth of all places or so hold a least part: the sketch counts those instead of all
    windows, and what it says of a window's part overestimates the window.
    """
    n = len(words.hash)
    if n < k:
        return np.zeros(0, U), np.zeros(0, bool), np.zeros(0, U)
    g = np.maximum(windows(words.hash, part), U(1))
    width = k - part + 1
    least = sliding(g, width, np.minimum)
    ok = starts_of(words.ptr, k, n)
    pad = np.zeros(width - 1, U)
    most = sliding(np.concatenate((pad, np.where(ok, least, U(0)), pad)), width, np.maximum)
    return least, ok, g[(most == g)]


def sketch_texts(texts: DataFrame, column: str, key: bytes, k: int = WINDOW) -> DataFrame:
    """Partial sketches of all texts' window parts."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = partial_rows(keys, n)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["block", "once", "more"])

        for piece in pieces(batches, column):
            keys = window_parts(Words(piece.column(column), key=key), k, min(PART, k))[2]
            held.append(keys)
            size += len(keys)
            if size > KEYS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(sketch, SKETCH)


def _covers(doc: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows at (doc, pos), sorted, as the spans that they cover: (doc, start, stop)."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + k)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], pos[first], pos[last] + k


def _row(bucket: int, keys, doc: np.ndarray, pos: np.ndarray, stop, ids: list[bytes]) -> tuple:
    used, local = np.unique(doc[doc >= 0], return_inverse=True)
    where = np.full(len(doc), -1, np.int32)
    where[doc >= 0] = local
    return bucket, keys, where.tobytes(), pos.astype(np.int32).tobytes(), stop, b"".join(ids[i] for i in used)


def candidate_rows(words: Words, ids: list[bytes], bitmaps: list[np.ndarray], bits: int, buckets: int, k: int = WINDOW) -> list[tuple]:
    """What a piece sends on: of the windows estimated repeated, spans of those it holds twice itself (no keys), and keys by bucket.

    A key that the piece holds twice goes out once, without places, so a window in a third of all texts is a row for
    each piece at most.
    """
    least, ok, _ = window_parts(words, k, min(PART, k))
    at = np.flatnonzero(ok)
    at = at[maybe_repeated(least[at], bitmaps, bits)]
    if not len(at):
        return []
    k1 = windows(words.hash, k, WORD_BASE)[at]
    k2 = windows(words.hash_2, k, WORD_BASE_2)[at]
    doc = np.searchsorted(words.ptr, at, "right") - 1
    pos = at - words.ptr[doc]
    o = np.lexsort((k2, k1))
    new = np.ones(len(o), bool)
    new[1:] = (k1[o][1:] != k1[o][:-1]) | (k2[o][1:] != k2[o][:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(o)))
    many = np.zeros(len(at), bool)
    many[o] = np.repeat(n > 1, n)
    out = []
    if many.any():
        d, s, e = _covers(doc[many], pos[many], k)
        # Spread over buckets of their own; they only pass through.
        spot = buckets + int(k1[o[0]] % U(buckets))
        out.append(_row(spot, None, d, s, e.astype(np.int32).tobytes(), ids))
    send = o[first]
    bucket = (mix(least[at[send]]) % U(buckets)).astype(np.int64)
    by = np.lexsort((send, bucket))
    send, bucket = send[by], bucket[by]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for lo, hi in zip(cut, np.append(cut[1:], len(send)), strict=True):
        w = send[lo:hi]
        out.append(_row(int(bucket[lo]), np.concatenate((k1[w], k2[w])).tobytes(), np.where(many[w], -1, doc[w]), pos[w], None, ids))
    return out


def _candidates(texts: DataFrame, column: str, ident: str, key: bytes, bitmaps, bits: int, buckets: int, k: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column, PIECE):
            rows = candidate_rows(Words(piece.column(column), key=key, halves=2), piece.column(ident).to_pylist(), bitmaps.value, bits, buckets, k)
            if rows:
                kinds = [pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return texts.mapInArrow(find, FOUND)


def exact_spans(found: DataFrame, k: int = WINDOW) -> DataFrame:
    """(text_id, spans): the second pass groups the candidates of each bucket by their 128-bit keys.

    A bucket holds some hundred thousand windows, whatever the corpus: their number follows its size.
    """

    def settle(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1, k2, doc, pos, ids, out = [], [], [], [], [], []
        for batch in batches:
            for keys, d, p, stop, docs in zip(*(batch.column(c).to_pylist() for c in ("keys", "doc", "pos", "stop", "docs")), strict=True):
                names = [docs[i : i + 16] for i in range(0, len(docs), 16)]
                d, p = np.frombuffer(d, np.int32), np.frombuffer(p, np.int32)
                if keys is None:
                    out += _by_text(d, p, np.frombuffer(stop, np.int32), names)
                    continue
                both = np.frombuffer(keys, U).reshape(2, -1)
                k1.append(both[0]), k2.append(both[1]), pos.append(p)
                doc.append(np.where(d < 0, -1, d + len(ids)))
                ids += names
        if k1:
            a, b, doc, pos = np.concatenate(k1), np.concatenate(k2), np.concatenate(doc), np.concatenate(pos)
            o = np.lexsort((b, a))
            new = np.ones(len(o), bool)
            new[1:] = (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(o)))
            hit = o[np.repeat(n > 1, n)]
            hit = hit[doc[hit] >= 0]
            hit = hit[np.lexsort((pos[hit], doc[hit]))]
            if len(hit):
                out += _by_text(*_covers(doc[hit], pos[hit], k), ids)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["text_id", "spans"])

    return found.groupBy("bucket").applyInArrow(settle, SPANS)


def _by_text(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: list[bytes]) -> list[tuple[bytes, bytes]]:
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    both = np.stack((start, stop), 1).astype(np.int32)
    return [(ids[doc[lo]], both[lo:hi].tobytes()) for lo, hi in zip(cut, np.append(cut[1:], len(doc)), strict=True)]


def remove_repeats(docs: DataFrame, text: str = "text", k: int = WINDOW) -> DataFrame:
    """docs with kept_text (kept words joined by one space), n_words and n_removed; a taken name gets a _.

    Words are [^\\x20\\x09-\\x0D]+. A word goes if some window of k words over it starts anywhere else too, in any row or
    at another place of its own; windows are judged on the input. Rows with equal texts are treated alike. Null and
    empty texts have no words and an empty kept_text; texts under k words lose none; an empty table gives no rows.
    Windows are compared as 128-bit hashes, each half made of a half of the words' 128-bit hashes under a key of the run.
    """
    spark = docs.sparkSession
    kept, n_words, n_removed, ident, other, found_spans = own(docs, "kept_text", "n_words", "n_removed", "__id", "__text_id", "__spans")
    marked = docs.withColumn(ident, F.unhex(F.substring(F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256), 1, 32)))
    texts = marked.select(F.col(ident).alias("__id"), F.col(quoted(text)).alias("__text"))
    key = word_key()
    sketches = staged(sketch_texts(texts.select("__text"), "__text", key, k), "sketch")
    parts = (sketches.agg(F.sum(F.octet_length("once") + F.octet_length("more"))).first()[0] or 0) // 8
    bits = bits_for(parts)
    bitmaps = spark.sparkContext.broadcast(merged(sketches, bits))
    found = _candidates(texts, "__text", "__id", key, bitmaps, bits, min(1 << 20, max(16, parts // 40_000)), k)
    # Copies of a text report the same spans: equal reports meet before the shuffle.
    spans = staged(exact_spans(found, k).groupBy(F.col("text_id").alias(other)).agg(F.collect_set("spans").alias(found_spans)), "spans")
    joined = marked.join(spans, F.col(ident) == F.col(other), "left").drop(ident, other)

    names = [*docs.columns, kept, n_words, n_removed]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, PIECE):
            out, words_n, gone = [], [], []
            for t, s in zip(piece.column(text).to_pylist(), piece.column(found_spans).to_pylist(), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if s:
                    keep = np.ones(n, bool)
                    for a, b in np.frombuffer(b"".join(s), np.int32).reshape(-1, 2).tolist():
                        keep[a:b] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                out.append(b" ".join(words).decode())
                words_n.append(n)
                gone.append(n - len(words))
            rest = [piece.column(i) for i, c in enumerate(piece.schema.names) if c != found_spans]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.string()), pa.array(words_n, pa.int64()), pa.array(gone, pa.int64())], names)

    schema = docs.withColumns({kept: F.lit(""), n_words: F.lit(0).cast("long"), n_removed: F.lit(0).cast("long")}).schema
    return joined.mapInArrow(cut, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document, also where texts are null, empty, repeated; as in remove_repeats()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
with t as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select rid, i, hash(array_to_string(w[i:i+34], ' ')) as g, md5(array_to_string(w[i:i+34], ' ')) as m from t, range(1, 1000000) r(i) where i <= len(w) - 34),
rep as (select rid, i from win qualify count(*) over (partition by g, m) > 1),
gone as (select distinct rid, i + k as j from rep, range(35) r(k)),
word as (select rid, j, w[j] as x from t, range(1, 1000000) r(j) where j <= len(w)),
left_over as (select rid, string_agg(x, ' ' order by j) as s, count(*) as n from word anti join gone using (rid, j) group by 1)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256 from t left join left_over using (rid)
"""
