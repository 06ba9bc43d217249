"""Benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, small_batches, staged
from skeinflow.llm.kernels import ALNUM, Words, pieces, ranges, word_key

U = np.uint64
#: Words of a window; bytes of text in a shard's index; words of the benchmark that one block of phrases holds.
WINDOW, SHARD, BLOCK_WORDS = 10, 4 << 20, 1 << 18
#: Bytes of phrases that are broadcast at once.
BROADCAST = 64 << 20
#: One of so many text positions is kept as a sample.
SAMPLE = 8


# --- the index -----------------------------------------------------------------------------------------------------


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t in order, by prefix doubling; each round sorts only those that are still tied."""
    n = len(t)
    nxt = np.append(t[1:] + 1, 0)
    key = t.astype(np.int64) * (int(t.max(initial=0)) + 2) + nxt
    sa = np.argsort(key, kind="stable")
    spot = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = key[sa][1:] != key[sa][:-1]
    start = np.maximum.accumulate(np.where(new, spot, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    h = 2
    while True:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            return sa
        pos = sa[at]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        key = start[at] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        pos, key = pos[o], key[o]
        sa[at] = pos
        new[at] = np.append(True, key[1:] != key[:-1])
        start[at] = np.maximum.accumulate(np.where(new[at], at, 0))
        rank[pos] = start[at]
        h *= 2


class WaveletTree:
    """Ranks over a sequence of symbols: a level for each bit, from the highest, stably parted by it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        s = symbols
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            words = np.zeros((self.n >> 6) + 1, U)
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
            zeros = self.n - int(bit.sum())
            self.levels.append((b, words, ones, zeros))
            s = np.concatenate((s[bit == 0], s[bit == 1]))

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return ones[w] + np.bitwise_count(words[w] & ((U(1) << (i & 63).astype(U)) - U(1)))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[k] occurs before place i[k]."""
        lo, hi = np.zeros(len(i), np.int64), i.astype(np.int64)
        for b, words, ones, zeros in self.levels:
            one = ((c >> b) & 1).astype(bool)
            lo1, hi1 = self._ones(words, ones, lo), self._ones(words, ones, hi)
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places i."""
        i, c = i.astype(np.int64), np.zeros(len(i), np.int64)
        for _, words, ones, zeros in self.levels:
            bit = (words[i >> 6] >> (i & 63).astype(U)) & U(1) > 0
            r = self._ones(words, ones, i)
            c, i = 2 * c + bit, np.where(bit, zeros + r, i - r)
        return c


class FMIndex:
    """Counts and locates phrases in a text of symbols 0 ... symbols - 1."""

    def __init__(self, t: np.ndarray, symbols: int, sample: int = SAMPLE):
        self.n = len(t)
        # A sentinel below all others ends the text: symbols move up by one.
        t = np.append(t.astype(np.int64) + 1, 0)
        sa = suffix_array(t)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=symbols + 2))))[: symbols + 2]
        self.tree = WaveletTree(t[sa - 1], max(1, (symbols + 1).bit_length()))
        kept = sa % sample == 0
        self.kept = WaveletTree(kept.astype(np.int64), 1)
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo[k] ... hi[k] - 1 of the sorted suffixes begin with phrase k (rows of a matrix), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n + 1, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j].astype(np.int64) + 1
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by row: steps back to the nearest sampled position, and adds the steps."""
        rows, steps, out = rows.copy(), 0, np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            have = self.kept.access(r).astype(bool)
            got = r[have]
            out[live[have]] = self.samples[self.kept.rank(np.ones(len(got), np.int64), got)] + steps
            live, r = live[~have], r[~have]
            c = self.tree.access(r)
            rows[live] = self.before[c] + self.tree.rank(c, r)
            steps += 1
        return out


# --- phrases -------------------------------------------------------------------------------------------------------


class Phrases:
    """A block of benchmark windows: vocabulary of word hashes, distinct windows by length, the items that each is of."""

    def __init__(self, items: list[str], texts: list[str], k: int = WINDOW, key: bytes | None = None):
        w = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True, key=key)
        self.vocabulary = np.unique(w.hash)
        self.hint = np.zeros(1 << 16, bool)
        self.hint[self.vocabulary >> U(48)] = True
        ids = np.searchsorted(self.vocabulary, w.hash) + 1
        found: dict[int, dict[bytes, set[str]]] = {}
        for item, lo, hi in zip(items, w.ptr[:-1], w.ptr[1:], strict=True):
            size = min(k, int(hi - lo))
            for at in range(lo, hi - size + 1) if size else ():
                found.setdefault(size, {}).setdefault(ids[at : at + size].astype(np.int32).tobytes(), set()).add(item)
        self.lengths = {n: np.frombuffer(b"".join(x), np.int32).reshape(-1, n) for n, x in found.items()}
        self.items = {n: [sorted(v) for v in x.values()] for n, x in found.items()}
        self.least = min(found, default=0)

    def symbols_of(self, h: np.ndarray) -> np.ndarray:
        """1 ... for words of the vocabulary, else 0."""
        out = np.zeros(len(h), np.int32)
        at = np.flatnonzero(self.hint[h >> U(48)])
        spot = np.searchsorted(self.vocabulary, h[at])
        spot[spot == len(self.vocabulary)] = 0
        same = self.vocabulary[spot] == h[at]
        out[at[same]] = spot[same] + 1
        return out


def phrase_blocks(benchmark: DataFrame, item_id: str, text: str, k: int, key: bytes, most: int = BLOCK_WORDS) -> DataFrame:
    """(block, size, phrases): the benchmark in blocks of about so many words at most, each made in a task: a pickled Phrases.

    Items without an id or words have no phrases; repeated items are one. An item is in one block, whatever its length.
    """
    rows = benchmark.select(F.col(quoted(item_id)).cast("string").alias("item"), F.col(quoted(text)).alias("text")).where("item is not null and text is not null").distinct()
    rows = staged(rows, "items")
    blocks = max(1, -(-int(rows.agg(F.sum(F.length("text") / 4 + 1)).first()[0] or 0) // most))

    def make(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, texts = [], []
        for batch in batches:
            items += batch.column("item").to_pylist()
            texts += batch.column("text").to_pylist()
        made = pickle.dumps(Phrases(items, texts, k, key))
        yield pa.RecordBatch.from_arrays([pa.array([key_[0].as_py()], pa.int64()), pa.array([len(made)], pa.int64()), pa.array([made], pa.binary())], ["block", "size", "phrases"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks).cast("long")))
    return staged(dealt.groupBy("block").applyInArrow(make, "block long, size long, phrases binary"), "phrases")


def _passes(blocks: DataFrame, most: int) -> list[list[int]]:
    """Numbers of the blocks that are broadcast together: of so many bytes at most, or one block."""
    out, room = [], 0
    for r in blocks.select("block", "size").orderBy("block").collect():
        if not out or r.size > room:
            out.append([])
            room = most
        out[-1].append(r.block)
        room -= r.size
    return out


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """(first word, word after) of every occurrence of a phrase, and the phrase's items, by an FM-index of the shard.

    The index is over what phrases can lie in: runs of words of the vocabulary, within one text, no shorter than the
    shortest phrase. All that is between is one separator, which is in no phrase.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    if not phrases.lengths or not len(words.hash):
        return none
    s = phrases.symbols_of(words.hash)
    inside = s > 0
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    bounds = words.ptr[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(s))]
    before[bounds] = False
    after[bounds - 1] = False
    first, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = stop - first >= phrases.least
    first, size = first[long], (stop - first)[long]
    if not len(first):
        return none
    # Text of the index: each run and a separator after it; `word` leads back.
    word = ranges(first, size + 1)
    t = s[np.minimum(word, len(s) - 1)]
    t[np.cumsum(size + 1) - 1] = 0
    index = FMIndex(t, len(phrases.vocabulary) + 1)
    starts, stops, items = [], [], []
    for n, matrix in phrases.lengths.items():
        lo, hi = index.search(matrix)
        count = hi - lo
        if count.any():
            which = np.repeat(np.arange(len(matrix)), count)
            at = word[index.locate(ranges(lo, count))]
            starts.append(at), stops.append(at + n)
            items += [phrases.items[n][i] for i in which.tolist()]
    return (np.concatenate(starts), np.concatenate(stops), items) if starts else none


def _merge(spans: np.ndarray) -> np.ndarray:
    """Spans (start, stop) as the fewest that cover the same."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack((spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]), 1)


def _searched(piece: pa.RecordBatch, words: Words, blocks: list[Phrases]) -> tuple[list[np.ndarray | None], list[set[str]]]:
    """For each text of a shard the words hit, as merged spans (None: none), and the items of the windows found."""
    spans: list[list[np.ndarray]] = [[] for _ in range(piece.num_rows)]
    items: list[set[str]] = [set() for _ in range(piece.num_rows)]
    for block in blocks:
        start, stop, of = occurrences(words, block)
        doc = np.searchsorted(words.ptr, start, "right") - 1
        for d, i in zip(doc.tolist(), of, strict=True):
            items[d].update(i)
        o = np.argsort(doc, kind="stable")
        both = np.stack((start, stop), 1)[o]
        cut = np.flatnonzero(np.append(True, doc[o][1:] != doc[o][:-1])) if len(o) else []
        for lo, hi in zip(cut, np.append(cut[1:], len(o)) if len(o) else [], strict=True):
            spans[doc[o[lo]]].append(both[lo:hi])
    return [_merge(np.concatenate(x)) if x else None for x in spans], items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = WINDOW, clean: bool = False, most: int = BROADCAST) -> DataFrame:
    """docs with n_words, hit_spans (array of [first word, word after], merged), item_ids (array, sorted), contaminated.

    With clean, also clean_text: the text without its hit words and what stands between them; a taken name gets a _.
    Words are [0-9a-z] and non-ASCII after A-Z is lower-cased. A phrase is k consecutive words of an item, or all words
    of a shorter one; items without words or id have none; repeated items count once. Null text has no words, no hits
    and a null clean_text. Documents never cross a shard; an empty table gives no rows, an empty benchmark no hits.

    Blocks of phrases are made in tasks and broadcast, up to `most` bytes of them. Shards pass through all in one stage; a
    benchmark beyond that takes more passes over the texts, each of which writes what it found by text, to be joined.
    Words are compared as 64-bit hashes under a key of the run.
    """
    spark, key = docs.sparkSession, word_key()
    small_batches(spark)
    names = own(docs, "n_words", "hit_spans", "item_ids", "contaminated", "clean_text")
    blocks = phrase_blocks(benchmark, item_id, item_text, k, key)
    passes = _passes(blocks, most)
    extra = [("n_words", pa.int64()), ("hit_spans", pa.list_(pa.list_(pa.int32()))), ("item_ids", pa.list_(pa.string())), ("contaminated", pa.bool_())] + [("clean_text", pa.string())] * clean
    plain = docs.columns
    columns = plain + names[: len(extra)]

    def loaded(numbers: list[int]):
        rows = blocks.where(F.col("block").isin(numbers)).select("phrases").collect()
        return spark.sparkContext.broadcast([pickle.loads(r.phrases) for r in rows])

    def with_hits(piece: pa.RecordBatch, words: Words, hits: list[np.ndarray | None], items: list[set[str]]) -> pa.RecordBatch:
        out = [pa.array(words.count, pa.int64())]
        out.append(pa.array([[] if h is None else (h - words.ptr[i]).tolist() for i, h in enumerate(hits)], extra[1][1]))
        out.append(pa.array([sorted(x) for x in items], extra[2][1]))
        out.append(pa.array([h is not None for h in hits], pa.bool_()))
        if clean:
            out.append(_cleaned(piece.column(text), words, hits))
        return pa.RecordBatch.from_arrays([*(piece.column(c) for c in plain), *out], columns)

    empty = {"n_words": F.lit(0).cast("long"), "hit_spans": F.array().cast("array<array<int>>"), "item_ids": F.array().cast("array<string>"), "contaminated": F.lit(False), "clean_text": F.lit(None).cast("string")}
    schema = docs.withColumns({name: empty[key_] for name, (key_, _) in zip(names, extra, strict=False)}).schema
    if len(passes) <= 1:
        held = loaded(passes[0] if passes else [])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, text, SHARD):
                words = Words(piece.column(text), ALNUM, lower=True, key=key)
                yield with_hits(piece, words, *_searched(piece, words, held.value))

        return docs.mapInArrow(find, schema)

    ident, of, spans, named = own(docs, "__id", "__of", "__spans", "__items")
    marked = docs.withColumn(ident, F.unhex(F.substring(F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256), 1, 32)))
    found = None
    for numbers in passes:
        held = loaded(numbers)

        def note(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "__text", SHARD):
                words = Words(piece.column("__text"), ALNUM, lower=True, key=key)
                hits, items = _searched(piece, words, held.value)
                hit = [i for i, h in enumerate(hits) if h is not None]
                raw = [(hits[i] - words.ptr[i]).astype(np.int32).tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([piece.column("__id").take(pa.array(hit, pa.int64())), pa.array(raw, pa.binary()), pa.array([sorted(items[i]) for i in hit], pa.list_(pa.string()))], ["id", "spans", "items"])

        part = marked.select(F.col(ident).alias("__id"), F.col(quoted(text)).alias("__text")).mapInArrow(note, "id binary, spans binary, items array<string>")
        # Copies of a text are one row from here on.
        part = staged(part.distinct(), "hits")
        held.destroy()
        found = part if found is None else found.union(part)
    each = found.groupBy(F.col("id").alias(of)).agg(F.collect_list("spans").alias(spans), F.flatten(F.collect_list("items")).alias(named))
    joined = marked.join(staged(each, "hits"), F.col(ident) == F.col(of), "left").drop(ident, of)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, SHARD):
            words, hits = Words(piece.column(text), ALNUM, lower=True, hashed=False), []
            for first, raw in zip(words.ptr.tolist(), piece.column(spans).to_pylist(), strict=False):
                hits.append(_merge(np.frombuffer(b"".join(raw), np.int32).reshape(-1, 2).astype(np.int64) + first) if raw else None)
            yield with_hits(piece, words, hits, [set(x or ()) for x in piece.column(named).to_pylist()])

    return joined.mapInArrow(gather, schema)


def _cleaned(column: pa.Array, words: Words, hits: list[np.ndarray | None]) -> pa.Array:
    if all(h is None for h in hits):
        return column
    out = column.to_pylist()
    for i, h in enumerate(hits):
        if h is not None:
            raw, base, at, kept = out[i].encode(), words.off[i], 0, []
            for a, b in h.tolist():
                kept.append(raw[at : words.start[a] - base])
                at = words.end[b - 1] - base
            out[i] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(out, column.type)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document; null texts have no words, items without id or words no windows, as in decontaminate()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
with lower as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
d as (select rid, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from lower),
b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null and text is not null),
phrase as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as p from b, range(1, 100000) r(i) where len(w) > 0 and i <= len(w) - least(10, len(w)) + 1),
sizes as (select distinct n from phrase),
win as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as p from d, sizes, range(1, 1000000) r(i) where i <= len(w) - n + 1),
occ as (select rid, i, n, item_id from win join phrase using (n, p)),
hit as (select rid, count(distinct i + j) as n_hit from (select distinct rid, i, n from occ), range(0, 10) r(j) where j < n group by 1),
its as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct rid, cast(item_id as varchar) as item from occ) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join its using (rid)
"""
