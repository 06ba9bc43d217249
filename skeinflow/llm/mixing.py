"""Mixing sources to target weights: fixed-length word blocks, multinomial shard draws, pseudorandom block permutations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted, staged
from skeinflow.llm.kernels import mix
from skeinflow.llm.merkle import positions

U = np.uint64
#: Words of a block, slots of an output shard on average, share of all words that is taken, uses of a word at most.
BLOCK, SLOTS, SHARE, REPEATS = 128, 8192, 1.5, 2
WEIGHTS = (3.0, 1.0, 2.0)
#: Slots of a source that a task draws shards for at once; documents of all for a bucket of running sums, and buckets at least.
RANGE, RUN, BUCKETS = 1 << 16, 1 << 16, 1024
#: A bucket with so many times RUN rows is looked into for repeated rows.
HOT = 4
#: Sources that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 100_000
SLOT = "shard long, slot long, no long, block long"


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """Targets by weight that sum to share * all sizes; none is above repeats * its size, the excess is reshared by weight."""
    sizes_, weights_ = np.asarray(sizes, float), np.asarray(weights, float)
    caps, out, open_ = repeats * sizes_, np.zeros(len(sizes_)), np.ones(len(sizes_), bool)
    rest = share * sizes_.sum()
    while open_.any() and rest > 0 and weights_[open_].sum() > 0:
        out[open_] = rest * weights_[open_] / weights_[open_].sum()
        above = open_ & (out > caps)
        if not above.any():
            break
        out[above] = caps[above]
        open_ &= ~above
        rest = share * sizes_.sum() - out[~open_].sum()
    return out.tolist()


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed pseudorandom permutation of 0 ... n - 1 sends j: a Feistel network over the next even number of bits, walked until it is below n."""
    half = U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (U(1) << half) - U(1)
    out = j.astype(U)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> half, out[live] & low
        for step in range(6):
            left, right = right, left ^ (mix(right + U((key + step * 0x9E3779B97F4A7C15) % (1 << 64))) & low)
        out[live] = left << half | right
        live = live[out[live] >= U(n)]
    return out.astype(np.int64)


def key_of(*parts: int) -> int:
    """A 64-bit key of some numbers."""
    h = np.zeros(1, U)
    for x in parts:
        h = mix(h + U(x % (1 << 64)) + U(0x9E3779B97F4A7C15))
    return int(h[0])


def range_of(key: int, slots: int, shards: int, ranges: int, at: int) -> tuple[int, int]:
    """(slots before, slots in) range `at` of so many, of a multinomial draw of all slots over the shards, all alike.

    Halves of the ranges share what their whole has by a binomial draw whose seed is the whole's place, so that any task
    works out any range by itself, and all agree.
    """
    lo, hi, before = 0, ranges, 0
    while hi - lo > 1:
        middle = (lo + hi) // 2
        begin, turn, end = (shards * x // ranges for x in (lo, middle, hi))
        left = int(np.random.default_rng([key, lo, hi]).binomial(slots, (turn - begin) / (end - begin)))
        if at < middle:
            hi, slots = middle, left
        else:
            lo, slots, before = middle, slots - left, before + left
    return before, slots


def drawn(key: int, slots: int, blocks: int, shards: int, ranges: int, at: int) -> pd.DataFrame:
    """Slots of one range: the shard of each, drawn multinomially over the range's shards, and the block that it maps to.

    Slot j of a source is block j of its pass over the source, by that pass's own permutation. ranges are of shards,
    at most as many as there are shards.
    """
    first, n = range_of(key, slots, shards, ranges, at)
    lo, hi = shards * at // ranges, shards * (at + 1) // ranges
    shard = np.sort(np.random.default_rng([key, ranges, at, 1]).integers(lo, hi, n))
    j = np.arange(first, first + n)
    turn, block = j // max(blocks, 1), np.empty(n, np.int64)
    for t in np.unique(turn).tolist():
        block[turn == t] = permuted(j[turn == t] % blocks, blocks, key_of(key, t))
    return pd.DataFrame({"shard": shard, "slot": j, "block": block})


def numbered(rows: DataFrame, source: str, size: str) -> DataFrame:
    """(s, no, n) of each source and its sum of sizes, numbered by code point, null last."""
    sizes = staged(rows.groupBy(F.col(quoted(source)).alias("s")).agg(F.sum(size).alias("n")), "sizes")
    # Row numbers over all sources without one task that holds them: places within sorted parts, and the parts' counts.
    parts = staged(sizes.orderBy(F.col("s").cast("string").asc_nulls_last()).select("s", "n", F.monotonically_increasing_id().alias("i")), "sorted")
    part = F.shiftright("i", 33)
    start, total = [], 0
    for p, c in sorted(tuple(r) for r in parts.groupBy(part).count().collect()):
        start.append((p, total))
        total += c
    start = rows.sparkSession.createDataFrame(start, "p long, before long")
    return parts.join(F.broadcast(start), part == F.col("p")).select("s", (F.col("before") + F.col("i").bitwiseAND((1 << 33) - 1)).alias("no"), "n")


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, repeats: float = REPEATS) -> DataFrame:
    """sources (s, no, n) with target, as targets() has it: rounds of sums over the table until none is above its cap."""
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), F.pmod("no", F.lit(len(weights))).cast("int"))
    rows = sources.select("s", "no", "n", w.alias("w"), (F.col("n") * float(repeats)).alias("cap"))
    total = float(rows.agg(F.sum("n")).first()[0] or 0) * share
    capped, level = F.lit(False), 0.0
    while True:
        open_w, closed, n = rows.agg(F.sum(F.when(~capped, F.col("w"))), F.sum(F.when(capped, F.col("cap"))), F.count(F.when(~capped, 1))).first()
        rest = total - (closed or 0.0)
        if not n or not open_w or rest <= 0:
            break
        level = rest / open_w
        above = F.col("w") * level > F.col("cap")
        if not rows.where(~capped & above).limit(1).count():
            break
        # What is above its cap at one level is so at every higher one; levels only rise.
        capped = above
    return rows.select("s", "no", "n", F.when(capped, F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def placed(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", names: Sequence[str] = ("__size", "__at")) -> DataFrame:
    """docs with the names' columns: words, and the words before a document in its source's order.

    Order is by hash: documents are dealt to buckets of some RUN documents of all, so that running sums within a
    source's bucket and over the buckets' totals give offsets without one source's rows ever meeting in one task. Rows
    that are alike in id and text are interchangeable; where one is repeated so often that it would fill a bucket, its
    copies are numbered and dealt on by number.
    """
    size, at = names
    inner = own(docs.withColumns({size: F.lit(0), at: F.lit(0)}), "__key", "__text", "__bucket", "__source", "__of", "__before", "__in")
    key, same, bucket, s2, b2, before, within = inner
    words = F.coalesce(F.regexp_count(F.col(quoted(text)), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    buckets = max(BUCKETS, docs.count() // RUN)
    out = docs.withColumns({size: words, key: F.xxhash64(F.col(quoted(ident)), F.lit(7)), same: F.xxhash64(F.col(quoted(text)))})
    out = out.withColumn(bucket, F.pmod(F.xxhash64(key, same), F.lit(buckets)).cast("long"))
    s = F.col(quoted(source))
    added = lambda rows: staged(rows.groupBy(s.alias("s"), F.col(bucket).alias("b")).agg(F.sum(size).alias("n"), F.count("*").alias("rows")), "sums")
    sums = added(out)
    hot = sums.where(F.col("rows") > HOT * RUN).select(F.col("s").alias(s2), F.col("b").alias(b2))
    if hot.limit(1).count():
        out = _dealt_on(out, hot, s, key, same, bucket, s2, b2, buckets)
        sums = added(out)
    sums = sums.drop("rows")
    total = staged(sums.groupBy("s", F.floor(F.col("b") / 1024).alias("g")).agg(F.sum("n").alias("n")), "groups")
    # Buckets in groups, so that no window holds more than a thousand rows of a source but for the groups themselves.
    group = total.select("s", "g", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = sums.withColumn("g", F.floor(F.col("b") / 1024)).withColumn("in", F.coalesce(F.sum("n").over(Window.partitionBy("s", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = inside.join(group.toDF("s_", "g_", "before"), F.col("s").eqNullSafe(F.col("s_")) & (F.col("g") == F.col("g_"))).select(F.col("s").alias(s2), F.col("b").alias(b2), (F.col("before") + F.col("in")).alias(before))
    order = Window.partitionBy(s, bucket).orderBy(key, same, quoted(ident), size).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(within, F.coalesce(F.sum(size).over(order), F.lit(0)))
    out = out.join(earlier, s.eqNullSafe(F.col(s2)) & (F.col(bucket) == F.col(b2)))
    return out.withColumn(at, F.col(before) + F.col(within)).select(*map(quoted, docs.columns), size, at)


def _dealt_on(out: DataFrame, hot: DataFrame, s: Column, key: str, same: str, bucket: str, s2: str, b2: str, buckets: int) -> DataFrame:
    """out with other buckets for rows that are repeated more than RUN times: by key, text and a copy's number, RUN copies to a bucket."""
    full = out.join(hot, s.eqNullSafe(F.col(s2)) & (F.col(bucket) == F.col(b2)), "left_semi")
    # Alike rows of one source: a row for each task and kind is sent, not one for each copy.
    twins = full.groupBy(s.alias(s2), F.col(key).alias(b2), F.col(same).alias("__same_as")).count().where(F.col("count") > RUN).drop("count")
    twins = staged(twins, "twins")
    alike = s.eqNullSafe(F.col(s2)) & (F.col(key) == F.col(b2)) & (F.col(same) == F.col("__same_as"))
    kind, row = own(out, "__kind", "__row")
    copies = staged(out.join(twins, alike, "left_semi"), "copies").withColumn(kind, F.xxhash64(s, key, same)).withColumn(row, F.monotonically_increasing_id())
    numbered = positions(copies.withColumnRenamed(kind, "__kind_of"), "__kind_of", [row])
    moved = numbered.withColumn(bucket, F.pmod(F.xxhash64(key, same, F.floor(F.col("pos") / RUN)), F.lit(buckets)).cast("long"))
    return out.join(twins, alike, "left_anti").unionByName(moved.select(*map(quoted, out.columns)))


def mix_plan(rows: DataFrame, source: str, size: str, weights: Sequence[float], share: float, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sources, slots) for rows of placed(): sources (s, no, n, target), and the mix itself, a row for each

    slot: (shard, slot, no, block). Targets are met by whole passes over a source's blocks and a part of one more, to
    the nearest block. Each source's slots are dealt to the output shards by a multinomial draw, all shards alike, so a
    shard holds SLOTS blocks or so and the sources in their target shares. Tasks draw ranges of some RANGE slots.
    """
    sources = staged(with_targets(numbered(rows, source, size), weights, share), "sources")
    blocks, passes = F.ceil(F.col("n") / block).cast("long"), F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("long")
    part = F.least(F.col("blocks"), F.rint((F.col("target") - F.col("passes") * F.col("n")) / block).cast("long"))
    plan = sources.select("no", "n", "target", blocks.alias("blocks"), passes.alias("passes"))
    plan = plan.withColumn("slots", F.col("passes") * F.col("blocks") + F.greatest(part, F.lit(0))).where("slots > 0")
    shards = max(1, -(-int(plan.agg(F.sum("slots")).first()[0] or 0) // SLOTS))
    ranges = F.least(F.lit(shards), F.ceil(F.col("slots") / RANGE)).cast("long")
    spans = plan.select("no", "slots", "blocks", ranges.alias("ranges")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                yield drawn(key_of(seed, r.no), r.slots, r.blocks, shards, r.ranges, r.at).assign(no=r.no)[["shard", "slot", "no", "block"]]

    return sources, spans.repartition("no", "at").mapInPandas(draw, SLOT)


USES = "array<struct<block:bigint,first:bigint,words:bigint,times:bigint,at:array<struct<shard:bigint,slot:bigint>>>>"


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, text: str = "text", source: str = "source", ident: str = "doc_id", seed: int = 0, block: int = BLOCK, names: Sequence[str] | None = None) -> DataFrame:
    """docs with __size, __source_size, __target, and __uses: what the mix takes, USES (a taken name gets a _; or the four names).

    first and words place a block's part within the document; times is how often the mix takes it, and at has the output
    shard and slot of each time. Blocks are joined by index with the slots that drew them. Null and empty texts have no
    words and are never taken; a null source is a source, last in order; repeated rows are documents of their own; an
    empty table gives no rows.
    """
    names = list(names or own(docs, "__size", "__source_size", "__target", "__uses"))
    at = own(docs.withColumns({n: F.lit(0) for n in names}), "__at")[0]
    return mix_placed(staged(placed(docs, text, source, ident, (names[0], at)), "placed"), source, weights, share, seed, block, names, at)


def mix_placed(rows: DataFrame, source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = 0, block: int = BLOCK, names: Sequence[str] = ("__size", "__source_size", "__target", "__uses"), at: str = "__at") -> DataFrame:
    """What mix_documents() does, for rows that placed() gave and that were written."""
    size, source_size, target, uses_name = names
    sources, slots = mix_plan(rows, source, size, weights, share, seed, block)
    s2, no, n2, a2 = own(rows.withColumns({n: F.lit(0) for n in names}), "__source", "__no", "__n", "__a")
    s = F.col(quoted(source))
    few = sources.select(F.col("s").alias(s2), F.col("no").alias(no), F.col("n").alias(source_size), F.col("target").alias(target))
    rows = rows.join(F.broadcast(few) if sources.count() <= MOST_BROADCAST else few, s.eqNullSafe(F.col(s2))).drop(s2)
    times = slots.groupBy(F.col("no").alias("no_"), F.col("block").alias("block_")).agg(F.count("*").alias("times"), F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("at"))
    given = rows.where(F.col(size) > 0).select(F.col(no).alias("no"), F.col(at).alias("from"), F.col(size).alias("size"))
    whole = given.withColumn("block", F.explode(F.expr(f"sequence(`from` div {block}, (`from` + size - 1) div {block})")))
    part = whole.select("no", "from", "block", F.greatest(F.col("block") * block - F.col("from"), F.lit(0)).alias("first"), F.least((F.col("block") + 1) * block - F.col("from"), F.col("size")).alias("after"))
    # Both joins are of data with data: sorted, never broadcast, whatever the compressed size of a side.
    used = part.join(times.hint("merge"), (F.col("no") == F.col("no_")) & (F.col("block") == F.col("block_"))).select("no", "from", F.struct("block", "first", (F.col("after") - F.col("first")).alias("words"), "times", "at").alias("use"))
    # Where a document with words begins is its own: (source, offset) names it.
    uses = used.groupBy(F.col("no").alias(n2), F.col("from").alias(a2)).agg(F.sort_array(F.collect_list("use")).cast(USES).alias(uses_name))
    out = rows.join(uses.hint("merge"), (F.col(no) == F.col(n2)) & (F.col(at) == F.col(a2)) & (F.col(size) > 0), "left")
    return out.drop(n2, a2, no, at)


def output_blocks(mixed: DataFrame, uses: str = "__uses", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The mixture as output shards: (shard, slot, block, first, words) and the kept columns, a row for each part of a drawn block, from mix_documents()."""
    out = mixed.select(*map(quoted, keep), F.explode(uses).alias("u")).select(*map(quoted, keep), "u.block", "u.first", "u.words", F.explode("u.at").alias("p"))
    return out.select("p.shard", "p.slot", "block", "first", "words", *map(quoted, keep))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: null and empty texts have size and taken 0, a null source is a source, repeats are documents of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_placed(staged(placed(docs).drop("text"), "placed"))
    taken = F.coalesce(F.aggregate("__uses", F.lit(0).cast("long"), lambda a, u: a + u["words"] * F.size(u["at"])), F.lit(0))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"))
