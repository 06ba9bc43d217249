"""Sharding by extendible hashing: a directory over hash prefixes in which only oversized buckets split."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm.base import own, quoted, staged

#: Bytes of text that a shard holds at most, in production.
SHARD_BYTES = 64 << 20
#: Bits of one hash, and histogram cells that one round gathers: both bounds, whatever the data's size.
BITS, MOST_CELLS = 60, 1 << 20
#: Oversized hashes that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
LEAF = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("prefix", T.LongType()), T.StructField("size", T.LongType())])


def hash_bits(text: Column) -> Column:
    """The first 60 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _split(cells: dict[int, int], depth: int, fine: int, limit: int, leaves: dict, over: list) -> None:
    """Split the buckets of cells (prefixes of `fine` bits) from `depth` bits on, one bit more at a time, while they are oversized."""
    level = [(depth, p) for p in {c >> (fine - depth) for c in cells}]
    keys = np.array(sorted(cells), np.int64)
    total = np.concatenate(([0], np.cumsum([cells[k] for k in keys])))
    while level:
        after = []
        for d, p in level:
            lo, hi = np.searchsorted(keys, [p << (fine - d), (p + 1) << (fine - d)])
            if (size := int(total[hi] - total[lo])) <= limit:
                if hi > lo:
                    leaves[d, p] = size
            elif d == fine:
                over.append(p)
            else:
                after += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        level = after


def directory(hashed: DataFrame, limit: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """Leaves {(depth, prefix): bytes} for rows (h, n), and the 60-bit hashes whose rows alone exceed the limit.

    A round sums bytes by a prefix of so many bits that cells are an eighth of the limit on average, at most 2**20 of
    them; rows of cells that are still oversized go to the next round with more bits. What reaches the driver is a
    number for each cell, and the directory itself: two leaves for each `limit` bytes or so.
    """
    total = hashed.agg(F.sum("n")).first()[0] or 0
    leaves: dict[tuple[int, int], int] = {}
    depth, over, rows = 0, [0], hashed
    while over:
        bits = min(BITS - depth, max(4, ceil(log2(max(1, total / limit))) + 3 if not depth else 12), max(1, int(log2(MOST_CELLS / len(over)))))
        fine = depth + bits
        sums = rows.groupBy(F.shiftright("h", BITS - fine).alias("c")).agg(F.sum("n").alias("n")).collect()
        before, over = depth, []
        _split({r.c: r.n for r in sums}, before, fine, limit, leaves, over)
        depth = fine
        if depth == BITS:
            return leaves, over
        if over:
            rows = hashed.join(_few(hashed.sparkSession, over, "c"), F.shiftright("h", BITS - depth) == F.col("c"), "left_semi")
    return leaves, []


def _few(spark: SparkSession, hashes: list[int], name: str) -> DataFrame:
    """Hashes or prefixes that hold more than a shard's bytes each: as many as the data has shards at most. Broadcast while they are few."""
    table = spark.createDataFrame([(h,) for h in hashes], f"{name} long")
    return F.broadcast(table) if len(hashes) <= MOST_BROADCAST else table


def leaf_of(spark: SparkSession, leaves: dict[tuple[int, int], int]):
    """A vectorised look-up hash -> (depth, prefix, size) by binary search over where the leaves begin.

    The directory is broadcast as arrays, 28 bytes a leaf: at 64 MB a shard, 100 TB are some 3 million leaves or 90 MB.
    """
    order = sorted((p << (BITS - d), d, p, n) for (d, p), n in leaves.items()) or [(0, -1, -1, 0)]
    kinds = (np.int64, np.int32, np.int64, np.int64)
    shared = spark.sparkContext.broadcast(tuple(np.array([x[i] for x in order], k) for i, k in enumerate(kinds)))

    def look(h: pd.Series) -> pd.DataFrame:
        begin, depth, prefix, size = shared.value
        at = np.maximum(np.searchsorted(begin, h.to_numpy(np.int64), "right") - 1, 0)
        return pd.DataFrame({"depth": depth[at], "prefix": prefix[at], "size": size[at]})

    look.__annotations__ = {"h": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(look, LEAF)


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (hash-prefix bits as a string), shard_depth, shard_bytes and doc_bytes; a taken name gets a _.

    The hash is of the key and, after it, of the text, so that rows that share a null or repeated key part. Rows that
    are alike in both have one hash; where they alone exceed the limit, they are dealt by a running number into pages
    (bits/0, bits/1, ...), each within the limit. Only a document that exceeds the limit by itself is over it, alone
    with its copies' pages of one row. Null text has 0 bytes. An empty table gives no rows.
    """
    shard, depth, size, own_size, h, leaf, hot_h = own(docs, "shard", "shard_depth", "shard_bytes", "doc_bytes", "__h", "__leaf", "__hot")
    ident = F.concat(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(quoted(text)), F.lit(""))))
    out = docs.withColumns({h: hash_bits(ident), own_size: F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long")})
    # Hashes and sizes are looked at several times; the texts are read for them once.
    hashed = staged(out.select(F.col(h).alias("h"), F.col(own_size).alias("n")), "hashes")
    leaves, over = directory(hashed, limit)
    out = out.withColumn(leaf, leaf_of(docs.sparkSession, leaves)(F.col(h)))
    bits = lambda p, d: F.when(d > 0, F.right(F.lpad(F.bin(p), BITS, "0"), d)).otherwise("")
    plain = [*map(quoted, docs.columns), shard, depth, size, own_size]
    done = out.withColumns({shard: bits(F.col(f"{leaf}.prefix"), F.col(f"{leaf}.depth")), depth: F.col(f"{leaf}.depth"), size: F.col(f"{leaf}.size")})
    if over:
        hot = _few(docs.sparkSession, over, hot_h)
        alike = staged(out.drop(leaf).join(hot, F.col(h) == F.col(hot_h)).drop(hot_h), "alike")
        done = done.join(hot, F.col(h) == F.col(hot_h), "left_anti").select(*plain)
        done = done.union(_pages(alike, limit, h, own_size, shard, depth, size).select(*plain))
    return done.select(*plain)


def _pages(alike: DataFrame, limit: int, h: str, own_size: str, shard: str, depth: str, size: str) -> DataFrame:
    """Rows of one hash each, numbered file by file (their order there is fixed), as many to a page as the limit holds."""
    from pyspark.sql import Window

    file, row, before, number = own(alike, "__file", "__row", "__before", "__number")
    meta = alike.metadataColumn("_metadata")
    rows = alike.withColumns({file: meta["file_path"], row: meta["row_index"]})
    counts = rows.groupBy(h, file).agg(F.count("*").alias("c"))
    earlier = counts.withColumn(before, F.sum("c").over(Window.partitionBy(h).orderBy(file).rowsBetween(Window.unboundedPreceding, -1))).drop("c")
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(h, file).orderBy(row)) - 1)
    rows = rows.join(earlier, [h, file])
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(own_size)))
    page = F.floor((F.col(number) + F.coalesce(before, F.lit(0))) / room)
    name = F.lpad(F.bin(h), BITS, "0")
    return rows.withColumns({shard: F.concat(name, F.lit("/"), page.cast("string")), depth: F.lit(BITS), size: room * F.col(own_size)})


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard; rows meet by shard, so a shard's file is written by one task."""
    sharded.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)


def op5_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its shard; null ids and texts, repeats and empty tables as in shard_documents()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "shard", "shard_depth", "shard_bytes", "doc_bytes")


def shards_of_128_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over shards so small that buckets split in the smallest tables too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs, 128 << 10).select("doc_id", "shard", "shard_depth", "shard_bytes", "doc_bytes")


def oracle(limit: int = SHARD_BYTES) -> str:
    """DuckDB SQL of op5's rows, as long as no rows of one hash exceed the limit."""
    return f"""
with h as (select doc_id, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h,
  coalesce(strlen(text), 0)::bigint as doc_bytes from documents),
sums as (select d, h >> (60 - d) as p, sum(doc_bytes) as s from h, range(61) t(d) group by 1, 2),
leaf as (select h.doc_id, h.h, h.doc_bytes, min(d) as d from h, range(61) t(d) join sums using (d) where sums.p = h.h >> (60 - d) and sums.s <= {limit} group by 1, 2, 3)
select doc_id, case when d = 0 then '' else right(lpad(bin(h >> (60 - d)), 60, '0'), d::int) end as shard, d::int as shard_depth, s::bigint as shard_bytes, doc_bytes
from leaf join sums using (d) where sums.p = h >> (60 - d)
"""
