"""Cost of reducing complexes, from dimensions alone, and routing by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fork base in bytes, and working set as a part of the packed peak, by backend.
FORK_BASE = {"reference": 10 << 20, "bitint": 10 << 20, "jit": 40 << 20, "packed-cpu": 40 << 20, "packed-gpu": 40 << 20}
WORKING = {"reference": 0.5, "bitint": 0.5, "jit": 1.0, "packed-cpu": 1.0, "packed-gpu": 1.0}
HEAVIEST_BASE, HEAVIEST_PART = 40 << 20, 1.0
GPU_LEAST = 32 << 20


def words(rows: Column) -> Column:
    return F.floor((rows + 63) / 64)


def block_bytes(cols: Column, rows: Column) -> Column:
    """Packed matrix and pivots of one map; 0 where a side is empty."""
    return F.when((cols <= 0) | (rows <= 0), 0).otherwise((cols + F.least(cols, rows)) * words(rows) * 8).cast("long")


def block_ops(cols: Column, rows: Column) -> Column:
    return F.when((cols <= 0) | (rows <= 0), 0).otherwise(cols * F.least(cols, rows) * words(rows)).cast("long")


def blocks(gen: DataFrame) -> DataFrame:
    """(cx, deg, cols, rows, bytes, ops) of each degree's map."""
    up = gen.select("cx", (F.col("deg") - 1).alias("deg"), F.col("dim").alias("rows"))
    b = gen.select("cx", "deg", F.col("dim").alias("cols")).join(up, ["cx", "deg"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    return b.withColumns({"bytes": block_bytes(F.col("cols"), F.col("rows")), "ops": block_ops(F.col("cols"), F.col("rows"))})


def predicted_size(gen: DataFrame) -> DataFrame:
    """(cx, total_dim, peak_bytes, peak_deg, ops): peak_deg is the first degree of the largest map."""
    b = blocks(gen).groupBy("cx").agg(F.sum("cols").alias("total_dim"), F.max("bytes").alias("peak_bytes"), F.max_by("deg", F.struct("bytes", -F.col("deg"))).alias("peak_deg"), F.sum("ops").alias("ops"))
    return b.withColumn("peak_deg", F.when(F.col("peak_bytes") > 0, F.col("peak_deg")))


def host_bytes(peak: Column, backend: Column) -> Column:
    """Memory of a reduce worker; an unknown backend counts as the heaviest."""
    base, part = F.lit(HEAVIEST_BASE), F.lit(HEAVIEST_PART)
    for k in FORK_BASE:
        base, part = F.when(backend == k, FORK_BASE[k]).otherwise(base), F.when(backend == k, WORKING[k]).otherwise(part)
    return (base + F.floor(peak * part)).cast("long")


def routed(sizes: DataFrame, gpu_bytes: int | None = None, ram_bytes: int | None = None, gpu_least: int = GPU_LEAST) -> DataFrame:
    """sizes with backend and fits_gpu: a device only where the peak fits and is worth it; beyond the memory budget it raises."""
    peak = F.col("peak_bytes")
    fits = F.lit(gpu_bytes is not None) & (peak <= (gpu_bytes or 0))
    backend = F.when(fits & (peak >= gpu_least), "packed-gpu").otherwise("bitint")
    if ram_bytes is not None:
        backend = F.when(peak > ram_bytes, F.raise_error(F.lit("the predicted peak exceeds the memory budget"))).otherwise(backend)
    return sizes.withColumns({"backend": backend, "fits_gpu": fits})


def grading_peaks(histogram: DataFrame) -> DataFrame:
    """(diagram, a, peak_bytes) of a grading histogram (diagram, m, a, n): the differential lowers m."""
    gen = histogram.select(F.struct("diagram", "a").alias("cx"), (-F.col("m")).alias("deg"), F.col("n").alias("dim"))
    return predicted_size(gen).select("cx.diagram", "cx.a", "peak_bytes")


def batch_bytes(histogram: DataFrame) -> DataFrame:
    """(diagram, all_bytes, floor_bytes): every grading at once, and the largest alone."""
    return grading_peaks(histogram).groupBy("diagram").agg(F.sum("peak_bytes").alias("all_bytes"), F.max("peak_bytes").alias("floor_bytes"))


def record_bytes(n):
    """Bytes that a record of n states is reckoned at."""
    return (F.lit(256) + 128 * n).cast("long")
