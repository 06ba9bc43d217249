"""What-if queries over declared jobs, machines and running allocations. Running jobs is Spark's own business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.text import human_bytes
from skeinflow.sources.derived import checkpoint_dir


def after_margin(n: Column, margin: float) -> Column:
    return (n - F.floor(n * F.lit(margin))).cast("long")


def capability_gaps(paths: DataFrame, nodes: DataFrame, gpus: DataFrame, cap_bytes: int, margin: float = 0.0) -> DataFrame:
    """paths (job, ord, placement, cores, ram, vram) with axis, needed and available: why the bare machine can't ever serve them; axis null where it can.

    Nodes and devices are a machine's: a handful of rows, summed to one before they meet the jobs.
    """
    cap = after_margin(F.lit(cap_bytes).cast("long"), margin)
    node = nodes.select(F.size("cores").alias("c"), after_margin(F.col("ram"), margin).alias("r"))
    one = node.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all_cores"), F.coalesce(F.max("c"), F.lit(0)).alias("node_cores"), F.coalesce(F.max("r"), F.lit(0)).alias("node_ram"), F.collect_list(F.struct("c", "r")).alias("each"))
    device = gpus.agg(F.max("vram").alias("best"))
    p = paths.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(device))
    gap = lambda axis, needed, available: F.struct(F.lit(axis).alias("axis"), needed.cast("long").alias("needed"), available.cast("long").alias("available"))
    zero, c, ram, vram = F.lit(0), F.col("cores"), F.col("ram"), F.col("vram")
    device_gap = F.when(F.col("best").isNull(), gap("no_device", vram, zero)).when(F.col("best") < vram, gap("exceeds_vram", vram, F.col("best"))).when(F.col("all_cores") < c, gap("exceeds_cores", c, F.col("all_cores"))).when(cap < ram, gap("exceeds_ram", ram, cap))
    pinned = F.when(cap < ram, gap("exceeds_ram", ram, cap)).when(F.col("node_cores") < c, gap("exceeds_cores", c, F.col("node_cores"))).when(~F.exists("each", lambda n: (n["c"] >= c) & (n["r"] >= ram)), gap("exceeds_ram", ram, F.col("node_ram")))
    free = F.when(F.col("all_cores") < c, gap("exceeds_cores", c, F.col("all_cores"))).when(cap < ram, gap("exceeds_ram", ram, cap))
    g = F.when(F.col("placement") == "gpu", device_gap).when(F.col("placement") == "cpu_pinned", pinned).otherwise(free)
    return p.withColumn("g", g).select("job", "ord", "placement", F.col("g.axis").alias("axis"), F.col("g.needed").alias("needed"), F.col("g.available").alias("available"))


def gap_text(placement: Column, axis: Column, needed: Column, available: Column) -> Column:
    head = F.concat_ws(" ", placement, axis)
    return F.when(axis == "no_device", F.concat(head, F.lit(": no device for this placement"))).when(axis == "exceeds_cores", F.concat(head, F.lit(": needs "), needed.cast("string"), F.lit(" cores, has "), available.cast("string"))).when(
        axis.isNotNull(), F.concat(head, F.lit(": needs "), human_bytes(needed), F.lit(", has "), human_bytes(available))
    )


def job_feasibility(gaps: DataFrame) -> DataFrame:
    """(job, feasible, path, gaps): the first path that the machine can serve, else every reason in order."""
    t = gaps.withColumn("text", gap_text(*(F.col(c) for c in ("placement", "axis", "needed", "available"))))
    g = t.groupBy("job").agg(F.bool_or(F.col("axis").isNull()).alias("feasible"), F.min(F.when(F.col("axis").isNull(), F.col("ord"))).alias("path"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("all"))
    return g.select("job", "feasible", "path", F.when(~F.col("feasible"), F.array_join(F.transform("all", lambda x: x["text"]), "; ")).alias("gaps"))


def free_resources(nodes: DataFrame, allocations: DataFrame) -> DataFrame:
    """(node, free_cores array, free_ram): allocations (job, node, cores array, declared, actual) are charged the larger of both figures."""
    used = allocations.groupBy("node").agg(F.flatten(F.collect_list("cores")).alias("busy"), F.sum(F.greatest("declared", "actual")).alias("charged"))
    n = nodes.join(used, "node", "left")
    return n.select("node", F.array_sort(F.array_except("cores", F.coalesce("busy", F.array().cast("array<int>")))).alias("free_cores"), (F.col("ram") - F.coalesce("charged", F.lit(0))).cast("long").alias("free_ram"))


def placed_now(paths: DataFrame, free: DataFrame) -> DataFrame:
    """(job, ord, node, cores) of each path's first node with room, lowest core ids; null where it waits."""
    fits = paths.join(F.broadcast(free), (F.size("free_cores") >= F.col("cores")) & (F.col("free_ram") >= F.col("ram")), "left")
    first = fits.groupBy("job", "ord", "cores").agg(F.min_by(F.struct("node", "free_cores"), "node").alias("at"))
    return first.select("job", "ord", F.col("at.node").alias("node"), F.slice("at.free_cores", F.lit(1), F.col("cores")).alias("cores"))


def ready_jobs(jobs: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """(job): not done, with no unmet need. needs (job, dep)."""
    open_ = needs.join(done.select(F.col("job").alias("dep")), "dep", "left_anti").select("job")
    return jobs.select("job").join(done.select("job"), "job", "left_anti").join(open_, "job", "left_anti")


def lineage_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): undirected components of (job, dep), root the least node; checkpoints cut the lineage.

    Each round every node goes to its least neighbour, and on to that one's; edges are drawn between what is left, once
    each, so that rounds get smaller. A null end is no node.
    """
    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col("job").alias("a"), F.col("dep").alias("b"))
    both = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("m")).union(e.select("b", "a")).where("node is not null")
    label = None
    for _ in range(rounds):
        near = both(e).groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("root")).checkpoint()
        up = near.join(near.toDF("up", "upper"), F.col("root") == F.col("up")).select("node", F.col("upper").alias("root")).checkpoint()
        label = up if label is None else label.join(up.toDF("old", "new"), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).checkpoint()
        moved = e.join(up.toDF("a", "x"), "a").join(up.toDF("b", "y"), "b").where("x <> y")
        e = moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().checkpoint()
        if e.isEmpty():
            return label
    raise RuntimeError("components did not settle")


def cyclic_jobs(jobs: DataFrame, needs: DataFrame, layers: int = 4) -> DataFrame:
    """(job): jobs on a cycle or between two; empty for an acyclic graph.

    Jobs without needs, and jobs that nothing needs, are taken away until none is left to take: some layers from either
    end in each round, as many rounds as the longest chain asks for.
    """
    checkpoint_dir(needs.sparkSession)
    left = needs.select("job", "dep").distinct().checkpoint()
    n = left.count()
    while n:
        for _ in range(layers):
            left = left.join(left.select(F.col("job").alias("dep")).distinct(), "dep", "left_semi")
            left = left.join(left.select(F.col("dep").alias("job")).distinct(), "job", "left_semi").select("job", "dep")
        left = left.checkpoint()
        before, n = n, left.count()
        if n == before:
            break
    return left.select("job").distinct()


def graph_verdicts(jobs: DataFrame, needs: DataFrame) -> DataFrame:
    """(job, verdict) of jobs that keep a graph from running: declared twice, a need that nobody declares, part of a cycle."""
    twice = jobs.groupBy("job").count().where("count > 1").select("job", F.lit("declared twice").alias("verdict"))
    dangling = needs.join(jobs.select(F.col("job").alias("dep")), "dep", "left_anti").select("job", F.concat(F.lit("needs "), F.col("dep"), F.lit(", which is not declared")).alias("verdict")).distinct()
    return twice.union(dangling).union(cyclic_jobs(jobs, needs).withColumn("verdict", F.lit("part of a cycle")))


def dependents(needs: DataFrame) -> DataFrame:
    """(job, n): how many jobs need each one."""
    return needs.select("job", "dep").distinct().groupBy(F.col("dep").alias("job")).agg(F.count("*").alias("n"))


def committed(allocations: DataFrame) -> DataFrame:
    """(node, jobs, cores, ram) that allocations hold of each node: of memory the larger of declared and actual."""
    return allocations.groupBy("node").agg(F.count("*").alias("jobs"), F.sum(F.size("cores")).alias("cores"), F.sum(F.greatest("declared", "actual")).cast("long").alias("ram"))


def execution_route(vram: Column, budget: Column, seconds: Column, overhead: Column, part: float = 0.5, times: float = 10.0) -> Column:
    """fresh where a job takes half the device or ten times the overhead, else warm; no calibration holds the time rule off."""
    fresh = (vram >= part * budget) | F.coalesce(seconds >= times * overhead, F.lit(False))
    return F.when(budget <= 0, F.raise_error(F.lit("the device budget is not positive"))).when(fresh, "fresh").otherwise("warm")


def tightest_ceiling(physical: Column, meminfo: Column, cgroup_text: Column) -> Column:
    """The least real limit; "max" is none."""
    return F.least(physical, meminfo, F.nullif(F.trim(cgroup_text), F.lit("max")).try_cast("long"))


def meminfo_total(text: Column) -> Column:
    return F.regexp_extract(text, r"MemTotal:\s+([0-9]+)", 1).try_cast("long") * 1024
