"""What is on disk while a chain of staged tables runs."""

import glob
import time

from pyspark.sql import functions as F

from skeinflow.llm.base import drop_staged, staged


def _shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_shuffles_end_with_what_they_led_to(spark):
    before = _shuffles(spark)
    kept = spark.range(20000).repartition(7, "id").groupBy((F.col("id") % 100).alias("k")).count()
    out = staged(kept, "test")
    until = time.time() + 20
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    # What a plan had shuffled can be made again.
    assert kept.count() == out.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_staged_tables_can_go_early(spark):
    out = staged(spark.range(10), "test")
    here = out._staged_at.removeprefix("file://")
    assert glob.glob(f"{here}/*.parquet")
    drop_staged(out, spark.range(3))
    assert not glob.glob(here)
