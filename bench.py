"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import classical, cube, grid, khovanov
from skeinflow.sources import derived, fixtures

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Copies of each diagram of the published ladder.
COPIES = 4000


def ladder(spark: SparkSession, copies: int):
    pds = fixtures.pd_table(spark, fixtures.LADDER)
    return pds.crossJoin(spark.range(copies, numPartitions=int(CPUS))).select(F.concat("diagram", F.lit("/"), "id").alias("diagram"), "pd")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    braids = derived.order_braids(spark, SF_DIR)
    work = {
        "jones_batch": (lambda: cube.jones_batch(ladder(spark, COPIES), remember=False), 6 * COPIES),
        "jones_native": (lambda: cube.jones_polynomial(ladder(spark, 100)), 600),
        "braid_invariants": (lambda: classical.braid_invariants(braids), None),
        "seifert_matrix": (lambda: classical.seifert_matrix(derived.order_letters(spark, SF_DIR)), None),
        "khovanov_f2_batch": (lambda: khovanov.khovanov_batch(ladder(spark, 400)), 2400),
        "khovanov_q_batch": (lambda: khovanov.khovanov_batch(ladder(spark, 200), "q"), 1200),
        "khovanov_f2": (lambda: khovanov.khovanov_homology(ladder(spark, 10)), 60),
        "rasmussen_batch": (lambda: khovanov.rasmussen_batch(ladder(spark, 400)), 2400),
        "rasmussen_s": (lambda: khovanov.rasmussen_s(ladder(spark, 5)), 30),
        "hfk_hat": (lambda: grid.hfk_hat(fixtures.grid_table(spark)), len(fixtures.GRIDS)),
        "grid_histogram_n8": (lambda: grid.grading_histogram(fixtures.grid_table(spark, {"staircase8": fixtures.staircase(8)})), 1),
    }
    if os.path.isdir(os.path.join(os.path.dirname(os.path.abspath(__file__)), "skeinflow", "llm")):
        from skeinflow.llm.queries import QUERIES

        work |= {name: ((lambda f=f: f(spark, SF_DIR)), None) for name, f in QUERIES.items()}
    done(cube.jones_batch(ladder(spark, 8)))  # workers start
    seconds, rates = {}, {}
    for name, (f, n) in work.items():
        began = time.perf_counter()
        done(f())
        seconds[name] = round(time.perf_counter() - began, 3)
        if n:
            rates[name] = round(n / seconds[name], 1)
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "diagrams_per_sec": rates, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
