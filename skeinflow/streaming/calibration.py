"""Rates per kind of placement as exponentially weighted averages over a log, in order; in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALPHA = 0.3


def ewma_rates(log: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(placement, rate, n) of a log (ts, placement, cost, seconds): the first observation seeds, costs of 0 or less are skipped.

    The fold is over the logs of one placement in order of ts; it is associative in (weight, value), so what is shuffled
    is one partial for each placement and hour, not the log.
    """
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha is in (0, 1], not {alpha}")
    use = log.where("cost > 0").select("placement", "ts", (F.col("seconds") / F.col("cost")).alias("x"))
    fold = lambda c: F.aggregate(F.array_sort(F.collect_list(F.struct("ts", "x"))), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("v")), lambda a, e: F.struct((a["n"] + 1).alias("n"), (a["v"] * (1 - alpha) + alpha * e["x"]).alias("v")))
    part = use.groupBy("placement", F.date_trunc("hour", "ts").alias("h")).agg(fold("x").alias("p"), F.min_by("x", "ts").alias("first"))
    whole = part.groupBy("placement").agg(F.array_sort(F.collect_list(F.struct("h", "p", "first"))).alias("parts"))
    start = F.get("parts", 0)
    # Each part decays what came before by (1 - alpha)^n; the seed stands for all time before the first observation.
    total = F.aggregate("parts", start["first"], lambda a, e: a * F.pow(F.lit(1 - alpha), e["p"]["n"]) + e["p"]["v"])
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, e: a + e["p"]["n"])
    return whole.select("placement", total.alias("rate"), n.alias("n"))


def ewma_stream(log: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same over a stream of the log, a row for each placement and trigger; state is (rate, n) for each placement."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate, n = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                if r.cost > 0:
                    x = r.seconds / r.cost
                    rate, n = (x if n == 0 else alpha * x + (1 - alpha) * rate), n + 1
        state.update((rate, n))
        yield pd.DataFrame({"placement": [key[0]], "rate": [rate], "n": [n]})

    return log.groupBy("placement").applyInPandasWithState(update, "placement string, rate double, n long", "rate double, n long", "update", GroupStateTimeout.NoTimeout)


def predicted_times(jobs: DataFrame, rates: DataFrame) -> DataFrame:
    """jobs (placement, cost) with seconds: cost times the placement's rate; null where nothing was observed, or no cost is declared.

    rates: (placement, rate), at most one row for each, as ewma_rates() has them; a placement that stands twice raises.
    """
    one = rates.groupBy("placement").agg(F.min("rate").alias("__rate"), F.count("*").alias("__n"))
    twice = F.raise_error(F.concat(F.lit("two rates of "), F.col("placement"))).cast("double")
    one = one.select(F.col("placement").alias("__placement"), F.when(F.col("__n") == 1, F.col("__rate")).otherwise(twice).alias("__rate"))
    out = jobs.join(one, F.col("placement") == F.col("__placement"), "left")
    return out.withColumn("seconds", F.when(F.col("cost") > 0, F.col("cost") * F.col("__rate"))).drop("__placement", "__rate")


def predicted_stream(log: DataFrame, jobs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(job, placement, cost, seconds, n) for each trigger: the stream's latest rates joined with declared costs, a static table.

    jobs: (job, placement, cost). A placement's jobs come again whenever its rate changes, n being the observations it
    rests on; jobs of placements never observed do not come out of the stream: predicted_times() has them, null.
    """
    rate = ewma_stream(log, alpha)
    return rate.join(jobs.where("cost > 0"), "placement").select("job", "placement", "cost", (F.col("cost") * F.col("rate")).alias("seconds"), "n")
