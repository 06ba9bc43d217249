"""Equal objects are worked out once, by whatever operator, and the result is joined to all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tasks(df: DataFrame) -> int:
    """Tasks that work of kernels is dealt to, however few bytes the objects have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def once(objects: DataFrame, columns: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(objects), where f makes rows for each diagram out of columns alone: objects with equal columns share them.

    f gets the distinct objects, named by their columns as JSON, dealt to tasks by number and not by bytes; rows that it
    makes are joined to all objects of that name. Objects keep the diagram that they have, of whatever type.
    """
    named = objects.select("diagram", *columns, F.to_json(F.struct(*columns)).alias("__same"))
    different = named.select(F.col("__same").alias("diagram"), *columns).dropDuplicates(["diagram"]).repartition(tasks(objects), "diagram")
    made = f(different)
    rows = made.withColumnRenamed("diagram", "__same")
    return named.select("diagram", "__same").join(rows, "__same").select(*made.columns)
