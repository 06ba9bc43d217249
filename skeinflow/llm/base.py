"""Shared storage and small DataFrame helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch at most. Texts are long; both ends of a pipe hold a batch, for each core.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_STAGED: list[tuple[SparkSession, str, str]] = []
_OWNER = [""]


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless they are smaller already."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, as in tests, one of our own where it is unset."""
    small_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors share no folder")
        local = tempfile.mkdtemp(prefix="skeinflow-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = f"file://{local}"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits or at release()."""
    path = f"{shared_dir(spark)}/skeinflow/{tag}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path, _OWNER[-1]))
    return path


@contextmanager
def owner(name: str) -> Iterator[None]:
    """What is staged within belongs to name, for release()."""
    _OWNER.append(name)
    try:
        yield
    finally:
        _OWNER.pop()


#: Spark deletes a query's shuffle files when the query ends, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run within go as each one ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends here, and a lost executor costs one read.

    The shuffles on the way to it end with it.
    """
    path = shared_path(df.sparkSession, tag)
    with cleaned_up(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is already gone
        pass


def drop_staged(*frames: DataFrame) -> None:
    """Delete what staged() returned, as soon as nothing that is still to run reads it."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        for entry in [e for e in _STAGED if e[1] == path]:
            _STAGED.remove(entry)
            _delete(entry[0], path)


def release(spark: SparkSession | None = None, name: str | None = None) -> None:
    """Delete all that staged() wrote (for that session, or for every one; of that owner, or of all)."""
    for entry in list(_STAGED):
        s, path, of = entry
        if (spark is None or s is spark) and (name is None or of == name):
            _STAGED.remove(entry)
            _delete(s, path)


atexit.register(release)


def own(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of, whatever the letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
