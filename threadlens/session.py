"""Session defaults and the shared folder that staged tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on; all of them may be set on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work is heavy per byte: small shuffles still use all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


# Settings that a session can only be started with.
START = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}

# A table whose files hold less than this may be dealt over all cores (see ``spread``).
SPREAD_BYTES = 256 << 20


def build_session(app: str = "threadlens", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**START, **RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach. The cluster names it in ``spark.checkpoint.dir``; a temporary
    folder is made only where nothing is set (tests on one machine)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="threadlens-"))
    return named or context.getCheckpointDir()


def run_dir(spark: SparkSession) -> str:
    """What this application writes lies under one folder of its own."""
    return f"{shared_dir(spark).rstrip('/')}/threadlens/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove all tables staged by this application. For the caller, once no result is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that was staged under ``path``, if it is there, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within remove their shuffle files when they end, not when the driver collects garbage. For loops whose
    results are written or checkpointed."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: short lineage, true file sizes for the
    optimizer, nothing recomputed when an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table of texts over all cores. A file with one row group is one task, however long its
    texts take; only tables under ``SPREAD_BYTES`` are dealt, so no large table is ever shuffled by this."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df
