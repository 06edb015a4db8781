"""Corpus artifacts, the frequency file and the feature file."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators.features import FEATURES
from threadlens.operators.ranks import first_row
from threadlens.operators.skew import HotKeys
from threadlens.schema import THREAD

# Header of the frequency file; separators of the feature file by site.
FREQ_HEADER = ("w", "P(w|M)")
FEATURE_SEP = {"a": ";", "c": ","}


def write_freq(freq: DataFrame, path: str) -> None:
    freq.select(F.col("stem").alias(FREQ_HEADER[0]), F.col("n").alias(FREQ_HEADER[1])).write.option(
        "sep", " "
    ).option("header", True).option("escape", '"').csv(path)


def read_freq(spark: SparkSession, path: str) -> DataFrame:
    """Counts arrive as text and are made numbers again."""
    rows = (
        spark.read.option("sep", " ").option("header", True).option("escape", '"')
        .schema("stem string, n string").csv(path)
    )
    return rows.select("stem", F.col("n").try_cast("long").alias("n"))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build a table once; later calls read it. A half-written table does not count and is written again."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(inputs: DataFrame) -> str:
    """Number of rows and order-free sums of their hashes: equal tables in any order and partitioning have the same, also
    with repeated rows. One aggregate; columns of types without an order are hashed as they are."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in inputs.columns])
    other = F.hash(F.lit(17), *[F.col(f"`{c}`") for c in inputs.columns])
    seen = inputs.select(row.alias("a"), other.alias("b")).agg(
        F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.bit_xor("a"), F.sum(F.col("b").cast("decimal(38,0)"))
    ).first()
    return "-".join(str(v or 0) for v in seen)


def materialize_for(
    spark: SparkSession, folder: str, inputs: DataFrame, rules: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``build(inputs)``, built once for these ``inputs`` and this version of the ``rules``; other inputs or rules are built beside it.

    A table is written under a name of its own and counts once a manifest, named after input and rules, tells of it. The
    manifest is created exclusively: of several jobs that build at once one wins, and all read its table."""
    shown = hashlib.sha256(f"{rules}|{inputs.schema.simpleString()}|{fingerprint(inputs)}".encode()).hexdigest()[:32]
    base = folder.rstrip("/")
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/manifest-{shown}")
    files = manifest.getFileSystem(spark._jsc.hadoopConfiguration())
    if not _told(spark, files, manifest):
        name = f"table-{uuid.uuid4().hex}"
        build(inputs).write.parquet(f"{base}/{name}")
        _tell(files, manifest, name)
    return spark.read.parquet(f"{base}/{_told(spark, files, manifest)}")


def _told(spark: SparkSession, files, manifest) -> str | None:
    """The table that a manifest names. Its writer may still be at it, so an empty one is looked at again for a while."""
    for _ in range(50):
        if not files.exists(manifest):
            return None
        name = "".join(r.value for r in spark.read.text(manifest.toString()).collect()).strip()
        if name:
            return name
        time.sleep(0.2)
    files.delete(manifest, False)  # its writer is gone
    return None


def _tell(files, manifest, name: str) -> bool:
    """False if another job was first."""
    try:
        out = files.create(manifest, False)
    except Py4JJavaError:
        if files.exists(manifest):
            return False
        raise
    out.write(bytearray(f"{name}\n".encode()))
    out.close()
    return True


def feature_file_rows(features: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``resolved`` and ``question_uid`` only on the first row of a thread."""
    return first_row(features, ("resolved", "question_uid"), THREAD, hot)


def write_features(features: DataFrame, path: str, sep: str = ";", hot: HotKeys | None = None) -> None:
    """Files in thread order. The range includes the ordinal, so a long thread may run over several files."""
    rows = feature_file_rows(features, hot)
    placed = rows.repartitionByRange(*THREAD, "ordinal").sortWithinPartitions(*THREAD, "ordinal")
    placed.select(*[F.col(f"`{c}`") for c in FEATURES]).write.option("sep", sep).option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def read_features(spark: SparkSession, path: str, schema, sep: str = ";") -> DataFrame:
    rows = spark.read.option("sep", sep).option("header", True).option("escape", '"').schema(schema).csv(path)
    return rows.fillna("", subset=["resolved", "question_uid"])
