"""Posts as a stream: ingest with restart, dedup, running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.schema import POST, is_question


def stream_posts(spark: SparkSession, source: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(POST)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(source)


def dedup_posts(posts: DataFrame, replay: str = "30 days") -> DataFrame:
    """Each (site, uid) once. A restart replays posts, so repeats are told by arrival time: ``replay`` is how
    long after its first arrival a post may come again, and bounds the state. No post is dropped as late."""
    seen = posts.withColumn("_seen", F.current_timestamp()).withWatermark("_seen", replay)
    return seen.dropDuplicatesWithinWatermark(["site", "uid"]).drop("_seen")


def ingest(posts: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a Parquet store and stop. Offsets and sink log live in ``checkpoint`` and the
    store, so a rerun goes on where the last one ended and a batch that failed is written once."""
    return (
        posts.writeStream.format("parquet")
        .partitionBy("site")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_counts(posts: DataFrame) -> DataFrame:
    """Running numbers of questions and answers."""
    kind = F.when(is_question(), "question").otherwise("answer")
    return posts.groupBy(kind.alias("type")).agg(F.count("*").alias("posts"))


def run_counts(posts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Counts kept in an in-memory table ``name`` (two rows)."""
    return (
        stream_counts(posts).writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
