"""Stream ingest into a keyed store, with a ledger of the batches that are done.

Each micro-batch adds the posts that the store lacks and then writes its number and counts into the ledger. A batch that is in the
ledger is not done again; one that broke off before is done again and adds what is missing, nothing twice. Repeats are told
from the store itself: a post that comes again after any time is not written twice, and the stream keeps no state.
The counts come from the pass that finds the new posts. A ledger belongs to one checkpoint, whose batch numbers it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.schema import POST, is_question
from threadlens.sources.keyed import KeyedStore, exists

LEDGER = "batch long, mode string, questions long, answers long, added long"


def post_store(path: str, buckets: int = 64) -> KeyedStore:
    """Posts by (site, uid)."""
    return KeyedStore(path, POST, ("site", "uid"), buckets)


def committed(spark: SparkSession, ledger: str, batch: int) -> bool:
    return exists(spark, f"{ledger.rstrip('/')}/batch-{batch}/_SUCCESS")


def commit(spark: SparkSession, ledger: str, row: tuple) -> None:
    done = spark.createDataFrame([row], LEDGER).coalesce(1)
    done.write.mode("overwrite").json(f"{ledger.rstrip('/')}/batch-{row[0]}")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row a batch done."""
    if not exists(spark, ledger):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).json(f"{ledger.rstrip('/')}/batch-*")


def ledger_counts(spark: SparkSession, ledger: str) -> DataFrame:
    """(type, posts): what was added so far, from the ledger alone."""
    kinds = F.array(
        F.struct(F.lit("question").alias("type"), F.col("questions").alias("posts")),
        F.struct(F.lit("answer").alias("type"), F.col("answers").alias("posts")),
    )
    return read_ledger(spark, ledger).select(F.inline(kinds)).groupBy("type").agg(F.sum("posts").alias("posts"))


def ingest_keyed(
    posts: DataFrame,
    store: KeyedStore,
    ledger: str,
    checkpoint: str,
    mode: str = "insert",
    before_commit: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Read what is new in ``posts`` into ``store`` and stop. ``mode='insert'`` keeps the post that came first,
    ``'upsert'`` the one that came last (its ledger counts the posts that came). ``before_commit`` is called between data and ledger."""
    if mode not in ("insert", "upsert"):
        raise ValueError(f"unknown mode: {mode}")

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if committed(spark, ledger, number):
            return
        kinds = {"questions": F.count_if(is_question()), "answers": F.count_if(~is_question())}
        if mode == "insert":
            counts = store.insert(batch, watch=kinds)
        else:
            seen = batch.agg(*[c.alias(n) for n, c in kinds.items()]).first()
            counts = {**seen.asDict(), "added": seen["questions"] + seen["answers"]}
            store.upsert(batch)
        if before_commit:
            before_commit(number)
        commit(spark, ledger, (number, mode, counts["questions"], counts["answers"], counts["added"]))

    return (
        posts.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
