"""Queries that run a stream over post files to the end and show its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.plans.bridges import Tables
from threadlens.plans.registry import query
from threadlens.plans.source_queries import FLAT_SQL, flat
from threadlens.session import fresh_path
from threadlens.sources.posts import read_store
from threadlens.streaming.ingest import dedup_posts, ingest, run_counts, stream_posts
from threadlens.streaming.ledger import ingest_keyed, ledger_counts, post_store

POSTS_SQL = FLAT_SQL.format(site="")


def write_batches(t: Tables, folder: str, which: tuple[int, ...]) -> None:
    """Post files of the written store, cut by thread into three batches; each is written in parallel."""
    batch = F.col("thread_id").cast("long") % 3
    for i in which:
        t.store.filter(batch == i).write.mode("append").parquet(folder)


@query("q_st_ingest", POSTS_SQL, "posts")
def st_ingest(t: Tables) -> DataFrame:
    source, sink, state = (fresh_path(t.spark, n) for n in ("batches", "sink", "state"))
    write_batches(t, source, (0, 1, 2))
    ingest(stream_posts(t.spark, source, files_per_trigger=8), sink, state).awaitTermination()
    return flat(read_store(t.spark, sink))


@query("q_st_resume", POSTS_SQL, "posts")
def st_resume(t: Tables) -> DataFrame:
    """Stopped after two batches; the rerun reads the third and nothing twice."""
    source, sink, state = (fresh_path(t.spark, n) for n in ("batches", "sink", "state"))
    write_batches(t, source, (0, 1))
    ingest(stream_posts(t.spark, source), sink, state).awaitTermination()
    write_batches(t, source, (2,))
    ingest(stream_posts(t.spark, source), sink, state).awaitTermination()
    ingest(stream_posts(t.spark, source), sink, state).awaitTermination()
    return flat(read_store(t.spark, sink))


@query("q_st_dedup", POSTS_SQL, "posts")
def st_dedup(t: Tables) -> DataFrame:
    """A batch that arrives twice, before and after a restart, adds nothing."""
    source, sink, state = (fresh_path(t.spark, n) for n in ("batches", "sink", "state"))
    write_batches(t, source, (0, 1, 0))
    ingest(dedup_posts(stream_posts(t.spark, source)), sink, state).awaitTermination()
    write_batches(t, source, (1, 2))
    ingest(dedup_posts(stream_posts(t.spark, source)), sink, state).awaitTermination()
    return flat(read_store(t.spark, sink))


@query("q_st_counts", "select type, count(*) posts from posts group by type", "posts")
def st_counts(t: Tables) -> DataFrame:
    source, state = fresh_path(t.spark, "batches"), fresh_path(t.spark, "state")
    write_batches(t, source, (0, 1, 2))
    name = f"counts_{uuid.uuid4().hex}"
    run_counts(stream_posts(t.spark, source, files_per_trigger=8), name, state).awaitTermination()
    return t.spark.table(name)


def harvested(t: Tables) -> tuple:
    """A store and its ledger after two runs of a stream: the second brings the first batch again, and new posts."""
    source, state, ledger = (fresh_path(t.spark, n) for n in ("batches", "state", "ledger"))
    store = post_store(fresh_path(t.spark, "keyed-posts"), buckets=16)
    for which in ((0, 1), (0, 2)):
        write_batches(t, source, which)
        ingest_keyed(stream_posts(t.spark, source), store, ledger, state).awaitTermination()
    return store, ledger


@query("q_st_dedup_store", POSTS_SQL, "posts")
def st_dedup_store(t: Tables) -> DataFrame:
    """Repeats are told from the store, whatever lies between."""
    return flat(harvested(t)[0].read(t.spark))


@query("q_st_ledger_counts", "select type, cast(count(*) as bigint) posts from posts group by type", "posts")
def st_ledger_counts(t: Tables) -> DataFrame:
    """Counts of the ingest itself, of all its runs."""
    return ledger_counts(t.spark, harvested(t)[1])
