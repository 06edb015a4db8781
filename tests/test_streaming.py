"""Restart, repeats and counts of the post stream."""

from helpers import same

from threadlens.sources.posts import read_store
from threadlens.streaming.ingest import dedup_posts, ingest, run_counts, stream_posts


def test_restart_reads_only_what_is_new(spark, tables, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tables.store.write.parquet(source)
    for _ in range(2):
        ingest(stream_posts(spark, source), sink, state).awaitTermination()
    same(read_store(spark, sink), tables.store)


def test_repeats_add_nothing(spark, tables, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for _ in range(2):
        tables.store.write.mode("append").parquet(source)
        ingest(dedup_posts(stream_posts(spark, source)), sink, state).awaitTermination()
    same(read_store(spark, sink), tables.store)


def test_counts_go_on_after_restart(spark, tables, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for times in (1, 2):
        tables.store.write.mode("append").parquet(source)
        name = f"running_{times}"
        run_counts(stream_posts(spark, source), name, state).awaitTermination()
        counts = {r.type: r.posts for r in spark.table(name).collect()}
        assert sum(counts.values()) == times * tables.store.count()
