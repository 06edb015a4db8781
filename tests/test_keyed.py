"""Stores that are written more than once, and the ledger of stream batches."""

from pathlib import Path

import pytest
from helpers import rows_of, same
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.frontier import frontier_store, merge_frontier
from threadlens.plans.streaming_queries import write_batches
from threadlens.sources.keyed import KeyedStore
from threadlens.streaming.ingest import stream_posts
from threadlens.streaming.ledger import ingest_keyed, ledger_counts, post_store, read_ledger

PAIRS = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])


@pytest.fixture
def pairs(spark, tmp_path):
    store = KeyedStore(str(tmp_path / "store"), PAIRS, ("k",), buckets=8)

    def batch(*rows):
        return spark.createDataFrame([(*r, None)[:3] if len(r) < 3 else r for r in rows], PAIRS)

    def shown():
        return {r.k: r.v for r in store.read(spark).collect()}

    return store, batch, shown


def files(store):
    return {str(p): p.stat().st_mtime_ns for p in Path(store.path).rglob("*.parquet")}


def test_last_batch_wins_and_a_second_run_changes_nothing(pairs):
    store, batch, shown = pairs
    assert store.read(batch().sparkSession).count() == 0
    first = batch(("a", 1, ["x"]), ("b", 2, []), ("c", 3), (None, 4))
    assert store.upsert(first) > 0
    before = files(store)
    assert store.upsert(first) == 0 and files(store) == before
    store.upsert(batch(("b", 5), ("d", 6), (None, 7)))
    assert shown() == {"a": 1, "b": 5, "c": 3, "d": 6, None: 7}


def test_untouched_buckets_keep_their_files(pairs):
    store, batch, shown = pairs
    store.upsert(batch(*[(f"k{i}", i) for i in range(100)]))
    before = files(store)
    assert store.upsert(batch(("k7", 70), ("k8", 8))) == 1
    after = files(store)
    assert len(before.keys() - after.keys()) == 1 and len(before) == len(after) == 8
    assert shown()["k7"] == 70 and len(shown()) == 100


def test_repeats_in_a_batch_and_older_rows(pairs):
    store, batch, shown = pairs
    store.upsert(batch(("a", 1), ("a", 9), ("a", 3)), order="v")
    assert shown() == {"a": 9}
    store.upsert(batch(("a", 5), ("b", None)), newest="v")
    assert shown() == {"a": 9, "b": None}
    store.upsert(batch(("a", 10), ("b", 1)), newest="v")
    assert shown() == {"a": 10, "b": 1}


def test_insert_keeps_what_is_there(pairs):
    store, batch, shown = pairs
    assert store.insert(batch(("a", 1), ("b", 2)), watch={"total": F.sum("v")}) == {"added": 2, "total": 3}
    assert store.insert(batch(("a", 5), ("c", 3), (None, 4)), watch={"total": F.sum("v")}) == {"added": 2, "total": 7}
    assert store.insert(batch(("a", 7), (None, 1)))["added"] == 0
    assert store.insert(batch())["added"] == 0
    assert shown() == {"a": 1, "b": 2, "c": 3, None: 4}


def test_the_number_of_buckets_stays_with_the_store(pairs, spark):
    store, batch, shown = pairs
    store.upsert(batch(*[(f"k{i}", i) for i in range(50)]))
    other = KeyedStore(store.path, PAIRS, ("k",), buckets=3)
    other.upsert(batch(*[(f"k{i}", i + 1) for i in range(50)]))
    assert shown() == {f"k{i}": i + 1 for i in range(50)}


def test_compaction_changes_no_row(pairs, spark):
    store, batch, shown = pairs
    for i in range(3):
        store.insert(batch(*[(f"k{j}", j) for j in range(i * 40, i * 40 + 40)]))
    before = shown()
    store.compact(spark)
    assert shown() == before and len(before) == 120 and len(files(store)) == 8


def test_older_sightings_do_not_win(spark, tmp_path):
    store = frontier_store(str(tmp_path / "frontier"), buckets=4)
    new = spark.createDataFrame([Row(seq=5, url="u", date="today", origin="b"), Row(seq=6, url="v", date="x", origin="b")])
    old = spark.createDataFrame([Row(seq=1, url="u", date="long ago", origin="a"), Row(seq=2, url="w", date="y", origin="a")])
    merge_frontier(store, new)
    merge_frontier(store, old)
    assert {r.url: (r.date, r.seq) for r in store.read(spark).collect()} == {"u": ("today", 5), "v": ("x", 6), "w": ("y", 2)}


class Broken(Exception):
    pass


@pytest.mark.parametrize("mode", ["insert", "upsert"])
def test_a_batch_that_broke_off_is_done_again(spark, tables, tmp_path, mode):
    source, state, ledger = (str(tmp_path / n) for n in ("in", "state", "ledger"))
    store = post_store(str(tmp_path / "posts"), buckets=8)
    write_batches(tables, source, (0, 1, 2))

    def fail(_):
        raise Broken("between data and ledger")

    with pytest.raises(StreamingQueryException):
        ingest_keyed(stream_posts(spark, source), store, ledger, state, mode, fail).awaitTermination()
    assert store.read(spark).count() == tables.store.count() and read_ledger(spark, ledger).count() == 0
    ingest_keyed(stream_posts(spark, source), store, ledger, state, mode).awaitTermination()
    same(store.read(spark), tables.store)
    assert read_ledger(spark, ledger).count() == 1


def test_a_batch_in_the_ledger_is_not_done_again(spark, tables, tmp_path):
    """The stream broke off after the ledger, before its own commit: the batch comes again."""
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    store = post_store(str(tmp_path / "posts"), buckets=8)
    write_batches(tables, source, (0, 1))
    for run in range(2):
        ingest_keyed(stream_posts(spark, source), store, ledger, str(tmp_path / f"state-{run}")).awaitTermination()
    assert read_ledger(spark, ledger).count() == 1
    assert sum(r.posts for r in ledger_counts(spark, ledger).collect()) == store.read(spark).count()


def test_a_post_that_comes_again_much_later(spark, tables, tmp_path):
    """No state in the stream: what is there is told from the store, here over two streams with states of their own."""
    store, sources = post_store(str(tmp_path / "posts"), buckets=8), [str(tmp_path / "a"), str(tmp_path / "b")]
    write_batches(tables, sources[0], (0, 1))
    write_batches(tables, sources[1], (1, 2, 2))
    for i, source in enumerate(sources):
        query = ingest_keyed(stream_posts(spark, source), store, str(tmp_path / f"ledger-{i}"), str(tmp_path / f"state-{i}"))
        query.awaitTermination()
        assert not query.lastProgress or not query.lastProgress["stateOperators"]
    same(store.read(spark), tables.store)
    counts = [rows_of(ledger_counts(spark, str(tmp_path / f"ledger-{i}")))[1] for i in range(2)]
    assert sum(n for rows in counts for n, _ in rows) == tables.store.count()
