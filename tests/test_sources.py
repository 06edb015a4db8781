"""Stores, dumps and files."""

from datetime import datetime

import pytest
from helpers import same
from pyspark.sql import functions as F

from threadlens.operators.quality import reconcile_counts
from threadlens.schema import DUMP_FIELDS, FRONTIER, THREAD
from threadlens.sources.posts import read_frontier, read_posts, read_topics, typed_posts, write_posts, write_topics
from threadlens.sources.records import dump_fields, read_record_dump, write_record_dump
from threadlens.sources.tables import materialize, write_features
from threadlens.operators.features import FEATURES, features


def test_empty_frontier_fails(spark, tmp_path):
    path = str(tmp_path / "frontier")
    spark.createDataFrame([], FRONTIER).write.parquet(path)
    with pytest.raises(ValueError, match="empty"):
        read_frontier(spark, path)


def test_only_one_store_is_opened(spark, tables, tmp_path):
    path = str(tmp_path / "a")
    tables.store.write.parquet(path)
    assert read_posts(spark, {"x": path, "gone": str(tmp_path / "gone")}, only="x").count() == tables.store.count()


def test_dump_with_odd_texts(spark, tables, tmp_path):
    path = str(tmp_path / "dump")
    odd = tables.store.withColumn("text", F.concat(F.lit("a 'quoted', { url: 'x', uid: 'y' }.\n\nb }"), F.col("uid")))
    write_record_dump(odd, path)
    same(read_record_dump(spark, path), dump_fields(odd))


def test_dump_pages(spark, tmp_path):
    """Page marks around groups of records are skipped."""
    record = "{ " + ", ".join(f"{n}: '{n}%d'" for n in DUMP_FIELDS) + " }\n"
    path = tmp_path / "pages.txt"
    path.write_text("[ " + record.replace("%d", "1") + record.replace("%d", "2") + " ]\n\n[ " + record.replace("%d", "3") + " ]\n\n")
    got = sorted(r.uid for r in read_record_dump(spark, str(path)).collect())
    assert got == ["uid1", "uid2", "uid3"]


def test_typed_posts(spark):
    raw = spark.createDataFrame(
        [
            ("a", "7", "Question", "", "T", "x", "not available", "N/A", "0", "2", "True", "---", "u"),
            ("a", "7.2", "answer", "kim", "", "y", "2016-02-03 04:05:06", "java null spark", "3", "---", "solution", "5", "u"),
        ],
        "site string, uid string, type string, author string, title string, text string, date_time string, tags string,"
        " views string, answers string, resolve string, upvotes string, url string",
    )
    q, a = sorted(typed_posts(raw).collect(), key=lambda r: r.ordinal)
    assert (q.thread_id, q.ordinal, q.type, q.author, q.date_time, q.tags, q.answers, q.upvotes) == ("7", 0, "question", None, None, [], 2, None)
    assert (a.thread_id, a.ordinal, a.date_time, a.tags, a.answers, a.upvotes) == ("7", 2, datetime(2016, 2, 3, 4, 5, 6), ["java", "spark"], None, 5)


def test_records_that_cannot_be_read(spark, tmp_path):
    """They raise, or come back whole to be counted; none is dropped."""
    good = "{ " + ", ".join(f"{n}: '{n}1'" for n in DUMP_FIELDS) + " }\n"
    path = tmp_path / "dump.txt"
    path.write_text("[ " + good + "{ url: 'half', uid: }\n" + good + " ]\n")
    with pytest.raises(Exception, match="not a record"):
        read_record_dump(spark, str(path)).collect()
    rows = read_record_dump(spark, str(path), strict=False).collect()
    assert sorted(r.uid or "" for r in rows) == ["", "uid1", "uid1"]
    assert [r.text for r in rows if r.uid is None] == ["{ url: 'half', uid:"]


def test_typed_posts_of_the_dump_site(spark):
    columns = "site string, uid string, type string, author string, title string, text string, date_time string, tags string, views string, answers string, resolve string, upvotes string, url string"
    raw = spark.createDataFrame(
        [
            ("c", "8.1", "question", "kim", "T", "x", "Feb 3, 2016 4:05 PM", "['abap', \"data base\"]", "1,234", "2", "True", "0", "u"),
            ("c", "8.2", "answer", "lee", "", "y", "Feb 4, 2016 9:00 AM", "null", "0", "---", "solution", "3", "u"),
            ("c", "8.3", "answer", "lee", "", "z", "2016-02-05 01:02:03", "<a b> <c> ", "0", "---", "", "---", "u"),
        ],
        columns,
    )
    rows = sorted(typed_posts(raw, question_number=1).collect(), key=lambda r: r.ordinal)
    assert [(r.ordinal, r.tags, r.views, r.upvotes) for r in rows] == [(0, ["abap", "data base"], 1234, 0), (1, [], 0, 3), (2, ["a b", "c"], 0, None)]
    assert [r.date_time for r in rows] == [datetime(2016, 2, 3, 16, 5), datetime(2016, 2, 4, 9), datetime(2016, 2, 5, 1, 2, 3)]
    counts = reconcile_counts(typed_posts(raw, question_number=1)).collect()
    assert [(r.answers, r.lowered) for r in counts] == [(2, False)]


def test_topics(spark, tmp_path):
    path = str(tmp_path / "topics")
    write_topics(spark.createDataFrame([("Café",), ("Caf",), ("C",)], "topic string"), path)
    assert sorted(r.topic for r in read_topics(spark, path).collect()) == ["C", "Caf"]


def test_materialize_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "table")
    assert materialize(spark, path, build).count() == 3
    assert materialize(spark, path, build).count() == 3
    assert built == [1]


def test_write_modes(spark, tables, tmp_path):
    path, n = str(tmp_path / "posts"), tables.store.count()
    for mode, expected in (("append", n), ("append", 2 * n), ("override", n)):
        write_posts(tables.store, path, mode)
        assert spark.read.parquet(path).count() == expected


def test_feature_file_layout(spark, tables, tmp_path):
    path = tmp_path / "features"
    table = features(tables.store)
    write_features(table, str(path), ",")
    lines = [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]
    header, *rows = [line for line in lines]
    assert header.split(",") == list(FEATURES)
    assert sum(not line.startswith(",,") for line in rows if not line.startswith("resolved")) == table.select(*THREAD).distinct().count()
