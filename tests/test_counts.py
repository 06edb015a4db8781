"""Merged counts against the counts of all."""

import uuid

import pytest
from pyspark.sql import functions as F

from threadlens.sources.counts import CountTable


@pytest.fixture
def kept(spark):
    table = CountTable(spark, f"counts_{uuid.uuid4().hex}", buckets=4)
    yield table
    table.drop()


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "token string, n long")


def shown(df):
    return {r.token: r.n for r in df.collect()}


A, B, C = {"x": 3, "y": 1, None: 2}, {"x": 1, "z": 5}, {"y": 2}


def test_sources_come_and_go(spark, kept):
    assert shown(kept.total()) == {}
    for name, counts in (("a", A), ("b", B), ("c", C)):
        kept.add(frame(spark, counts), name)
    assert shown(kept.total()) == {"x": 4, "y": 3, "z": 5, None: 2}
    assert shown(kept.total(without=["a"])) == {"x": 1, "y": 2, "z": 5}
    kept.withdraw("b")
    kept.withdraw("none")
    assert shown(kept.total()) == {"x": 3, "y": 3, None: 2}
    kept.add(frame(spark, B), "b")
    assert shown(kept.total()) == {"x": 4, "y": 3, "z": 5, None: 2}


def test_a_source_added_again_is_replaced(spark, kept):
    kept.add(frame(spark, A), "a")
    rows = kept.rows().count()
    kept.add(frame(spark, A), "a")
    assert kept.rows().count() == rows
    kept.add(frame(spark, {"x": 2, "w": 1}), "a")
    assert shown(kept.total()) == {"x": 2, "w": 1}
    assert shown(CountTable(spark, kept.name).total()) == {"x": 2, "w": 1}


def test_totals_shuffle_nothing(spark, kept):
    kept.add(frame(spark, A), "a")
    kept.add(frame(spark, B), "b")
    for df in (kept.total(), kept.total(without=["a"])):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    words = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("token"), F.lit(1).alias("n"))
    kept.add(words, "many")
    assert kept.total(without=["a", "b"]).agg(F.sum("n"), F.count("*")).first() == (20_000, 20_000)
