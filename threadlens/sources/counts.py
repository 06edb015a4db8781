"""Counts of words that can be merged: one table for many sources (stores, days), placed by word.

Each row says how often a word stands in a source; withdrawing a source adds its rows with the sign turned, so tables are only
added to. Rows lie in buckets by word: a total over all sources, or all but some, reads them where they are and shuffles nothing.
Only what is added is shuffled, so a new day costs its own words and not those of the corpus.

Defined results: a source that is added again is replaced; withdrawing one that is not there does nothing; words whose counts
sum to zero are left out; a null word is a word like others. The table has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.session import fresh_path, stage


class CountTable:
    """``name`` in the session's catalog, with files under ``path``. An existing table is opened as it is."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            empty = spark.createDataFrame([], "token string, n long, source string")
            writer = empty.write.format("parquet").bucketBy(count, "token").sortBy("token")
            writer.option("path", path or fresh_path(spark, "counts")).saveAsTable(name)
        shown = {r.col_name: r.data_type for r in spark.sql(f"describe extended {name}").collect()}
        self.buckets = int(shown["Num Buckets"])

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, counts: DataFrame, source: str) -> None:
        """Put ``counts`` (token, n) in the place of what the table has of ``source``. New and withdrawn rows are written in one job;
        a word whose count stays the same gets no row."""
        new = counts.select("token", F.col("n").cast("long").alias("n"))
        old = self.rows().where(F.col("source") == source).select("token", (-F.col("n")).alias("n"))
        change = new.unionByName(old).groupBy("token").agg(F.sum("n").alias("n")).where("n <> 0")
        self._append(change.withColumn("source", F.lit(source)))

    def withdraw(self, source: str) -> None:
        self.add(self.rows().select("token", "n").limit(0), source)

    def total(self, without: Sequence[str] = ()) -> DataFrame:
        """(token, n) over all sources but ``without``."""
        rows = self.rows().where(~F.col("source").isin(*without)) if without else self.rows()
        return rows.groupBy("token").agg(F.sum("n").alias("n")).where("n <> 0")

    def _append(self, rows: DataFrame) -> None:
        # written apart first, as a table cannot be read and added to in one job
        placed = stage(rows, "counts-change").repartition(self.buckets, "token")
        placed.select("token", "n", "source").write.insertInto(self.name)

    def drop(self) -> None:
        self.spark.sql(f"drop table {self.name}")
