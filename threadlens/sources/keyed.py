"""A store that may be written again: one row a key, in buckets by the key's hash.

``upsert`` replaces stored rows, ``insert`` only adds keys that are not there. Both look at the buckets of the batch
alone and write nothing where nothing is new; an upsert rewrites the buckets with changes (dynamic partition overwrite), an
insert adds files to them. A batch applied twice, or again after it was broken off, leaves the rows it left at first.

A bucket is rewritten when the job commits, from a folder beside it; who reads at that moment may miss it, so readers and
writers of one store take turns, and a store has one writer at a time. A null in the key is a value like others. Choose ``buckets`` so that
one holds some hundred megabytes; the number is kept with the store when it is made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.skew import match
from threadlens.session import stage

BUCKET = "key_bucket"


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


@dataclass(frozen=True)
class KeyedStore:
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def _bucket_count(self, spark: SparkSession, make: bool = False) -> int:
        meta = f"{self.path.rstrip('/')}/_buckets"
        if exists(spark, f"{meta}/_SUCCESS"):
            return int(spark.read.text(meta).first()[0])
        if make:
            spark.range(1).select(F.lit(str(self.buckets))).coalesce(1).write.mode("overwrite").text(meta)
        return self.buckets

    def _all(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, self.path):
            return spark.createDataFrame([], self._stored)
        return spark.read.schema(self._stored).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).select(*self.schema.fieldNames())

    def _rest(self) -> list[str]:
        return [n for n in self.schema.fieldNames() if n not in self.key]

    def _batch(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row a key, the last by ``order`` (a tie: the greatest values), with its bucket; written once."""
        count = self._bucket_count(rows.sparkSession, make=True)
        rest = F.struct(*self._rest())
        last = F.max_by(rest, F.struct(F.col(order), rest)) if order else F.max(rest)
        one = rows.groupBy(*self.key).agg(last.alias("_last"))
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(count)).cast("int").alias(BUCKET)
        columns = [F.col(n) if n in self.key else F.col(f"_last.{n}").alias(n) for n in self.schema.fieldNames()]
        return stage(one.select(*columns, bucket), "batch")

    @staticmethod
    def _touched(rows: DataFrame) -> list[int]:
        """Buckets of ``rows``: at most as many as the store has."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def _within(self, spark: SparkSession, touched: list[int]) -> DataFrame:
        """Stored rows of some buckets; the others are not read."""
        return self._all(spark).where(F.col(BUCKET).isin(touched))

    def upsert(self, rows: DataFrame, order: str | None = None, newest: str | None = None) -> int:
        """Put ``rows`` in the place of stored ones of the same key, and add the others. Within the batch the last by ``order``
        counts. With ``newest`` a stored row stays if it has the greater value there. Gives the number of buckets rewritten."""
        spark = rows.sparkSession
        batch = self._batch(rows, order)
        touched = self._touched(batch)
        if not touched:
            return 0
        stored = self._within(spark, touched)
        names = self.schema.fieldNames()
        old = stored.select(*[F.col(n).alias(f"_old_{n}") for n in names], F.lit(True).alias("_there"))
        on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in self.key])
        same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_old_{n}")) for n in names])
        wins = F.lit(True) if newest is None else F.coalesce(F.col(newest) >= F.col(f"_old_{newest}"), F.col(newest).isNotNull())
        met = batch.join(old, on, "left")
        changed = stage(met.where(F.col("_there").isNull() | (~same & wins)).select(*names, BUCKET), "changed")
        touched = self._touched(changed)
        if not touched:
            return 0
        kept = match(self._within(spark, touched), changed.select(*self.key), self.key, "left_anti")
        merged = kept.select(*names, BUCKET).unionByName(changed)
        self._write(merged, "overwrite")
        return len(touched)

    def insert(self, rows: DataFrame, order: str | None = None, watch: dict[str, Column] | None = None) -> dict[str, int]:
        """Add the rows whose key is not stored yet; stored rows stay as they are. Gives the aggregates ``watch`` over the rows
        added, taken in the pass that finds them."""
        from pyspark.sql import Observation

        spark = rows.sparkSession
        batch = self._batch(rows, order)
        touched = self._touched(batch)
        stored = self._within(spark, touched).select(*self.key)
        new = match(batch, stored, self.key, "left_anti")
        seen = Observation()
        watched = {"added": F.count("*"), **(watch or {})}
        new = stage(new.observe(seen, *[c.alias(n) for n, c in watched.items()]), "new-rows")
        counts = {n: int(v or 0) for n, v in seen.get.items()}
        if counts["added"]:
            self._write(new, "append")
        return counts

    def compact(self, spark: SparkSession) -> None:
        """One file a bucket again, after many inserts."""
        self._write(stage(self._all(spark), "compacted"), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        placed = rows.select(*self.schema.fieldNames(), BUCKET).repartition(BUCKET)
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
