"""What several operators share: tables, names that do not clash, Arrow tasks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.session import cut_lineage

# Rows that a Python task handles at once; a batch from Spark may hold thousands of long texts.
SLICE_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row, also where ``then`` uses it in inner functions."""
    return F.element_at(F.transform(F.array(value), then), 1)


def arrow_columns(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    results: T.StructType,
    start: Callable[[], Callable[..., Sequence[Any]]],
) -> DataFrame:
    """``df``'s columns ``keep`` and, behind them, ``results``: what ``start()`` gives for each slice of rows.

    ``start`` runs once in each task and returns a function from the Arrow columns of ``inputs`` to one
    sequence (or Arrow array) a result. Rows stay where they are and keep their number; memory is bounded by
    ``SLICE_ROWS`` rows.
    """
    names = [f"k{i}" for i in range(len(keep))]
    slots = [f"i{i}" for i in range(len(inputs))]
    narrow = df.select(
        *[quoted(k).alias(n) for k, n in zip(keep, names, strict=True)],
        *[c.alias(n) for c, n in zip(inputs, slots, strict=True)],
    )
    fields = [T.StructField(n, narrow.schema[n].dataType) for n in names]
    fields += [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(results.fields)]
    kept, width = len(names), len(results.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, types = start(), None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = work(*part.columns[kept:])
                types = types or [arrow_type(f.dataType) for f in results.fields]
                made = [m if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], *made], names=[*names, *[f"r{i}" for i in range(width)]]
                )

    done = narrow.mapInArrow(run, T.StructType(fields))
    return done.toDF(*keep, *results.fieldNames())


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
    }[type(kind)]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with links (``a``, ``b``); component is the smallest node reachable.

    Large-star and small-star rounds (Kiveris and others, 2014): each round hangs the larger neighbours of a
    node, then its smaller ones, on the smallest node next to it, until only stars are left. The smallest
    neighbour is an aggregate with map-side combine and comes back by a join, so that a hub with very many
    links is never gathered in one task. Rounds are cut by checkpoints in the shared folder.
    """
    edges = cut_lineage(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Equal states are equal edge sets."""
    mark = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).collect()[0]
    return tuple(row)
