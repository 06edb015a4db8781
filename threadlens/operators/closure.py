"""Which pages are reached from the seeds, and in how many steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadlens.operators.skew import heavy_keys
from threadlens.session import cut_lineage, fresh_path

# The known pages are appended to a bucketed table; after this many rounds its files are written as one again.
FOLD_EVERY = 16


class Placed:
    """A table written once by the hash of ``key`` (bucketed), so that no later join on it shuffles it. Rows can
    be added; they go to the same places."""

    def __init__(self, df: DataFrame, key: str):
        self.spark: SparkSession = df.sparkSession
        self.key, self.buckets = key, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.begin(df)

    def begin(self, df: DataFrame) -> None:
        self.name, self.path = f"placed_{uuid.uuid4().hex}", fresh_path(self.spark, f"placed-{self.key}")
        dealt = df.repartition(self.buckets, self.key)
        writer = dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.option("path", self.path).saveAsTable(self.name)

    def add(self, df: DataFrame) -> int:
        """Add rows that a join on the key has placed already; returns how many."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.insertInto(self.name)
        return seen.get["n"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def fold(self) -> None:
        old = self.name
        self.begin(self.rows())
        self.spark.sql(f"drop table {old}")

    def close(self) -> DataFrame:
        """The rows as plain files; the name is given up."""
        schema = self.rows().schema
        self.spark.sql(f"drop table {self.name}")
        return self.spark.read.schema(schema).parquet(self.path)


def _gated(edges: DataFrame, gate: DataFrame) -> DataFrame:
    """Edges between pages that both pass the gate. ``gate`` holds each passing page once, as ``node``."""
    inner = edges.select("src", "dst").join(gate.select(F.col("node").alias("src")), "src", "left_semi")
    return inner.join(gate.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def closure(seeds: DataFrame, edges: DataFrame, gate: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of all gate-passing pages reachable through gate-passing pages.

    Edges lie by source page and known pages by page, each placed once. A round shuffles only the newly found
    pages: to the edges, and their successors to the known pages. Pages with very many links stay spread.
    """
    gate = gate.select("node").distinct()
    edges = cut_lineage(_gated(edges, gate))
    first = seeds.select("node").distinct().join(gate, "node", "left_semi").withColumn("depth", F.lit(0))
    hot = heavy_keys(edges, ["src"])
    placed = Placed(hot.cold(edges) if hot else edges, "src")
    spread = cut_lineage(hot.hot(edges)) if hot else None
    known, depth = Placed(first, "node"), 0
    found = 1
    while found and (max_depth is None or depth < max_depth):
        # files hold one depth each, so those of earlier rounds are skipped by their statistics
        sources = known.rows().filter(F.col("depth") == depth).select(F.col("node").alias("src"))
        depth += 1
        steps = placed.rows().join(sources, "src", "left_semi").select("dst")
        if spread is not None:
            steps = steps.unionByName(spread.join(sources, "src", "left_semi").select("dst"))
        fresh = steps.select(F.col("dst").alias("node")).distinct().join(known.rows().select("node"), "node", "left_anti")
        found = known.add(fresh.withColumn("depth", F.lit(depth)))
        if depth % FOLD_EVERY == 0:
            known.fold()
    placed.close()
    return known.close()


def extend_closure(
    known: DataFrame, edges: DataFrame, new_edges: DataFrame, gate: DataFrame, new_seeds: DataFrame | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """``closure`` after ``new_edges`` and ``new_seeds`` came to ``edges`` and to the seeds that gave ``known``.

    Only pages that the new ones reach in fewer steps than before, or at all, are visited: work grows with what changes. A page
    found earlier over a longer way comes again with its smaller depth; rows are added to the known ones, and the smallest
    depth of a page counts. Edges whose pages pass the gate only now are new edges. Repeated and known edges do no harm; with
    ``max_depth``, ``known`` must be the closure to that depth or beyond.
    """
    gate = gate.select("node").distinct()
    pairs = edges.select("src", "dst").unionByName(new_edges.select("src", "dst"))
    pairs = cut_lineage(_gated(pairs, gate))
    hot = heavy_keys(pairs, ["src"])
    placed = Placed(hot.cold(pairs) if hot else pairs, "src")
    spread = cut_lineage(hot.hot(pairs)) if hot else None
    depth = F.col("depth").cast("long").alias("depth")
    store = Placed(known.select("node", depth), "node")

    def onward(links: DataFrame, sources: DataFrame) -> DataFrame:
        ways = links.join(sources.withColumnRenamed("node", "src"), "src")
        return ways.select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"))

    ways = onward(_gated(new_edges, gate), store.rows())
    if new_seeds is not None:
        first = new_seeds.select("node").join(gate, "node", "left_semi")
        ways = ways.unionByName(first.withColumn("depth", F.lit(0).cast("long")))
    rounds = 0
    while True:
        if max_depth is not None:
            ways = ways.where(F.col("depth") <= max_depth)
        best = ways.groupBy("node").agg(F.min("depth").alias("depth"))
        before = store.rows().withColumnRenamed("depth", "before")
        met = best.join(before, "node", "left").groupBy("node", "depth").agg(F.min("before").alias("before"))
        nearer = met.where(F.col("before").isNull() | (F.col("depth") < F.col("before"))).select("node", "depth")
        nearer = cut_lineage(nearer)
        if nearer.isEmpty():
            break
        store.add(nearer.repartition(store.buckets, "node"))
        rounds += 1
        if rounds % FOLD_EVERY == 0:
            store.fold()
        ways = onward(placed.rows(), nearer)
        if spread is not None:
            ways = ways.unionByName(onward(spread, nearer))
    placed.close()
    return store.close().groupBy("node").agg(F.min("depth").alias("depth"))


def chain(seeds: DataFrame, edges: DataFrame, gate: DataFrame) -> DataFrame:
    """``closure`` for edges with one successor per page ("Next" pointers).

    Chains may be as long as the table, so pointers are doubled each round: 2, 4, 8, … steps at once. The
    number of rounds is the logarithm of the longest chain.
    """
    gate = gate.select("node").distinct()
    jump = cut_lineage(_gated(edges, gate))
    found = seeds.select("node").distinct().join(gate, "node", "left_semi").withColumn("depth", F.lit(0).cast("long"))
    found, span, size = cut_lineage(found), 1, -1
    while True:
        # one row per page on both sides
        ahead = found.withColumnRenamed("node", "src").join(jump, "src")
        reached = ahead.select(F.col("dst").alias("node"), (F.col("depth") + span).alias("depth"))
        found = cut_lineage(found.unionByName(reached).groupBy("node").agg(F.min("depth").alias("depth")))
        total = found.count()
        # A round that adds no page adds none later: reach is closed under jumps of this and shorter spans.
        if total == size:
            return found
        onward = jump.select(F.col("src").alias("dst"), F.col("dst").alias("beyond"))
        jump = cut_lineage(jump.join(onward, "dst").select("src", F.col("beyond").alias("dst")))
        if jump.isEmpty():
            return found
        size, span = total, span * 2
