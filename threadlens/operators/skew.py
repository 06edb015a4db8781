"""Building blocks that keep one very large group from landing in one task.

``heavy_keys`` names all groups of more than ``HOT_ROWS`` rows, in a table that is written to the shared folder
and joined like any other: it has no limit, is not collected, and is broadcast only if the optimizer finds it small.
Plain joins need none of this, as adaptive execution splits their large partitions; it is for windows, which
need a group's rows together. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.session import stage

HOT_ROWS = 200_000


def match(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Join on ``by`` where NULL keys are equal; ``right``'s keys are dropped."""
    names = {b: f"_match_{i}" for i, b in enumerate(by)}
    renamed = right.withColumnsRenamed(names)
    on = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(names[b])) for b in by])
    return left.join(renamed, on, how).drop(*names.values())


@dataclass(frozen=True)
class HotKeys:
    """Groups that need care: none (``frame`` is None), those in ``frame``, or all of a table that was cut
    down to them (``whole``)."""

    by: tuple[str, ...]
    frame: DataFrame | None
    whole: bool = False

    def __bool__(self) -> bool:
        return self.frame is not None

    def cold(self, df: DataFrame) -> DataFrame:
        return match(df, self.frame, self.by, "left_anti")

    def hot(self, df: DataFrame) -> DataFrame:
        return match(df, self.frame, self.by, "left_semi")

    def parts(self, df: DataFrame) -> list[tuple[DataFrame, HotKeys]]:
        """``df`` cut at the scan, each part with the keys that apply to it, so that costly steps in between
        run once per row."""
        if not self or self.whole:
            return [(df, self)]
        return [(self.cold(df), HotKeys(self.by, None)), (self.hot(df), HotKeys(self.by, self.frame, True))]

    def split(
        self, df: DataFrame, plain: Callable[[DataFrame], DataFrame], special: Callable[[DataFrame], DataFrame]
    ) -> DataFrame:
        """``plain`` for rows of ordinary groups, ``special`` for rows of large ones."""
        done = [(special if keys else plain)(part) for part, keys in self.parts(df)]
        return reduce(DataFrame.unionByName, done)


def heavy_keys(df: DataFrame, by: Sequence[str], min_rows: int | None = None) -> HotKeys:
    """All groups of ``df`` with more than ``min_rows`` rows, NULL keys among them: one column-pruned aggregate
    with map-side combine, written once."""
    limit = HOT_ROWS if min_rows is None else min_rows
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    found = stage(counts.where(F.col("n") > limit).select(*by), "large-keys")
    return HotKeys(tuple(by), None if found.isEmpty() else found)


def attach_group(
    df: DataFrame, by: Sequence[str], stats: dict[str, Column], hot: HotKeys | None = None
) -> DataFrame:
    """Add per-group aggregates to each row: windows (which share one exchange with ranks over the same
    group) and, for large groups, an aggregate that is written and joined back."""
    by = list(by)
    hot = heavy_keys(df, by) if hot is None else hot

    def windowed(part: DataFrame) -> DataFrame:
        return part.withColumns({name: stat.over(Window.partitionBy(*by)) for name, stat in stats.items()})

    def joined(part: DataFrame) -> DataFrame:
        per_group = stage(part.groupBy(*by).agg(*[stat.alias(name) for name, stat in stats.items()]), "group-stats")
        return match(part, per_group, by, "inner")

    return hot.split(df, windowed, joined)


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, out: str) -> DataFrame:
    """Exact sum of ``weight`` over the rows before this one in its group, for groups of any size.

    Rows are range-partitioned on (group, order), so a group spreads over as many tasks as it needs. The
    partition number is staged, sums run inside each piece, and a table with one row per (piece, group) adds
    what lies in earlier pieces. ``order`` must be unique within a group.
    """
    by, order = list(by), list(order)
    ranged = df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id())
    ranged = stage(ranged.withColumn("_weight", weight.cast("long")), "ranged")

    before = Window.orderBy("_piece") if not by else Window.partitionBy(*by).orderBy("_piece")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        ranged.groupBy("_piece", *by)
        .agg(F.sum("_weight").alias("_sum"))
        .withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy("_piece", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    return (
        match(local, pieces, ["_piece", *by], "inner")
        .withColumn(out, F.col("_earlier") + F.col("_inside"))
        .drop("_piece", "_weight", "_earlier", "_inside")
    )


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, hot: HotKeys | None = None
) -> DataFrame:
    """1, 2, 3, … within each group. ``order`` must be unique within a group."""
    hot = heavy_keys(df, by) if hot is None else hot

    def windowed(part: DataFrame) -> DataFrame:
        return part.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    def ranged(part: DataFrame) -> DataFrame:
        return running_total(part, by, order, F.lit(1), out).withColumn(out, (F.col(out) + 1).cast("int"))

    return hot.split(df, windowed, ranged)


def number_all(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Dense 1..n over a whole table without a one-task window."""
    return running_total(df, [], order, F.lit(1), out).withColumn(out, F.col(out) + 1)
