"""Ranks within a thread: rank() with gaps after ties, missing keys last."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadlens.operators.skew import HotKeys, attach_group, heavy_keys, match, running_total
from threadlens.schema import THREAD
from threadlens.session import stage


@dataclass(frozen=True)
class RankSpec:
    key: str
    out: str
    descending: bool = True


def _numbers(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """What the ranks compare, the same for groups of every size: texts as doubles (others than numbers count
    as missing), all other types as they are."""
    return {k: F.col(f"`{k}`").try_cast("double") if isinstance(df.schema[k].dataType, T.StringType) else F.col(f"`{k}`") for k in keys}


def _windowed(df: DataFrame, specs: Sequence[RankSpec], by: Sequence[str]) -> DataFrame:
    """All ranks share the partitioning, hence one exchange and one sort per key and direction."""
    numbers = _numbers(df, [s.key for s in specs])

    def rank(spec: RankSpec) -> Column:
        key = numbers[spec.key]
        return F.rank().over(Window.partitionBy(*by).orderBy(key.desc_nulls_last() if spec.descending else key.asc_nulls_last()))

    return df.withColumns({s.out: rank(s) for s in specs})


def _distributed(df: DataFrame, specs: Sequence[RankSpec], by: Sequence[str], uid: str) -> DataFrame:
    """Exact ranks for groups too large for one task.

    Values of all keys are counted per group (ties collapse before the shuffle), a range-partitioned running
    total turns counts into ranks, and rows look their ranks up by (group, key, value). A value is a struct
    with one field for each type among the keys, so each keeps its own type.
    """
    by = list(by)
    numbers = _numbers(df, list(dict.fromkeys(s.key for s in specs)))
    kinds = {k: df.select(c.alias("x")).schema["x"].dataType for k, c in numbers.items()}
    types = list(dict.fromkeys(kinds.values()))

    def value(k: str) -> Column:
        return F.struct(*[(numbers[k] if t == kinds[k] else F.lit(None).cast(t)).alias(f"t{i}") for i, t in enumerate(types)])

    listed = [
        F.struct(F.lit(i).alias("k"), numbers[k].isNull().alias("missing"), value(k).alias("v")) for i, k in enumerate(numbers)
    ]
    group = F.struct(*by).alias("g")
    long = df.select(group, uid, F.explode(F.array(*listed)).alias("kv")).select("g", uid, "kv.k", "kv.missing", "kv.v")
    counted = running_total(
        long.groupBy("g", "k", "missing", "v").agg(F.count("*").alias("n")), ["g", "k"], ["missing", "v"], F.col("n"), "before"
    )
    counted = stage(counted, "value-counts")
    present = counted.groupBy("g", "k").agg(F.sum(F.when(~F.col("missing"), F.col("n")).otherwise(0)).alias("present"))
    ranked = counted.join(present, ["g", "k"]).select(
        "g",
        "k",
        "missing",
        "v",
        (F.col("before") + 1).cast("int").alias("up"),
        F.when(F.col("missing"), F.col("present") + 1)
        .otherwise(F.col("present") - F.col("before") - F.col("n") + 1)
        .cast("int")
        .alias("down"),
    )
    looked_up = long.join(stage(ranked, "value-ranks"), ["g", "k", "missing", "v"])
    at = {k: i for i, k in enumerate(numbers)}
    wide = looked_up.groupBy("g", uid).agg(
        *[
            F.max(F.when(F.col("k") == at[s.key], F.col("down" if s.descending else "up"))).alias(s.out)
            for s in specs
        ]
    )
    return match(df, wide.select(*[F.col(f"g.{b}").alias(b) for b in by], uid, *[s.out for s in specs]), [*by, uid], "inner")


def add_ranks(
    df: DataFrame,
    specs: Sequence[RankSpec],
    by: Sequence[str] = THREAD,
    uid: str = "uid",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Every row is ranked, whether its ``uid`` repeats or not: large groups get row numbers of their own when they are
    written, and ranks are joined back by these. ``uid`` is kept for callers that name it."""
    hot = heavy_keys(df, by) if hot is None else hot

    def distributed(rows: DataFrame) -> DataFrame:
        numbered = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "large-groups")
        return _distributed(numbered, specs, by, "_row").drop("_row")

    return hot.split(df, lambda rows: _windowed(rows, specs, by), distributed)


def add_rank(df: DataFrame, key: str, descending: bool = True, out: str | None = None, **kwargs) -> DataFrame:
    return add_ranks(df, [RankSpec(key, out or f"{key}_rank", descending)], **kwargs)


def guarded_rank(
    df: DataFrame, key: str, descending: bool = True, out: str | None = None, by: Sequence[str] = THREAD,
    uid: str = "uid", hot: HotKeys | None = None,
) -> DataFrame:
    """Rank by a text column; a thread with any value that is not a number gets no ranks."""
    out = out or f"{key}_rank"
    hot = heavy_keys(df, by) if hot is None else hot
    number = df.withColumn("_number", F.col(key).try_cast("double"))
    bad = F.max(F.col("_number").isNull().cast("int"))
    ranked = add_ranks(attach_group(number, by, {"_bad": bad}, hot), [RankSpec("_number", out, descending)], by, uid, hot)
    return ranked.withColumn(out, F.when(F.col("_bad") == 0, F.col(out))).drop("_number", "_bad")


def first_row(df: DataFrame, columns: Sequence[str], by: Sequence[str] = THREAD, hot: HotKeys | None = None) -> DataFrame:
    """Thread-level ``columns`` only on the first row of each thread, empty on the others."""
    marked = attach_group(df, by, {"_first": F.min("ordinal")}, hot)
    shown = {c: F.when(F.col("ordinal") == F.col("_first"), F.col(c).cast("string")).otherwise("") for c in columns}
    return marked.withColumns(shown).drop("_first")
