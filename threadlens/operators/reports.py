"""Baseline evaluation and the counts printed after a harvest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.skew import HotKeys, attach_group
from threadlens.schema import THREAD, is_question


def votes(raw: Column) -> Column:
    """Upvotes of a text field; '---' and other non-numbers are 0."""
    return F.coalesce(raw.try_cast("long"), F.lit(0))


def max_upvotes(
    answers: DataFrame, questions: DataFrame, by: Sequence[str] = THREAD, raw: str = "upvotes"
) -> DataFrame:
    """Most upvotes per thread, never below 0 and 0 without answers. ``questions`` holds each thread once."""
    top = answers.groupBy(*by).agg(F.max(votes(F.col(raw))).alias("_top"))
    most = F.greatest(F.lit(0), F.coalesce("_top", F.lit(0))).cast("long").alias("max_upvotes")
    return questions.select(*by).join(top, list(by), "left").select(*by, most)


def predict_top(
    answers: DataFrame, by: Sequence[str] = THREAD, raw: str = "upvotes", hot: HotKeys | None = None
) -> DataFrame:
    """Predict 'solution' for every answer that reaches its thread's maximum."""
    top = attach_group(answers, by, {"_top": F.max(votes(F.col(raw)))}, hot)
    hit = votes(F.col(raw)) == F.greatest(F.lit(0), F.col("_top"))
    return top.withColumn("prediction", F.when(hit, "solution").otherwise("")).drop("_top")


def strawman(
    answers: DataFrame, by: Sequence[str] = THREAD, raw: str = "upvotes", declared: str | None = None
) -> DataFrame:
    """Confusion counts of ``predict_top``: a = true positives, b = true negatives, c = false positives,
    d = false negatives. The total is the sum of what the questions that have answers declare (column ``declared``
    of the answers, equal within a thread); without one, the number of answers.

    Counted per (thread, votes) first and per thread next, so no thread has to be gathered."""
    n = F.col("n")
    tied = (
        answers.select(*by, votes(F.col(raw)).alias("votes"), "resolve", *([declared] if declared else []))
        .groupBy(*by, "votes")
        .agg(
            F.count_if(F.col("resolve") == "solution").alias("good"),
            F.count_if(F.col("resolve") == "---").alias("plain"),
            (F.count("*") if declared is None else F.max(declared)).alias("n"),
        )
    )
    per_thread = tied.groupBy(*by).agg(
        F.max("votes").alias("top"),
        F.max_by("good", "votes").alias("top_good"),
        F.max_by("plain", "votes").alias("top_plain"),
        F.sum("good").alias("good"),
        F.sum("plain").alias("plain"),
        (F.sum("n") if declared is None else F.max("n")).alias("n"),
    )
    hit = F.col("top") >= 0  # a thread with only negative votes predicts nothing
    top_good, top_plain = F.when(hit, F.col("top_good")).otherwise(0), F.when(hit, F.col("top_plain")).otherwise(0)

    def total_of(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    counts = per_thread.agg(
        total_of(top_good).alias("a"),
        total_of(F.col("plain") - top_plain).alias("b"),
        total_of(top_plain).alias("c"),
        total_of(F.col("good") - top_good).alias("d"),
        total_of(n).alias("total_answers"),
    )
    right = F.col("a") + F.col("b")
    return counts.withColumn("accuracy", F.try_divide(right.cast("double"), F.col("total_answers").cast("double")))


def status_counts(df: DataFrame, is_thread: Column, status: Column) -> DataFrame:
    """Questions and how many posts carry each status, in one pass."""
    return df.agg(
        F.count_if(is_thread).alias("questions"),
        F.count_if(status == "Answered.").alias("answered"),
        F.count_if(status == "solution").alias("solutions"),
        F.count_if(status == "Not Answered.").alias("not_answered"),
        F.count_if(status == "Assumed Answered.").alias("assumed_answered"),
    )


def type_counts(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count_if(is_question()).alias("questions"), F.count_if(~is_question()).alias("answers"))


def last_uid(posts: DataFrame) -> DataFrame:
    """Highest question id."""
    return posts.filter(is_question()).agg(F.max(F.col("uid").try_cast("long")).alias("last_uid"))


def topic_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("topic").alias("topics"))


def links_by_origin(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("origin").agg(F.count("*").alias("links"))
