"""From page parts to posts: ids, solution marks, status, dates, the union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.frontier import UNKNOWN_DATE
from threadlens.operators.skew import HotKeys, number_all, number_rows
from threadlens.schema import POST, THREAD


def attach_date(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """Frontier date of each page by exact URL; ``frontier`` holds each URL once."""
    return pages.join(frontier.select("url", "date"), "url", "left").withColumn(
        "date", F.coalesce("date", F.lit(UNKNOWN_DATE))
    )


def assign_uid(questions: DataFrame, order: Sequence[str] = ("url",), out: str = "uid") -> DataFrame:
    """Question ids 1..n in the order of a unique key."""
    return number_all(questions, order, out)


def number_answers(
    answers: DataFrame, by: Sequence[str] = THREAD, best: str = "is_best", order: Sequence[str] = ("page_no", "pos"),
    hot: HotKeys | None = None,
) -> DataFrame:
    """Answer ordinal: the best answer is 1, the others follow in page order, counting on over further pages."""
    ranked = answers.withColumn("_later", F.when(F.col(best), 0).otherwise(1))
    return number_rows(ranked, by, ["_later", *order], "ordinal", hot).drop("_later")


def mark_solution(
    answers: DataFrame, threads: DataFrame, by: Sequence[str] = THREAD
) -> DataFrame:
    """An answer is the solution when author and date are those of the thread's solution and the thread is
    not 'Not Answered.'. ``threads`` holds each thread once."""
    accepted = threads.filter(F.col("status") != "Not Answered.").select(*by, "solution_user", "solution_date")
    marked = answers.join(accepted, list(by), "left")
    hit = (F.col("author") == F.col("solution_user")) & (F.col("date_time") == F.col("solution_date"))
    return marked.withColumn("resolve", F.when(hit, "solution").otherwise("---")).drop("solution_user", "solution_date")


def question_status(
    answers: DataFrame, questions: DataFrame, by: Sequence[str] = THREAD, best: str = "is_best"
) -> DataFrame:
    """A question is closed when one of its answers is the best; one without answers is not. ``questions``
    holds each once."""
    closed = answers.groupBy(*by).agg(F.max(F.col(best).cast("int")).alias("_closed"))
    resolve = F.when(F.col("_closed") == 1, "True").otherwise("False").alias("resolve")
    return questions.select(*by).join(closed, list(by), "left").select(*by, resolve)


def to_posts(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions and answers in the post shape; columns a side lacks are NULL."""

    def shape(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in POST]
        )

    return shape(questions).unionByName(shape(answers))


def topic_gate(questions: DataFrame, topics: DataFrame, key: str, tags: Column) -> DataFrame:
    """Questions with at least one tag in the topic list. Questions that carry the same tags are tested once."""
    tagged = questions.withColumn("_tags", tags)
    lists = tagged.select("_tags").distinct().select(F.col("_tags"), F.explode("_tags").alias("topic"))
    passing = lists.join(topics.select("topic").distinct(), "topic", "left_semi").select("_tags").distinct()
    return tagged.join(passing, "_tags", "left_semi").drop("_tags")
