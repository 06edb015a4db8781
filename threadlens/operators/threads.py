"""Threads: a question with its answers, and what the whole thread shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.schema import SENTINELS, THREAD, is_answer, is_question


def question_side(posts: DataFrame) -> DataFrame:
    """The thread-level columns, exactly one row per thread: copies of a question collapse map-side, and the
    aggregate leaves the rows partitioned for the join that follows."""
    columns = {"question_uid": "uid", "answers_count": "answers", "resolved": "resolve", "question_date": "date_time"}
    question = F.struct(*[F.col(c).alias(name) for name, c in columns.items()])
    per_thread = posts.filter(is_question()).groupBy(*THREAD).agg(F.min(question).alias("q"))
    return per_thread.select(*THREAD, *[f"q.{name}" for name in columns])


def answer_rows(posts: DataFrame, compat: str | None = None) -> DataFrame:
    """Posts that count as answers: with ``compat="c"`` the question too."""
    return posts if compat == "c" else posts.filter(is_answer())


def threads(posts: DataFrame, answers: DataFrame | None = None, compat: str | None = None) -> DataFrame:
    """Answers with the columns of their question; ordinals above the declared count are left out, and
    threads without answers give no rows.

    ``answers`` may carry ready-made feature columns so that texts are not shuffled. ``compat="c"`` keeps the
    off-by-one of one site: the question counts as post 1 and the last answer is lost.
    """
    rows = answer_rows(posts, compat) if answers is None else answers
    number = F.col("ordinal") + 1 if compat == "c" else F.col("ordinal")
    rows = rows.withColumn("_number", number).filter(F.col("_number") >= 1)
    keep = [c for c in rows.columns if c not in ("answers",)]
    joined = rows.select(*keep).join(question_side(posts), list(THREAD))
    return joined.filter(F.col("_number") <= F.col("answers_count")).drop("_number")


def nest(posts: DataFrame) -> DataFrame:
    """Thread objects for export, in the long form: the thread's columns, the ordinal, and the answer as a
    struct. Rows lie in order of (thread, ordinal); a thread of any length runs over as many rows, and files,
    as it needs, and no cell grows with it."""
    answer = F.struct("uid", "author", "text", "date_time", "views", "upvotes", "resolve")
    rows = threads(posts).select(
        *THREAD, "question_uid", "question_date", "answers_count", "resolved", "ordinal", answer.alias("answer")
    )
    return rows.repartitionByRange(*THREAD, "ordinal").sortWithinPartitions(*THREAD, "ordinal")


def split_tags(raw: Column, ordinal: Column) -> Column:
    """Tag names of a raw tag text: a question's are split on '.', an answer's on blanks."""
    parts = F.when(ordinal == 0, F.split(raw, r"\.")).otherwise(F.split(raw, r"\s+"))
    return F.filter(parts, lambda t: ~t.isin(*SENTINELS))


def thread_tag_rows(df: DataFrame, tags: Column, by=THREAD) -> DataFrame:
    """(thread, tag), each once."""
    return df.select(*by, F.explode(tags).alias("tag")).distinct()


def thread_tags(df: DataFrame, tags: Column, by=THREAD) -> DataFrame:
    """Distinct tags of each thread, one row a tag; a thread without tags has one row with a NULL tag. Folded
    map-side, so a thread with very many posts is one row a task and tag."""
    listed = df.select(*by, F.explode_outer(F.array_distinct(tags)).alias("tag")).distinct()
    any_tag = listed.groupBy(*by).agg(F.count("tag").alias("_tags"))
    kept = listed.join(any_tag, list(by)).filter(F.col("tag").isNotNull() | (F.col("_tags") == 0))
    return kept.drop("_tags")


def has_tags(df: DataFrame, tags: Column, by=THREAD) -> DataFrame:
    """Whether the thread has any tag: a flag per thread, no lists."""
    any_tag = F.max((F.size(F.coalesce(tags, F.array().cast("array<string>"))) > 0).cast("int"))
    return df.groupBy(*by).agg((any_tag == 1).alias("has_tags"))
