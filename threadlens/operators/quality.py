"""Consistency checks on posts. A fix is a new DataFrame; the caller decides whether to write it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.threads import threads
from threadlens.schema import THREAD, is_answer, is_question


def declared_counts(posts: DataFrame) -> DataFrame:
    return posts.filter(is_question()).groupBy(*THREAD).agg(F.max("answers").alias("expected"))


def prefix_counts(posts: DataFrame) -> DataFrame:
    """Length of the unbroken run of answers 1, 2, 3, … per question.

    The run ends before the smallest ordinal that is called for (1, or one above an answer that is there) but
    missing. Keyed by (thread, ordinal), so one huge thread spreads over all tasks.
    """
    answers = posts.filter(is_answer() & (F.col("ordinal") >= 1)).select(*THREAD, "ordinal")
    questions = posts.filter(is_question()).select(*THREAD, F.lit(0).alias("ordinal"))
    calls = answers.unionByName(questions).select(
        *THREAD,
        F.explode(
            F.array(
                F.struct(F.col("ordinal").alias("at"), F.lit(1).alias("there"), F.lit(0).alias("called")),
                F.struct((F.col("ordinal") + 1).alias("at"), F.lit(0).alias("there"), F.lit(1).alias("called")),
            )
        ).alias("call"),
    )
    places = calls.groupBy(*THREAD, F.col("call.at").alias("at")).agg(
        F.max("call.there").alias("there"), F.max("call.called").alias("called")
    )
    gaps = places.filter((F.col("called") == 1) & (F.col("there") == 0))
    return gaps.groupBy(*THREAD).agg((F.min("at") - 1).alias("found"))


def reconcile_counts(posts: DataFrame) -> DataFrame:
    """Declared answer count of each question against the unbroken run that exists; lowered where too high."""
    questions = declared_counts(posts)
    found = F.least(F.coalesce(F.col("found"), F.lit(0)), F.greatest("expected", F.lit(0))).cast("int")
    checked = questions.join(prefix_counts(posts), list(THREAD), "left").withColumn("found", found)
    return checked.withColumn("answers", F.least("expected", "found")).withColumn(
        "lowered", F.col("found") < F.col("expected")
    )


def fix_counts(posts: DataFrame) -> DataFrame:
    """``posts`` with each question's declared count lowered to the unbroken run of its answers."""
    lowered = reconcile_counts(posts).select(*THREAD, F.col("answers").alias("_kept"))
    questions = posts.filter(is_question()).join(lowered, list(THREAD), "left")
    fixed = questions.withColumn("answers", F.coalesce("_kept", "answers")).select(*posts.columns)
    return fixed.unionByName(posts.filter(is_answer()))


def empty_text(posts: DataFrame) -> DataFrame:
    return posts.filter(F.coalesce(F.col("text"), F.lit("")) == "")


def answer_tags(posts: DataFrame) -> DataFrame:
    """Answers that carry tags."""
    return posts.filter(is_answer() & (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0))


def lift_tags(posts: DataFrame) -> DataFrame:
    """(thread, uid, tag, lifted) of each question: its own tags and those of its answers, each once, one row a
    tag. ``lifted`` marks tags that only answers carry. A thread costs its distinct tags, in no cell."""
    own = posts.filter(is_question()).select(*THREAD, F.explode("tags").alias("tag"), F.lit(False).alias("lifted"))
    given = answer_tags(posts).select(*THREAD, F.explode("tags").alias("tag"), F.lit(True).alias("lifted"))
    tags = own.unionByName(given).groupBy(*THREAD, "tag").agg(F.bool_and("lifted").alias("lifted"))
    return posts.filter(is_question()).select(*THREAD, "uid").join(tags, list(THREAD))


def load_mismatch(posts: DataFrame) -> DataFrame:
    """Threads whose loaded answers differ from the declared count."""
    declared = declared_counts(posts)
    loaded = threads(posts.drop("text")).groupBy(*THREAD).agg(F.count("*").alias("loaded"))
    both = declared.join(loaded, list(THREAD), "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return both.filter((F.col("expected") > 0) & (F.col("loaded") != F.col("expected")))


def solution_consistency(posts: DataFrame) -> DataFrame:
    """Threads where 'resolved' and 'some answer is the solution' disagree."""
    solved = (F.col("resolve") == "solution").cast("int")
    per_thread = posts.groupBy(*THREAD).agg(
        F.max(F.when(is_question(), (F.col("resolve") == "True").cast("int"))).alias("_resolved"),
        F.coalesce(F.max(F.when(is_answer(), solved)), F.lit(0)).alias("_solved"),
    )
    flags = per_thread.filter(F.col("_resolved").isNotNull()).select(
        *THREAD, (F.col("_resolved") == 1).alias("resolved"), (F.col("_solved") == 1).alias("solved")
    )
    return flags.filter(F.col("resolved") != F.col("solved"))
