"""Answer features and the 33-column table for best-answer prediction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions.stemming import porter
from threadlens.operators.corpus import Lexicon, Stemmer, lexicon, log_likelihood
from threadlens.operators.ranks import RankSpec, add_ranks
from threadlens.operators.skew import HotKeys, attach_group, heavy_keys
from threadlens.operators.threads import answer_rows, has_tags, threads
from threadlens.schema import POST_KEY, STORE_DATE, THREAD

# Feature columns in file order.
FEATURES = (
    "resolved", "question_uid", "answers_count", "answer_uid", "date_time", "time_difference",
    "time_difference_rank", "solution", "len", "len_rank", "wordcount", "wordcount_rank", "avg_chars_per_word",
    "avg_chars_per_word_rank", "sentences", "sentences_rank", "avg_words_per_sentence",
    "avg_words_per_sentence_rank", "longest_sentence", "longest_sentence_rank", "views", "views_rank",
    "loglikelihood", "loglikelihood_ascending_rank", "loglikelihood_descending_rank", "F-K",
    "F-K_ascending_rank", "F-K_descending_rank", "upvotes", "upvotes_rank", "has_links", "has_code_snippet",
    "has_tags",
)

# What is ranked, and which way.
RANKS = (
    RankSpec("upvotes", "upvotes_rank"),
    RankSpec("sentences", "sentences_rank"),
    RankSpec("len", "len_rank"),
    RankSpec("views", "views_rank"),
    RankSpec("wordcount", "wordcount_rank"),
    RankSpec("avg_chars_per_word", "avg_chars_per_word_rank"),
    RankSpec("avg_words_per_sentence", "avg_words_per_sentence_rank"),
    RankSpec("longest_sentence", "longest_sentence_rank"),
    RankSpec("time_difference", "time_difference_rank", descending=False),
    RankSpec("loglikelihood", "loglikelihood_descending_rank"),
    RankSpec("loglikelihood", "loglikelihood_ascending_rank", descending=False),
    RankSpec("F-K", "F-K_descending_rank"),
    RankSpec("F-K", "F-K_ascending_rank", descending=False),
)


def time_difference(answer: Column, question: Column) -> Column:
    """Seconds between answer and question; an unknown question date counts as 1970-01-01, an unknown answer
    date gives NULL."""
    base = F.coalesce(question.cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    return F.abs(F.unix_micros(answer.cast("timestamp")) - F.unix_micros(base)) / 1_000_000


def solution(resolve: Column) -> Column:
    return resolve.eqNullSafe(F.lit("solution"))


def text_features(df: DataFrame, average_syllables: bool = False) -> DataFrame:
    """All measures of ``text``, which is dropped. ``average_syllables`` divides the syllable total by the
    words, as its name promises; the default keeps the total."""
    text = F.col("text")
    measured = df.withColumns(
        {
            "len": tx.length(text),
            "wordcount": tx.word_count(text),
            "sentences": tx.sentence_count(text),
            "longest_sentence": tx.longest_sentence(text),
            "_syllables": tx.syllables(text),
            "has_links": tx.has_links(text),
            "has_code_snippet": tx.has_code(text),
        }
    ).drop("text")
    syllables = F.col("_syllables")
    if average_syllables:
        syllables = F.when(F.col("wordcount") > 0, syllables / F.col("wordcount")).otherwise(F.lit(0.0))
    rated = measured.withColumns(
        {
            "avg_chars_per_word": tx.ratio2(F.col("len"), F.col("wordcount")),
            "avg_words_per_sentence": tx.ratio2(F.col("wordcount"), F.col("sentences")),
        }
    )
    return rated.withColumn("F-K", tx.readability(F.col("avg_words_per_sentence"), syllables)).drop("_syllables")


def measured_answers(posts: DataFrame, compat: str | None = None) -> DataFrame:
    """Answers with their text measures in place of the text."""
    return text_features(
        answer_rows(posts, compat).select(
            *THREAD, "ordinal", "uid", "text", "date_time", "views", "upvotes", "resolve"
        )
    )


def features(
    posts: DataFrame,
    lex: Lexicon | None = None,
    stemmer: Stemmer = porter,
    hot: HotKeys | None = None,
    compat: str | None = None,
    unranked: Sequence[str] = (),
    guarded: Sequence[str] = (),
) -> DataFrame:
    """One row per answer: site, thread_id, ordinal and the 33 feature columns.

    Texts are measured where they are read; only numbers are shuffled. Join and all ranks use one
    partitioning by thread, and threads too large for one task go the distributed way. ``posts`` holds each
    (site, uid) once (``dedup_last``).

    One site pairs threads with ``compat="c"`` (see ``threads``), leaves the ``unranked`` rank columns empty (there:
    upvotes_rank) and those in ``guarded`` for threads that lack a value of the key (there: views_rank).
    """
    hot = heavy_keys(posts, THREAD) if hot is None else hot
    lex = lexicon(posts, stemmer) if lex is None else lex
    parts = [_feature_rows(part, lex, keys, compat, guarded) for part, keys in hot.parts(posts)]
    table = reduce(DataFrame.unionByName, parts)
    return table.withColumns({c: F.lit(None).cast("int") for c in unranked}) if unranked else table


def _feature_rows(posts: DataFrame, lex: Lexicon, hot: HotKeys, compat: str | None, guarded: Sequence[str]) -> DataFrame:
    scores = log_likelihood(answer_rows(posts, compat), lex, POST_KEY)
    measured = measured_answers(posts, compat).join(scores, list(POST_KEY), "left")
    in_threads = threads(posts, measured, compat)
    tagged = in_threads.join(has_tags(posts, F.col("tags")), list(THREAD))
    timed = tagged.withColumns(
        {
            "time_difference": time_difference(F.col("date_time"), F.col("question_date")),
            "loglikelihood": F.coalesce("loglikelihood", F.lit(0.0)),
        }
    )
    ranked = add_ranks(timed, RANKS, THREAD, "uid", hot)
    if guarded:
        keys = {spec.out: spec.key for spec in RANKS if spec.out in guarded}
        lacks = {f"_lacks_{out}": F.max(F.col(f"`{key}`").isNull()) for out, key in keys.items()}
        marked = attach_group(ranked, THREAD, lacks, hot)
        ranked = marked.withColumns({out: F.when(~F.col(f"_lacks_{out}"), F.col(f"`{out}`")) for out in keys}).drop(*lacks)
    return ranked.withColumns(
        {
            "answer_uid": F.col("uid"),
            "solution": solution(F.col("resolve")),
            "date_time": F.date_format("date_time", STORE_DATE),
        }
    ).select(*THREAD, "ordinal", *[F.col(f"`{c}`") for c in FEATURES])
