"""Sentences by learned abbreviations: counts over a corpus say after which words a period ends none.

The statistics are those published by Kiss and Strunk (2006): log-likelihood ratios of "word + period", of pairs around a
period and of words that open sentences. All are counts by word or by pair of words, combined before they are shuffled;
texts are only read. The fixed rule (``functions.text.sentence_count``) breaks after each end mark before a blank; here
a break after a period is taken back where the word before it is an abbreviation, unless the next word opens sentences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.session import stage

# Published thresholds, and the share of periods behind an abbreviation.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
DOTTED_SHARE = 0.99

END_MARKS = (".", "!", "?")
# From the first letter or digit of a word to its last.
CORE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
# A period right behind the core; other marks may follow, as in "etc.,".
DOTTED = r"[\p{L}\p{N}]\.(?:[^\p{L}\p{N}.][^\p{L}\p{N}]*)?$"
LAST_DOT = r"[\p{L}\p{N}]\.$"
CAPITAL = r"^[^\p{L}\p{N}]*\p{Lu}"
SMALL = r"^[^\p{L}\p{N}]*\p{Ll}"
TINY = 1e-12


def core(word: Column) -> Column:
    return F.regexp_extract(F.lower(word), CORE, 0)


def ends(word: Column) -> Column:
    return F.substring(word, -1, 1).isin(*END_MARKS)


def neighbours(posts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and one row for each word: its number from 1 (``at``), the word and the words around it."""
    listed = posts.select(*keep, tx.words(F.col("text")).alias("ws"))
    around = F.arrays_zip(
        F.col("ws").alias("word"),
        F.concat(F.array(F.lit(None).cast("string")), F.col("ws")).alias("before"),
        F.slice("ws", F.lit(2), F.size("ws")).alias("after"),
    )
    rows = listed.select(*keep, F.posexplode(around).alias("at", "w"))
    return rows.select(*keep, (F.col("at") + 1).alias("at"), "w.word", "w.before", "w.after").where(F.col("word").isNotNull())


def word_counts(posts: DataFrame) -> DataFrame:
    """(type, n, dotted, small, inner): occurrences of a word without its outer marks; those with a period; those that
    begin with a small letter; those with a capital letter behind a word without an end mark."""
    within = F.col("before").isNotNull() & ~ends(F.col("before"))
    raw = neighbours(posts).groupBy("word", within.alias("within")).agg(F.count(F.lit(1)).alias("n"))
    word = F.col("word")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return (
        raw.groupBy(core(word).alias("type"))
        .agg(
            F.sum("n").alias("n"),
            total(word.rlike(DOTTED)).alias("dotted"),
            total(word.rlike(SMALL)).alias("small"),
            total(word.rlike(CAPITAL) & F.col("within")).alias("inner"),
        )
        .where(F.col("type") != "")
    )


def break_pairs(posts: DataFrame) -> DataFrame:
    """(type, next, capital, n) of the words on both sides of each break of the fixed rule; the type is NULL where no
    period behind a letter or digit made the break."""
    rows = neighbours(posts).where(F.col("after").isNotNull() & ends(F.col("word")))
    raw = rows.groupBy("word", "after").agg(F.count(F.lit(1)).alias("n"))
    return raw.groupBy(*_pair(F.col("word"), F.col("after"))).agg(F.sum("n").alias("n"))


def _pair(word: Column, after: Column) -> tuple[Column, Column, Column]:
    return (
        F.when(word.rlike(LAST_DOT), core(word)).alias("type"),
        core(after).alias("next"),
        after.rlike(CAPITAL).alias("capital"),
    )


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    share = F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), p))
    return k * F.ln(share) + (n - k) * F.ln(1 - share)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's ratio: does ``second`` follow ``first`` as often as it stands anywhere? Counts of both together, of each, of
    all words."""
    p, p1 = second / total, both / first
    p2 = F.coalesce((second - both) / F.nullif(total - first, F.lit(0)), F.lit(0.0))
    apart = _log_likelihood(both, first, p) + _log_likelihood(second - both, total - first, p)
    bound = _log_likelihood(both, first, p1) + _log_likelihood(second - both, total - first, p2)
    return -2 * (apart - bound)


def abbreviations(counts: DataFrame, words: int, periods: int) -> DataFrame:
    """(type, type_n) of the types whose periods belong to them, with their count. ``words`` and ``periods`` are the sums over ``counts``."""
    n, dotted = F.col("n"), F.col("dotted")
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inside = F.length("type") - letters + 1
    by_chance = F.lit((periods + 0.5) / (words + 1.0))
    ratio = -2 * (_log_likelihood(dotted, n, by_chance) - _log_likelihood(dotted, n, F.lit(DOTTED_SHARE)))
    score = ratio * F.exp(-letters) * inside * F.pow(letters.cast("double"), (dotted - n).cast("double"))
    return counts.where((dotted > 0) & F.col("type").rlike(r"\p{L}") & (score >= ABBREVIATION)).select("type", n.alias("type_n"))


def held_pairs(posts: DataFrame) -> DataFrame:
    """(type, next, capital) of the pairs around a period that ends no sentence, learned from the texts of ``posts``.

    A break behind an abbreviation stays if the next word has a capital letter, is no partner of the abbreviation (they
    stand together more often than by chance), and opens sentences: it stands behind sure breaks more often than
    by chance, or it is also written small and has its capital nowhere within a sentence.
    """
    counts = stage(word_counts(posts), "word-types")
    sums = counts.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")).first()
    words, periods = sums["n"] or 0, sums["dotted"] or 0
    pairs = stage(break_pairs(posts), "break-pairs")
    short = stage(abbreviations(counts, words, periods), "abbreviations")
    sure = pairs.join(short, "type", "left_anti").groupBy("next").agg(F.sum("n").alias("opened"))
    sure = stage(sure, "openers")
    breaks = sure.agg(F.sum("opened")).first()[0] or 0
    total, opened = F.lit(words), F.coalesce("opened", F.lit(0))
    nexts = counts.select(F.col("type").alias("next"), F.col("n").alias("next_n"), "small", "inner").join(sure, "next", "left")
    opens = (opened * total > F.col("next_n") * breaks) & (
        association(opened, F.lit(breaks), F.col("next_n"), total) > STARTER
    )
    known = nexts.select(
        "next", "next_n", (opens if breaks else F.lit(False)).alias("opens"),
        ((F.col("small") > 0) & (F.col("inner") == 0)).alias("small_elsewhere"),
    )
    behind = pairs.join(short, "type")
    together = behind.groupBy("type", "next").agg(F.sum("n").alias("both"), F.first("type_n").alias("type_n"))
    partners = (F.col("both") * total > F.col("type_n") * F.col("next_n")) & (
        association(F.col("both"), F.col("type_n"), F.col("next_n"), total) > COLLOCATION
    )
    judged = together.join(known, "next", "left").select(
        "type",
        "next",
        F.coalesce((F.col("opens") | F.col("small_elsewhere")) & ~(partners & ~F.col("opens")), F.lit(False)).alias("may_break"),
    )
    held = behind.select("type", "next", "capital").join(judged, ["type", "next"])
    return held.where(~(F.col("capital") & F.col("may_break"))).select("type", "next", "capital")


def learned_sentences(posts: DataFrame, held: DataFrame, key: Sequence[str] = ("uid",)) -> DataFrame:
    """(key, sentences, longest_sentence) of every post by ``held_pairs``; without pairs the counts of the fixed rule. Only words
    before a period that meet a held pair leave their row, as numbers. ``posts`` holds each key once; a null or blank text has
    no sentence."""
    listed = posts.select(*key, tx.words(F.col("text")).alias("ws"))
    inner = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0)))
    marked = F.transform(inner, lambda w, i: F.when(ends(w), i + 1))
    plain = listed.select(*key, F.size("ws").alias("_words"), F.filter(marked, lambda at: at.isNotNull()).alias("_breaks"))
    rows = neighbours(posts, key).where(F.col("after").isNotNull() & F.col("word").rlike(LAST_DOT))
    met = rows.select(*key, "at", *_pair(F.col("word"), F.col("after"))).join(held, ["type", "next", "capital"])
    back = met.groupBy(*key).agg(F.collect_list("at").alias("_held"))
    both = plain.join(back, list(key), "left")
    kept = F.array_except("_breaks", F.coalesce("_held", F.array().cast("array<int>")))
    cut = both.select(*key, "_words", kept.alias("_kept"))
    n = F.col("_words")
    spans = F.zip_with(
        F.concat(F.col("_kept"), F.array(n)), F.concat(F.array(F.lit(0)), F.col("_kept")), lambda stop, start: stop - start
    )
    some = F.coalesce(n > 0, F.lit(False))
    return cut.select(
        *key,
        F.when(some, F.size("_kept") + 1).otherwise(F.lit(0)).cast("long").alias("sentences"),
        F.when(some, F.array_max(spans)).otherwise(F.lit(0)).cast("long").alias("longest_sentence"),
    )
