"""Corpus statistics. Word order never matters downstream, so a corpus is a table of words with counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions.stemming import porter
from threadlens.session import stage

Stemmer = Callable[[DataFrame], DataFrame]
Tokenizer = Callable[[Column], Column]


def token_rows(posts: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    """Every token occurrence."""
    return posts.select(F.explode(tokenizer(F.col("text"))).alias("token"))


def token_counts(posts: DataFrame, tokenizer: Tokenizer = tx.tokens) -> DataFrame:
    return token_rows(posts, tokenizer).groupBy("token").agg(F.count("*").alias("n"))


def stems(tokens: DataFrame, stemmer: Stemmer = porter) -> DataFrame:
    """(token, n, stem): only distinct tokens are stemmed."""
    return stemmer(tokens)


def frequency(stemmed: DataFrame) -> DataFrame:
    return stemmed.groupBy("stem").agg(F.sum("n").alias("n"))


def vocabulary(stemmed: DataFrame) -> DataFrame:
    return stemmed.select("stem").distinct()


def cutoff(freq: DataFrame, above: int = 1) -> DataFrame:
    return freq.filter(F.col("n") > above)


@dataclass(frozen=True)
class Lexicon:
    """Words worth scoring with ln(frequency of their stem), and the size of the whole vocabulary."""

    words: DataFrame  # w, n, lnf
    vocabulary: int
    tokenizer: Tokenizer = tx.tokens


def lexicon(posts: DataFrame, stemmer: Stemmer = porter, tokenizer: Tokenizer = tx.tokens, above: int = 1) -> Lexicon:
    """One pass over the corpus; the counted and stemmed vocabulary is staged and the rest reads that table.
    A stem at or below the cut-off counts as frequency 1, whose logarithm is 0, so its words are left out."""
    stemmed = stage(stems(token_counts(posts, tokenizer), stemmer), "stems")
    freq = stage(frequency(stemmed), "stem-counts")
    size = freq.count()
    kept = cutoff(freq, above).select("stem", F.ln("n").alias("lnf"))
    words = stage(stemmed.join(kept, "stem").select(F.col("token").alias("w"), "n", "lnf"), "lexicon")
    return Lexicon(words, size, tokenizer)


def word_weights(posts: DataFrame, lex: Lexicon, key: tuple[str, ...]) -> DataFrame:
    """(key, w, kind) of every token (kind 0) and every blank-separated word (kind 1)."""
    text = F.col("text")
    # a word counts only if it is a token too, so other words need not be listed
    alone = tx.lone_tokens(text) if lex.tokenizer is tx.tokens else tx.words(F.lower(text))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), lex.tokenizer(text).alias("ws")),
        F.struct(F.lit(1).alias("kind"), alone.alias("ws")),
    )
    return posts.select(*key, F.explode(kinds).alias("l")).select(*key, "l.kind", F.explode("l.ws").alias("w"))


def log_likelihood(posts: DataFrame, lex: Lexicon, key: tuple[str, ...] = ("uid",)) -> DataFrame:
    """(key, loglikelihood): sum over tokens of C(w)·ln(freq(stem w)), divided by the vocabulary size. Posts
    without a scored word that stands alone have no row.

    The words of a post are counted where its text is read, so what is shuffled is one row for each of its distinct words, however
    often they stand in it. These meet the written lexicon in one plain join, whatever its size: a small one is broadcast
    by the optimizer, a large one is joined by shuffle, where adaptive execution splits the most frequent words.
    """
    weight = F.sum(1 - F.col("kind")) * F.sum("kind")
    counted = word_weights(posts, lex, key).groupBy(*key, "w").agg(weight.alias("weight")).filter(F.col("weight") > 0)
    parts = counted.join(lex.words.select("w", "lnf"), "w")
    score = tx.round2(F.sum(F.col("weight") * F.col("lnf")) / lex.vocabulary) if lex.vocabulary else F.lit(0.0)
    return parts.groupBy(*key).agg(score.alias("loglikelihood"))


def scored_posts(posts: DataFrame, lex: Lexicon, key: tuple[str, ...] = ("uid",)) -> DataFrame:
    """``log_likelihood`` for every post; one without scored words has 0."""
    found = log_likelihood(posts, lex, key)
    return posts.select(*key).join(found, list(key), "left").fillna(0.0, subset=["loglikelihood"])
