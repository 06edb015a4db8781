"""Text measures as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
LONE_TOKEN = rf"(?<!\S)(?:{TOKEN})(?!\S)"

# Fixed value: marks of a link and of program code in a post.
LINK_MARK = r"http(s)?://"
CODE_MARK = (
    r"(?i)(\{|\}| package |\.jar| class | namespace |exception |<<| end | def |<\?php| soap | <xml| wsdl "
    r"|\.cs|\.java|\.php|\.rb|lambda)"
)

# Weights of the readability score.
FK_WORDS, FK_SYLLABLES, FK_BASE = 0.39, 11.8, 15.59


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def lone_tokens(text: Column) -> Column:
    """Tokens that stand alone between blanks."""
    return F.regexp_extract_all(F.lower(text), F.lit(LONE_TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def length(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def sentence_count(text: Column) -> Column:
    """Each end mark followed by space and more text starts another sentence."""
    breaks = F.regexp_count(text, F.lit(r"[.!?]\s+(?=\S)"))
    return F.coalesce(breaks + text.rlike(r"\S").cast("int"), F.lit(0)).cast("long")


def longest_sentence(text: Column) -> Column:
    per_sentence = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_count(s, F.lit(r"\S+")))
    return F.coalesce(F.array_max(per_sentence), F.lit(0)).cast("long")


def ratio2(a: Column, b: Column) -> Column:
    """a/b with two decimals, half up, in whole numbers until the last step; 0 where b is 0."""
    return F.when(b > 0, F.floor((a * 200 + b) / (b * 2)) / 100).otherwise(F.lit(0.0))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def syllables(text: Column) -> Column:
    """Vowel groups, less one for each word with a silent ending. A total, and it may fall below zero."""
    groups = F.regexp_count(text, F.lit("[aeiouy]+"))
    silent = F.regexp_count(text, F.lit(r"(?<=\S)es?(?!\S)"))
    return F.coalesce(groups - silent, F.lit(0)).cast("long")


def readability(words_per_sentence: Column, syllable_total: Column) -> Column:
    return words_per_sentence * FK_WORDS + syllable_total * FK_SYLLABLES - FK_BASE


def has_links(text: Column) -> Column:
    return F.coalesce(text.rlike(LINK_MARK), F.lit(False))


def has_code(text: Column) -> Column:
    return F.coalesce(text.rlike(CODE_MARK), F.lit(False))
