"""Operator 13: quality rules. Base rules on counts, then a likelihood ratio of hashed n-grams.

Two multinomials over ``BUCKETS`` buckets of hashed words and word pairs: one of the trusted documents, one of all
documents. A document's score is the mean over its n-grams of ln(trusted share / raw share) of their buckets, so length
does not matter; every document at or above one threshold is kept. No document is drawn by chance.

What is learned: the trusted multinomial from documents of quality 1 with an even hash, at most ``TRUSTED_ROWS`` of them (those
with the smallest hashes; the list of their ids is what is broadcast). The raw multinomial counts every n-gram
of every document. The threshold is read off all labelled documents with an odd hash that pass the base rules: of the
cuts between neighbouring scores the lowest that tells most of both classes right (share of good ones kept plus
share of bad ones removed). Scores and weights are whole millionths, so sums do not depend on any order.

Base rules: a document fails with fewer than ``LEAST_WORDS`` words, or if more than ``MOST_REPEATED`` percent of its words lie in
windows of ``WINDOW`` words that the text holds twice or more.

Main path: DataFrame functions only. N-grams are counted before the shuffle, at most one row a bucket and task; the weights
(``BUCKETS`` whole numbers) come to the driver and go out as a literal; scores are a projection on the scan. Windows are told
apart in their own row: by hash first, and only in texts where a hash repeats are windows sorted and compared word by word.

Defined results: a null or blank text has no words and fails the base rules; a text without an n-gram scores 0; repeated
rows are judged alike; without labels of both classes there is no threshold, and what passes the base rules is kept; without
trusted documents all weights are 0. A label of a document that is not there counts for nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.llm.common import fresh, let, quoted
from threadlens.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
# Letters, digits and underscores make words of the model; runs of other visible characters are words of their own.
TOKEN = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\s]++"
# Bits of a window's place, beside the first bits of its hash; longer texts have all their windows compared.
PLACE_BITS = 24
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
BUCKETS = 1 << 14
TRUSTED_ROWS = 40_000
# Added to each count.
SMOOTHING = 1.0
SCALE = 1_000_000
# Width of the bins that the threshold is read off, in millionths.
BIN = 1_000


def window_hashes(words: Column) -> Column:
    """A hash of each window of words: of one word, two, four, eight."""

    def doubled(apart: int) -> Callable[[Column], Column]:
        def pairs(hashes: Column) -> Column:
            left = F.greatest(F.size(hashes) - apart, F.lit(0))
            both = F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(apart + 1), left), lambda a, b: F.xxhash64(a, b))
            return F.transform(both, lambda h: F.coalesce(h, F.lit(0).cast("long")))

        return pairs

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for apart in (1, 2, 4):
        hashes = let(hashes, doubled(apart))
    return hashes


def windows_to_compare(hashes: Column) -> Column:
    """Places of the windows that share the first bits of their hash with another; NULL where all hashes differ. First bits and
    place lie in one number, so that plain numbers are sorted. ``hashes`` is a column that is there."""
    place = F.lit((1 << PLACE_BITS) - 1)
    packed = F.sort_array(
        F.transform(
            hashes,
            lambda h, i: F.coalesce(h.bitwiseAND(F.bitwise_not(place.cast("long"))).bitwiseOR(i.cast("long")), F.lit(0).cast("long")),
        )
    )

    def shared(ordered: Column) -> Column:
        def key(x: Column) -> Column:
            return F.shiftright(x, PLACE_BITS)

        def met(x: Column, at: Column) -> Column:
            return F.coalesce(key(x) == key(F.get(ordered, at)), F.lit(False))

        twice = F.filter(ordered, lambda x, i: met(x, i - 1) | met(x, i + 1))
        return F.transform(twice, lambda x: x.bitwiseAND(place.cast("long")).cast("int"))

    every = F.sequence(F.lit(0), F.size(hashes) - 1)
    some = F.when(F.size(hashes) < 1 << PLACE_BITS, let(packed, shared)).otherwise(every)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some)


def repeated_words(words: Column, hashes: Column, places: Column) -> Column:
    """Words in windows that occur twice or more, of the windows at ``places``, which stand in the order of their first bits.

    Windows of the same bits are compared word by word with the one before. Where all are the same, as nearly always,
    every place counts; else the windows of that text are sorted by hash and words, so that equal ones meet."""

    # one word at a time: slices of a column would copy all of it
    def word(i: Column, k: int) -> Column:
        return F.get(words, i + k)

    def window(i: Column) -> Column:
        return F.array(*[word(i, k) for k in range(WINDOW)])

    def bits(i: Column) -> Column:
        return F.shiftright(F.get(hashes, i), PLACE_BITS)

    def odd(i: Column, other: Column) -> Column:
        same = reduce(Column.__and__, [word(i, k) == word(other, k) for k in range(WINDOW)])
        return F.coalesce((bits(i) == bits(other)) & ~same, F.lit(False))

    def met(x: Column, other: Column) -> Column:
        return F.coalesce((x["h"] == other["h"]) & (x["w"] == other["w"]), F.lit(False))

    in_order = F.sort_array(F.transform(places, lambda i: F.struct(F.get(hashes, i).alias("h"), window(i).alias("w"), i.alias("at"))))
    equal = let(
        in_order,
        lambda o: F.transform(
            F.filter(o, lambda x, i: met(x, F.get(o, i - 1)) | met(x, F.get(o, i + 1))), lambda x: x["at"]
        ),
    )
    mixed = F.exists(F.transform(places, lambda i, at: odd(i, F.get(places, at - 1))), lambda x: x)
    unsorted = F.size(hashes) >= 1 << PLACE_BITS
    starts = F.sort_array(F.when(unsorted | mixed, equal).otherwise(places))
    new = let(
        starts,
        lambda s: F.zip_with(
            s,
            F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
            lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)),
        ),
    )
    return F.coalesce(F.aggregate(new, F.lit(0), lambda total, x: total + x), F.lit(0))


def bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def ngrams(tokens: Column) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(
        F.transform(tokens, lambda t: bucket(t)),
        F.zip_with(F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs), lambda a, b: bucket(a, b)),
    )


def model_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def trusted_half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0


@dataclass(frozen=True)
class Model:
    """Weight of each bucket and the threshold of the score, in millionths; no threshold keeps everything."""

    weights: tuple[int, ...]
    threshold: int | None = None


def fit(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> Model:
    """Weights from all ``docs`` (doc_id, text) and the trusted ones among them."""
    good = labels.where((F.col("quality") == 1) & trusted_half(F.col("doc_id"))).select(F.col("doc_id").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted_rows)
    tokens = docs.select("doc_id", model_tokens(F.col("text")).alias("tokens"))
    flagged = tokens.join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left")
    # a row a token with the one behind it, so that the hashes are taken in generated code
    after = F.slice("tokens", F.lit(2), F.size("tokens"))
    in_order = flagged.select(
        F.col("good_id").isNotNull().cast("int").alias("good"), F.inline(F.arrays_zip(F.col("tokens").alias("a"), after.alias("b")))
    )
    pair = F.when(F.col("b").isNotNull(), bucket(F.col("a"), F.col("b")))
    long = in_order.select("good", F.explode(F.array(bucket(F.col("a")), pair)).alias("bucket")).where(F.col("bucket").isNotNull())
    counts = long.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()
    raw, trusted = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row.bucket], trusted[row.bucket] = row.raw, row.good
    if not any(trusted):
        return Model((0,) * BUCKETS)
    base = math.log(sum(raw) + SMOOTHING * BUCKETS) - math.log(sum(trusted) + SMOOTHING * BUCKETS)
    return Model(tuple(
        round(SCALE * (math.log(t + SMOOTHING) - math.log(r + SMOOTHING) + base)) for t, r in zip(trusted, raw, strict=True)
    ))


def measure(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_words``, the base counts, ``base_failed`` and ``score`` (millionths)."""
    held = [f"k{i}" for i in range(len(keep))]
    text = quoted(text_col)
    read = docs.select(
        *[quoted(k).alias(h) for k, h in zip(keep, held, strict=True)],
        text.alias("text"),
        F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("words"),
        F.coalesce(model_tokens(text), F.array().cast("array<string>")).alias("tokens"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = read.select("*", window_hashes(F.col("words")).alias("hashes"))
    compared = hashed.select("*", windows_to_compare(F.col("hashes")).alias("places"))
    weights = F.split(F.lit(",".join(map(str, model.weights))), ",").cast("array<int>")
    total = F.aggregate(
        ngrams(F.col("tokens")), F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(weights, b + 1)
    )
    n_grams = F.greatest(F.size("tokens") * 2 - 1, F.lit(1))
    counted = compared.select(
        *held,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(SYMBOL)), F.lit(0)).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), F.col("hashes"), F.col("places")).cast("long").alias("n_repeat_words"),
        F.floor(total / n_grams).cast("long").alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return counted.select("*", failed.alias("base_failed"))


def threshold(scores: DataFrame) -> int | None:
    """The cut of labelled ``scores`` (score, quality); None without both classes. One row a bin reaches the window, and
    scores lie within a few logarithms, so bins are few at every size."""
    bins = scores.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    ordered = Window.orderBy("bin")
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    cuts = bins.select(
        F.floor((F.col("bin") + F.coalesce(F.lag("bin").over(ordered) + 1, F.col("bin"))) * BIN / 2).cast("long").alias("cut"),
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("good_below"),
        F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("bad_below"),
        F.sum("good").over(Window.partitionBy()).alias("good"),
        F.sum("bad").over(Window.partitionBy()).alias("bad"),
    )
    right = (F.col("good") - F.col("good_below")) * F.col("bad") + F.col("bad_below") * F.col("good")
    best = cuts.where((F.col("good") > 0) & (F.col("bad") > 0)).agg(F.max_by("cut", F.struct(right, -F.col("cut"))).alias("cut")).first()
    return best["cut"]


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (all, unless named) and, behind them, the measures, ``score`` (natural logarithm an
    n-gram), ``base_failed`` and ``kept``; under other names where ``docs`` has these. The measures are
    written once, the threshold is read off them."""
    keep = docs.columns if keep is None else keep
    known = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    model = fit(known, labels)
    held = docs.select(quoted(id_col).alias("own"), *[quoted(k).alias(f"c{i}") for i, k in enumerate(keep)], quoted(text_col).alias("text"))
    measured = stage(measure(held, model, ["own", *[f"c{i}" for i in range(len(keep))]]), "quality")
    told = labels.where(~trusted_half(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    cut = threshold(measured.where(~F.col("base_failed")).join(told, F.col("k0") == F.col("doc_id")))
    verdict = ~F.col("base_failed") & (F.lit(True) if cut is None else F.col("score") >= cut)
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    names = fresh(docs.select(*[quoted(k) for k in keep]), *measures)
    shown = {"score": F.col("score") / SCALE, "kept": verdict}
    return measured.select(
        *[F.col(f"k{i + 1}").alias(k) for i, k in enumerate(keep)],
        *[shown.get(m, F.col(m)).alias(n) for m, n in zip(measures, names, strict=True)],
    )
