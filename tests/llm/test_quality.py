"""Quality rules against a plain version, and accuracy on labelled documents that nothing was learned from."""

import math
import re
from collections import Counter

import pytest
import regex
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F

from threadlens.llm import quality, queries

TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bucket(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return signed(seed) % quality.BUCKETS


def grams(text):
    tokens = TOKEN.findall((text or "").lower())
    return [bucket(t) for t in tokens] + [bucket(a, b) for a, b in zip(tokens, tokens[1:])]


def id_hash(doc_id):
    return signed(xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42))


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed,
    )


def plain(docs, labels):
    """(doc_id, measures, score, verdict) of each document."""
    good = {i for i, q in labels if q == 1 and id_hash(i) % 2 == 0}
    raw, trusted = Counter(), Counter()
    for i, text in docs:
        raw.update(grams(text))
        if i in good:
            trusted.update(grams(text))
    total = lambda c: sum(c.values()) + quality.BUCKETS
    shift = math.log(total(raw)) - math.log(total(trusted))
    weight = [
        round(quality.SCALE * (math.log(trusted[b] + 1) - math.log(raw[b] + 1) + shift)) if trusted else 0
        for b in range(quality.BUCKETS)
    ]
    rows = []
    for i, text in docs:
        found = grams(text)
        rows.append((i, *base(text), sum(weight[b] for b in found) // max(len(found), 1)))
    told = {(i, q) for i, q in labels if q in (0, 1) and id_hash(i) % 2}
    seen = [(r[7] // 1000, q) for r in rows if not r[6] for i, q in told if i == r[0]]
    cut = None
    if len({q for _, q in seen}) == 2:
        bins = sorted({b for b, _ in seen})
        best = None
        for k, b in enumerate(bins):
            edge = (b + (bins[k - 1] + 1 if k else b)) * 1000 // 2
            right = sum(q == 1 and s >= b for s, q in seen) * sum(q == 0 for _, q in seen) + sum(
                q == 0 and s < b for s, q in seen
            ) * sum(q == 1 for _, q in seen)
            if best is None or right > best[0]:
                best = (right, edge)
        cut = best[1]
    return [(*r[:7], r[7] / quality.SCALE, not r[6] and (cut is None or r[7] >= cut)) for r in rows]


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_query_against_a_plain_version(spark):
    found = queries.QUERIES["op13_quality_rules"](spark, SMALL)
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()]
    expected = plain(docs, labels)
    assert got(found) == sorted(expected, key=str)
    assert {r[-1] for r in expected} == {True, False}


def test_accuracy_on_unseen_documents(spark):
    """The threshold is read off one half of the labels, the n-grams of the other: crosswise neither is seen whole."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit("unseen")), F.lit(3)) == 0
    judged = quality.judge(docs, labels.where(~unseen), ["doc_id"]).where("n_words >= 20 and not base_failed")
    rows = judged.join(labels.where(unseen), "doc_id").select("quality", "kept").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 80 and len(bad) > 5
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.15 * len(bad)


def test_base_counts_of_odd_texts(spark, make):
    loop = "one two three four five six seven eight "
    texts = [
        None, "", "\n\n \t", "a", "# * $ % & | < > ##", "x\nx\n\nx\n x", loop * 2, loop + "nine " + loop, loop[:-1],
        "w " * 500, "a b c", "naïve 日本語 👩‍👩‍👧 end", loop + "x " * 30 + loop * 3, "p\r\np\r\n",
    ]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.judge(make(texts, strange=True), labels, ["doc_id"]).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {
        i: base(t) for i, t in enumerate(texts)
    }
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in rows)


@pytest.mark.parametrize("bits", [24, 3])
def test_windows_whose_hashes_collide_are_compared(spark, make, monkeypatch, bits):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    text = " ".join(f"w{i}" for i in range(40)) + " w3 w4 w5 w6 w7 w8 w9 w10 w11"
    words = make([text, "a b"]).select("doc_id", F.split("text", " ").alias("words"))
    hashed = words.select("*", quality.window_hashes(F.col("words")).alias("h"))
    placed = hashed.select("*", quality.windows_to_compare(F.col("h")).alias("p"))
    rows = placed.select("doc_id", quality.repeated_words(F.col("words"), F.col("h"), F.col("p")).alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {0: base(text)[4], 1: 0} == {0: 18, 1: 0}


def test_odd_rows_and_labels(spark, make):
    good, bad = "calm words make a good text and so it goes on for some more words until there are enough ones", "&&& ### buy!!! now " * 3
    bad += "a b c d e f g h i j k l"
    rows = [(i, (good if i % 3 else bad) + f" {i}", None) for i in range(60)] + [(None, good, None), (5, good + " 5", None), (5, good + " 5", None)]
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (999, 1, 0), (3, None, 0)] * 2, "doc_id long, quality int, toxic int"
    )
    docs = make(rows, strange=True)
    found = quality.judge(docs, labels)
    assert found.columns[: len(docs.columns)] == docs.columns
    kept, text = found.columns[-1], "text"
    shown = found.collect()
    assert len(shown) == len(rows)
    assert all(r[kept] == ("&&&" not in r[text]) for r in shown)


@pytest.mark.parametrize("empty", ["docs", "labels", "both"])
def test_empty_tables(spark, make, empty):
    docs = make([] if empty != "labels" else ["some words"])
    labels = spark.createDataFrame([] if empty != "docs" else [(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels, ["doc_id"]).count() == docs.count()


def test_native(spark):
    plan = queries.QUERIES["op13_quality_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|MapInPandas|MapInArrow", plan)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = quality.measure(docs, quality.Model((0,) * quality.BUCKETS), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|MapInPandas|MapInArrow|Exchange", plan)
