"""Periodic runs against a brute force over all lags and places."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SMALL
from threadlens.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch of each lag, kept if no shorter lag has the same stretch as a whole period."""
    n, out = len(words), []

    def smallest(a, b):
        return next(q for q in range(1, b - a + 1) if all(words[i] == words[i - q] for i in range(a + q, b)))

    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            a, length = first - q, i - first + q
            if length >= max(12, 2 * q) and smallest(a, i) == q:
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=90), max_size=4))
def test_random_words_of_a_small_alphabet(texts):
    assert periodic.find_runs(texts) == [brute_runs(words) for words in texts]


def test_planted_repetitions():
    rng = random.Random(5)
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.choice("abcdef").encode() for _ in range(rng.choice((1, 2, 3, 5, 6, 7, 11, 12, 13, 24, 25, 40)))]
            span = int(len(unit) * rng.uniform(0.5, 5))
            words += (unit * 6)[:span] + [rng.choice("xyz").encode()] * rng.randint(0, 2)
        assert periodic.find_runs([words, words[:7], words]) == [brute_runs(words), [], brute_runs(words)]


def test_blocks_within_blocks():
    block = [b"a"] * 50 + [b"b"]
    for words in (block * 8, (block * 3 + [b"c"]) * 4, ([b"a"] * 30 + [b"b"] + [b"a"] * 20 + [b"b"]) * 5, list(b"aabaaba" * 12)):
        words = [bytes([w]) if isinstance(w, int) else w for w in words]
        assert periodic.find_runs([words]) == [brute_runs(words)]


@pytest.mark.parametrize("words", [[b"a"] * 300_000, [b"a", b"b", b"c"] * 100_000, ([b"a"] * 400 + [b"b"]) * 300])
def test_very_long_repetitive_texts(words):
    (runs,) = periodic.find_runs([words])
    assert runs[0][:2] in ((0, len(words)), (0, 400))
    assert max(r[1] for r in runs) == len(words)


def test_query_against_brute_force(spark):
    got = [tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(brute_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_rows(make):
    loop = "x y z " * 6
    rows = [(1, None, None), (2, "", None), (3, " \t\n ", None), (4, loop, None), (4, loop, None), (None, "q " * 12, None), (7, "q\u00a0q r " * 5, None)]
    docs = make(rows, strange=True)
    docs = docs.withColumnsRenamed({"chunk": "runs"})
    found = periodic.periodic_runs(docs)
    assert found.columns[: len(docs.columns)] == docs.columns
    words, runs, collapsed = found.columns[-3:]
    by_id = {(r.doc_id, r[runs][0].period if r[runs] else None): (r[words], [tuple(x) for x in r[runs]], r[collapsed]) for r in found.collect()}
    assert by_id[1, None] == by_id[2, None] == by_id[3, None] == (0, [], "")
    assert by_id[4, 3] == (18, [(0, 18, 3)], "x y z")
    assert by_id[None, 1] == (12, [(0, 12, 1)], "q")
    assert by_id[7, None] == (10, [], ("q\u00a0q r " * 5).strip())
    assert found.count() == 7


def test_empty_table(make):
    assert periodic.digest(periodic.periodic_runs(make([]), ["doc_id"])).count() == 0
