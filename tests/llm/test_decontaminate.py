import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import decontaminate as d


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    out = set()
    for doc, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            iw = words(item_text)
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for at in range(len(ws) - n + 1):
                    if ws[at : at + n] == iw[a : a + n]:
                        hit |= set(range(at, at + n))
                        found.add(item)
        out.add((doc, len(ws), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    return out


def found(df, benchmark):
    rows = d.find_contamination(df, benchmark, ["doc_id"]).collect()
    return {
        (r.doc_id, r.n_words, sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)), tuple(r["items"])) for r in rows
    }


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def planted():
    rnd = random.Random(8)
    vocabulary = ["the", "of", "Été", "naïve", "x1", "42", *[f"w{i}" for i in range(12)]]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rnd.choice([0, 1, 2, 3, 9, 10, 11, 25]))) for i in range(30)]
    items += [(40, items[7][1]), (None, sentence(30)), (41, None), (42, "...")]
    docs = []
    for i in range(60):
        text = sentence(rnd.randrange(0, 60))
        if i % 2:
            source = words(rnd.choice([t for _, t in items if t]))
            a = rnd.randrange(0, max(1, len(source) - 10))
            text += " " + ", ".join(w.upper() for w in source[a : a + rnd.randrange(9, 16)]) + ". " + sentence(5)
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (102, "!?")], items


def test_against_brute_force(spark, make):
    docs, items = planted()
    df = make([(i, t, None) for i, t in docs], strange=True)
    assert found(df, items_table(spark, items)) == brute(docs, items)


def test_more_passes_give_the_same(spark, make, monkeypatch):
    docs, items = planted()
    df = make([(i, t, None) for i, t in docs], strange=True)
    monkeypatch.setattr(d, "SHARD_BYTES", 400)
    assert len(d._shards(items_table(spark, items), "item_id", "text")) > 2
    assert found(df, items_table(spark, items)) == brute(docs, items)


def test_edges(spark, make):
    df = make([(1, "a b c", None), (1, "a b c", None), (None, None, None)])
    none = items_table(spark, [])
    assert found(df, none) == {(1, 3, 0, ()), (None, 0, 0, ())}
    assert d.find_contamination(make([]), none, ["doc_id"]).count() == 0
    one = items_table(spark, [(5, "B")])
    assert found(df, one) == {(1, 3, 1, ("5",)), (None, 0, 0, ())}
    long = "filler " * 200_000 + "one two three four five six seven eight nine ten"
    item = items_table(spark, [(9, "one two three four five six seven eight nine ten")])
    assert found(make([(1, long, None)]), item) == {(1, 200_010, 10, ("9",))}


def test_stage_keeps_clean_documents(spark, make):
    passage = " ".join(f"q{i}" for i in range(30))
    df = make([(1, "clean text", None), (2, f"before {passage} after", None), (3, None, None)], strange=True)
    left = d.drop_contaminated(df, items_table(spark, [(1, passage)]))
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {1, 3}


def test_digest_names_items_in_order_of_strings(spark, make):
    import hashlib

    df = make([(1, "alpha beta", None)])
    found_ = d.find_contamination(df, items_table(spark, [(10, "alpha"), (9, "beta"), (10, "beta")]), ["doc_id"])
    row = d.digest(found_).collect()[0]
    assert row.items_sha256 == hashlib.sha256(b"10,9").hexdigest() and row.n_items == 2 and row.n_hit == 2
    assert d.digest(found_).where(F.col("contaminated")).count() == 1


def test_keys_of_any_vocabulary_fit_64_bits():
    """An item of millions of distinct words: ids beyond the cube root of 2^63, in both ways to the key."""
    shard = d.Shard()
    window = (2**31 - 1, 2_097_152, 7, 2**31 - 9, 2**40, 3)
    keys = shard.keys(window)
    assert all(-(2**63) <= key < 2**63 for _, key, _ in keys) and len({key for _, key, _ in keys}) == 4
    at, got = shard.places(np.array((5, 0, *window, 0), np.int64), 3)
    assert at.tolist() == [2, 3, 4, 5] and got.tolist() == [key for _, key, _ in keys]


@pytest.mark.parametrize("factor", [0, 1])
def test_shingles_that_share_a_key_find_the_same(monkeypatch, factor):
    """Keys that are the last word alone, or the sum of the words, against the true keys."""
    rnd = random.Random(3)
    words = [f"w{i}".encode() for i in range(12)]
    text = lambda n: b" ".join(rnd.choice(words) for _ in range(n))
    items = [(f"i{k}", text(rnd.choice([1, 2, 3, 9, 10, 14]))) for k in range(12)]
    texts = [text(40) + b" " + items[k][1] + b" " + text(5) for k in range(12)] + [text(60) for _ in range(10)]

    def found():
        index = d.Index.of(d.Shard.of(items), {})
        return [(n, hit.tolist(), sorted(named)) for n, hit, named in map(index.search, texts)]

    true = found()
    monkeypatch.setattr(d, "KEY_FACTOR", factor)
    assert found() == true and any(named for _, _, named in true)
