"""Alignment of two tokenizers against a plain version and exact round trips."""

import hashlib
import sys
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlens.llm import alignment, queries

ODD = [
    None, "", "a", " ", "  two  blanks ", "tab\tand\nline\r\n", "naïve café — déjà vu", "日本語のテキスト", "emoji 👩‍👩‍👧 end",
    "<|endoftext|> and <s> and </s> <unk> <0x41>", "under▁score", "nul\x00byte", "é combining", "ﬁ ligature ½", "x" * 5000,
    "a b " * 3000, "1234567890 " * 50, " nbsp　wide", "don't we'll I'M", " lead", "trail ",
]


@pytest.fixture(scope="module")
def encoder():
    return alignment.encoder(alignment.tokenizer_path(alignment.A_FILE), alignment.tokenizer_path(alignment.B_FILE))


@lru_cache
def reference():
    """The JSON file as its own library runs it."""
    tokenizer = Tokenizer.from_file(alignment.tokenizer_path(alignment.A_FILE))
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain_tokens(encoder, text):
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = reference().encode(" " + text, add_special_tokens=False).ids
    b = encoder.b.encode(text)
    same = b"".join(encoder.a_bytes[i] for i in a) == whole and b"".join(encoder.b_bytes[i] for i in b) == whole
    return (a, b) if same else ([], [])


def ends(table, ids):
    out, at = [], 0
    for i in ids:
        at += len(table[i])
        out.append(at)
    return out


def plain(encoder, texts):
    """Every pair of tokens is looked at."""
    rows, linked = [], []
    for text in texts:
        a, b = plain_tokens(encoder, text)
        a_ends, b_ends = ends(encoder.a_bytes, a), ends(encoder.b_bytes, b)
        linked.append([(x, y) for x, p in zip(a, a_ends) for y, q in zip(b, b_ends) if p == q])
        groups, i, j = [], 0, 0
        for k in sorted(set(a_ends) & set(b_ends)):
            i2, j2 = a_ends.index(k) + 1, b_ends.index(k) + 1
            groups.append(f"{','.join(map(str, a[i:i2]))}|{','.join(map(str, b[j:j2]))}")
            i, j = i2, j2
        shown = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append([len(a), len(b), len(groups), len(linked[-1]), shown])
    counts = Counter(pair for some in linked for pair in some)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (*r[:4], sum(counts[p] == most[p[1]] for p in some), sum(counts[p] for p in some), r[4])
        for r, some in zip(rows, linked)
    ]


def result(df):
    return [tuple(r) for r in df.collect()]


def test_query_against_all_pairs(spark, encoder):
    got = sorted(result(queries.QUERIES["op11_tokenizer_alignment"](spark, SMALL)))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    expected = plain(encoder, [r.text for r in docs])
    assert got == [(r.doc_id, *e) for r, e in zip(docs, expected)]
    assert all(r[3] > 0 for r in got if r[1])


def test_odd_texts(spark, make, encoder):
    texts = [*ODD, "don't we'll I'M"]  # the last text twice
    got = sorted(result(alignment.align_documents(make(texts, strange=True))))
    assert got == [(i, *e) for i, e in enumerate(plain(encoder, texts))]
    by_text = dict(zip(texts, got))
    for none in (None, "", "under▁score"):
        assert by_text[none][1:] == (0, 0, 0, 0, 0, 0, "")
    assert by_text["<|endoftext|> and <s> and </s> <unk> <0x41>"][1] > 0


def test_pieces_of_a_long_text_give_the_same_ids(encoder, monkeypatch):
    assert encoder.cuttable
    text = " ".join(["Some words, and 12 more.", "ein Wort für alle", "日本語 x y"] * 40)
    whole = plain_tokens(encoder, text)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 50)
    assert len(list(encoder.pieces(text))) > 20
    assert list(encoder.encode([text, "a b", text])) == [whole, plain_tokens(encoder, "a b"), whole]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80) | st.text("abcdenrst' ing.,\n1", max_size=120))
def test_ids_of_the_two_engines(text):
    known = alignment.encoder(alignment.tokenizer_path(alignment.A_FILE), alignment.tokenizer_path(alignment.B_FILE))
    assert known.a.encode_ordinary(" " + text) == reference().encode(" " + text, add_special_tokens=False).ids


@pytest.fixture
def task(make, monkeypatch):
    """What ``align`` does to a slice of rows."""
    starts = []
    monkeypatch.setattr(alignment, "arrow_columns", lambda docs, keep, inputs, results, start: starts.append(start))
    alignment.align(make(["a"]))
    return starts[0]()


def test_python_calls_do_not_grow_with_the_text(task):
    def calls(times):
        seen = Counter()
        texts = pa.array(["Some words, and 12 more; naïve 日本語. " * times])
        sys.setprofile(lambda frame, event, arg: seen.update([event]))
        try:
            task(texts)
        finally:
            sys.setprofile(None)
        return seen["call"] + seen["c_call"]

    calls(1)
    assert calls(400) <= calls(4) + 20  # 40 to 4000 words


@pytest.mark.parametrize("batch", [1, 60, 100_000])
def test_a_slice_in_batches_of_any_size(task, encoder, monkeypatch, batch):
    monkeypatch.setattr(alignment, "PIECE_CHARS", batch)
    texts = ["under▁score", "", None, *[t for t in ODD if t is None or len(t) < 100], "a▁", "same", "same", None]
    *columns, shown = (c.to_pylist() for c in task(pa.array(texts)))
    assert len(shown) == len(texts)
    assert shown == [r[-1] for r in plain(encoder, texts)]
    for text, a, b, a_cuts, b_cuts in zip(texts, *columns, strict=True):
        assert (a, b) == plain_tokens(encoder, text)
        a_ends, b_ends = ends(encoder.a_bytes, a), ends(encoder.b_bytes, b)
        common = sorted(set(a_ends) & set(b_ends))
        assert (a_cuts, b_cuts) == ([a_ends.index(k) + 1 for k in common], [b_ends.index(k) + 1 for k in common])


def test_groups_cover_the_same_bytes(make, encoder):
    rows = alignment.align(make([t for t in ODD if t], strange=True), ["doc_id", "text", "id"]).collect()
    for r in rows:
        i = j = 0
        for p, q in zip(r.a_cuts, r.b_cuts):
            assert b"".join(encoder.a_bytes[x] for x in r.a_ids[i:p]) == b"".join(encoder.b_bytes[x] for x in r.b_ids[j:q])
            i, j = p, q
        assert (i, j) == (len(r.a_ids), len(r.b_ids))


def test_pair_table_is_bounded_by_the_vocabularies(spark, encoder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = alignment.pair_counts(alignment.align(docs, ["doc_id"]).select(alignment.links().alias("links")))
    rows = counts.collect()
    assert len(rows) <= encoder.most_pairs < 800_000
    for r in rows:
        a, b = encoder.a_bytes[r.a], encoder.b_bytes[r.b]
        assert a.endswith(b) or b.endswith(a)


def test_empty_table_and_clashing_names(make):
    assert alignment.align_documents(make([])).count() == 0
    from pyspark.sql import functions as F

    named = alignment.align(make(["a b"]).withColumn("a_ids", F.lit("mine")))
    assert named.columns[-5:] == ["_a_ids", "b_ids", "a_cuts", "b_cuts", "groups_sha256"]
    assert named.first()["a_ids"] == "mine"
