import math
import random
import zlib

import numpy as np

from threadlens.llm import language_id as g


def pieces(text, sample):
    """Cross-parsing by search: longest pieces of ``text`` that occur in ``sample``, else one character."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def words(rnd, syllables, n):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


SYLLABLES = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ei", "ung", "er"], "cc": ["ção", "ré", "ou", "eau"]}


def corpus(rnd, n):
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        out.append((i, words(rnd, SYLLABLES[lang], rnd.randrange(5, 60)), lang))
    return out


def test_pieces_are_the_longest_that_occur():
    rnd = random.Random(1)
    sample = [words(rnd, SYLLABLES[x], 40) for x in SYLLABLES]
    for lang in sample:
        parser = g.Parser([lang])
        texts = [words(rnd, SYLLABLES[x], k) for x in SYLLABLES for k in (1, 7, 90)] + ["ŋŋ ka ŋ", "k", "zzz"]
        for text in texts:
            block = g.letters(text.encode())
            columns = block[:, None]
            assert int(parser.count(columns, [1] * len(block))[0]) == pieces(g.letters_only(text), lang)


def test_blocks_of_many_texts_at_once():
    rnd = random.Random(2)
    model = {lang: g.Parser([words(rnd, SYLLABLES[lang], 200)]) for lang in SYLLABLES}
    texts = [words(rnd, SYLLABLES[rnd.choice(sorted(SYLLABLES))], k) for k in (0, 1, 5, 900, 40, 2000)]
    found, scores = g.judge([g.letters(t.encode()) for t in texts], model)
    for text, lang, score in zip(texts, found, scores, strict=True):
        alone, own = g.judge([g.letters(text.encode())], model)
        assert (lang, score) == (alone[0], own[0]) and 0 <= score <= 1
    assert found[0] == "und"


def test_letters():
    text = "  Ä1b,, C\tß42 "
    assert "".join(map(chr, g.letters(text.encode()))) == g.letters_only(text) == "ä b c ß"
    assert g.letters(b"12 !") is None and g.letters(None) is None and g.letters(b"") is None
    assert g.letters(b"\xff\xfe a") is not None


def test_held_out_accuracy(make):
    rows = corpus(random.Random(3), 600)
    df = make(rows, strange=True)
    got = {r.doc_id: r for r in g.identify(df, g.learn(df), ["doc_id"]).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97


def test_held_out_documents_are_not_learned(make):
    rows = [(i, f"text of {i}", "aa") for i in range(40)]
    learned = g.learn(make(rows))["aa"]
    assert sorted(learned) == sorted(t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5)


def test_the_sample_is_bounded(make):
    df = make([(i, "x" * 5000, "aa") for i in range(200)])
    sample = g.learn(df)["aa"]
    assert len(sample) == g.SAMPLE_ROWS and max(map(len, sample)) == g.SAMPLE_CHARS


def test_edges(make):
    rows = [(1, "ka lo mi", "aa"), (2, None, "aa"), (3, "", None), (4, "12 34", "bb"), (5, "漢字", None), (None, "lo", None), (6, "ka lo", "aa")]
    df = make(rows, strange=True)
    got = {r.doc_id: (r.lang_pred, r.score) for r in g.identify(df, g.learn(df), ["doc_id"]).collect()}
    assert {got[i] for i in (2, 3, 4)} == {("und", 0.0)}
    assert {got[i][0] for i in (1, 5, 6, None)} == {"aa"}
    nothing = make([(1, "ka", None)])
    assert g.identify(nothing, g.learn(nothing), ["doc_id"]).collect()[0].lang_pred == "und"
    assert g.identify(make([]), {}, ["doc_id"]).count() == 0
    two = {"aa": ["abc"], "bb": ["abc"]}
    assert g.identify(make(["abc"]), two, ["doc_id"]).collect()[0][1:] == ("aa", 0.0)


def test_whole_text_counts(make):
    """The language of the end decides if most of the text is there."""
    rnd = random.Random(5)
    model = {lang: [words(rnd, SYLLABLES[lang], 300)] for lang in SYLLABLES}
    text = words(rnd, SYLLABLES["aa"], 300) + " " + words(rnd, SYLLABLES["bb"], 6000)
    assert g.identify(make([text]), model, ["doc_id"]).collect()[0].lang_pred == "bb"


def test_normalised_by_the_sample():
    assert math.isclose(g.Parser(["ab ab"]).bits, math.log2(7))


def test_a_tiny_sample_does_not_win(make):
    """Beside languages with much text, one of two letters, one alphabet, and one without a letter in its sample."""
    rnd = random.Random(7)
    rows = [(i, t, lang) for i, t, lang in corpus(rnd, 300)]
    learned = g.learn(make(rows))
    model = learned | {"tiny": ["ok"], "abc": ["abcdefghijklmnopqrstuvwxyz"], "none": ["12 34"], "void": []}
    got = [r.lang_pred for r in g.identify(make(rows), model, ["doc_id", "lang"]).orderBy("doc_id").collect()]
    assert np.mean([a == lang for a, (_, _, lang) in zip(got, rows, strict=True)]) > 0.99
    assert [r.lang_pred for r in g.identify(make(["ok", "sch"]), model, ["doc_id"]).orderBy("doc_id").collect()] == ["tiny", "bb"]


def test_a_small_sample_is_still_found(make):
    rnd = random.Random(8)
    model = {"aa": [words(rnd, SYLLABLES["aa"], 4000)], "bb": [words(rnd, SYLLABLES["bb"], 4000)], "cc": [words(rnd, SYLLABLES["cc"], 40)]}
    rows = corpus(rnd, 200)
    got = [r.lang_pred for r in g.identify(make(rows), model, ["doc_id"]).orderBy("doc_id").collect()]
    assert np.mean([a == lang for a, (_, _, lang) in zip(got, rows, strict=True)]) > 0.97


def test_samples_are_taken_from_the_letters_of_the_whole_text(make):
    prose = " ".join(f"wort{'abcdefghij'[i % 10]}" for i in range(3000))
    sample = g.learn(make([(i, "1234567. " * 200 + prose, "aa") for i in range(1, 60)]))["aa"]
    assert all(len(g.letters_only(s)) > g.SAMPLE_CHARS - 3 for s in sample)
    assert len(set(sample)) > 10
