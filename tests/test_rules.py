"""Rules on hand-written rows and against independent loops."""

import math
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadlens.functions import markup, text, urls, values
from threadlens.functions.stemming import porter
from threadlens.operators.corpus import lexicon, log_likelihood, scored_posts, token_counts


def column(spark, rows, expression, dtype="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {dtype}")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_counts(spark):
    captions = ["1.2k Views", "2.3k Views", "25 Views", "1,234 Views", "", "Asked by kim", None]
    assert column(spark, captions, lambda c: values.parse_count(c, "Views")) == [1200, 2300, 25, 1234, 0, 0, 0]
    assert column(spark, ["2.3k", "12", ""], values.parse_count) == [2300, 12, 0]
    assert column(spark, ["12 answers", "1 answer", "", None], values.parse_answer_count) == [12, 1, 0, 0]


def test_ages(spark):
    anchor = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = column(spark, ["3 years ago", "1 month ago", "90 seconds ago", "not available"], lambda c: values.resolve_age(c, anchor))
    assert got == [datetime(2021, 1, 1), datetime(2023, 12, 1), datetime(2023, 12, 31, 23, 58, 30), None]
    assert column(spark, ["Computing - 3 days ago", "3 days", "x 1 hour ago "], values.age_text) == ["3 days ago", None, None]


def test_header_dates(spark):
    headers = ["x Feb 3, 2016 4:05 PM y", "Jan 1, 2001 1:00 AM Feb 3, 2016 12:05 AM", "joe\n2016-02-03 04:05:06", "no date"]
    assert column(spark, headers, values.header_date) == [
        datetime(2016, 2, 3, 16, 5), datetime(2016, 2, 3, 0, 5), datetime(2016, 2, 3, 4, 5, 6), None,
    ]


def test_authors_and_tags(spark):
    assert column(spark, ["kim", "", "  ", None], values.default_author) == ["kim", "anonymous", "anonymous", "anonymous"]
    assert column(spark, [["a b", "c"], []], values.tags_pack, "array<string>") == ["<a b> <c> ", ""]
    assert column(spark, ["<a b> <c> ", ""], values.tags_unpack) == [["a b", "c"], []]


def test_blocks(spark):
    blocks = F.array(*[F.lit(x) for x in "abc"])
    row = spark.range(1).select(
        values.pick_block(blocks, F.lit(0), F.lit(True)).alias("q"),
        values.pick_block(blocks, F.lit(1), F.lit(True)).alias("shifted"),
        values.pick_block(blocks, F.lit(1), F.lit(False)).alias("plain"),
        values.pick_block(blocks, F.lit(2), F.lit(True)).alias("beyond"),
    ).first()
    assert tuple(row) == ("a", "c", "b", None)


@pytest.mark.parametrize(
    "href,expected",
    [
        ("/q", "https://h.org/q"), ("q", "https://h.org/a/q"), ("../q", "https://h.org/q"), ("./q?x#y", "https://h.org/a/q?x#y"),
        ("//o.org/q", "https://o.org/q"), ("http://o.org", "http://o.org"), ("?z", "https://h.org/a/b?z"),
        ("#z", "https://h.org/a/b?k=v#z"), ("", "https://h.org/a/b?k=v"), ("../../../q", "https://h.org/q"), ("..", "https://h.org/"),
    ],
)
def test_resolve_url(spark, href, expected):
    base = F.lit("https://h.org/a/b?k=v#f")
    assert spark.range(1).select(urls.resolve_url(base, F.lit(href))).first()[0] == expected


def test_html_text(spark):
    html = (
        "<head><title>t</title></head><!-- c --><p>A &amp;lt; <b>b</b><br>c</p><script>x()</script>"
        "<ul><li><a href='/u'>link</a></li></ul><i>e</i> &copy;"
    )
    assert column(spark, [html], markup.html_text) == ["A &lt; **b**\nc\n[link](/u)\n_e_ ©"]
    assert column(spark, [html], lambda c: markup.html_text(c, links=False)) == ["A &lt; **b**\nc\nlink\n_e_ ©"]


def test_unclosed_markup_runs_to_the_end(spark):
    assert column(spark, ["a<!-- b"], markup.html_text) == ["a"]
    assert column(spark, ["a<script>b"], markup.html_text) == ["a"]
    assert column(spark, ["1 < 2 <b>x</b>"], markup.html_text) == ["1 < 2 **x**"]


@pytest.mark.parametrize(
    "piece", ["x", "e", " ", "\n ", "<!--", "<", "<a href='u'>", "<script>", "<script", "<p>", "</", "a </script ", "es ", "<a "]
)
def test_patterns_take_linear_time(spark, piece):
    """One megabyte of anything that used to make a pattern start over at each character."""
    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)),)], "t string").select(
        text.syllables(F.col("t")), F.length(markup.html_text(F.col("t"))), F.size(markup.html_blocks(F.col("t"), "p"))
    )
    began = time.time()
    df.collect()
    assert time.time() - began < 6


def test_markers(spark):
    texts = ["Foo.JAVA", "{", "a def b", "define", "see http://x", "https//x", None]
    assert column(spark, texts, text.has_code) == [True, True, True, False, False, False, False]
    assert column(spark, texts, text.has_links) == [False, False, False, False, True, False, False]


def slow_syllables(body):
    total = 0
    for word in body.split():
        count, vowel = 0, False
        for letter in word:
            if letter in "aeiouy":
                count += not vowel
                vowel = True
            else:
                vowel = False
        if len(word) > 2 and word.endswith("es"):
            count -= 1
        elif len(word) > 1 and word.endswith("e"):
            count -= 1
        total += count
    return total


def test_syllables(spark, tables):
    words = ["the", "es", "ee", "cakes", "rhythm", "A", "idea.", ""]
    assert column(spark, words, text.syllables) == [0, 1, 0, 1, 1, 0, 2, 0]
    texts = [r.text for r in tables.documents.select("text").collect()]
    assert column(spark, texts, text.syllables) == [slow_syllables(t) for t in texts]


def test_text_measures(spark, tables):
    texts = [r.text for r in tables.documents.select("text").collect()] + ["", "  ", "One. Two!  Three", "a.b? c ", "...  x."]
    sentences = [[s for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()] for t in texts]
    assert column(spark, texts, text.length) == [len(t) for t in texts]
    assert column(spark, texts, text.word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, text.sentence_count) == [len(s) for s in sentences]
    assert column(spark, texts, text.longest_sentence) == [max((len(x.split()) for x in s), default=0) for s in sentences]


def test_ratio(spark):
    df = spark.createDataFrame([(1, 8), (5, 0), (7, 3), (1, 200)], "a long, b long")
    got = [r[0] for r in df.select(text.ratio2(F.col("a"), F.col("b"))).collect()]
    assert got == [0.13, 0.0, 2.33, 0.01]


# --- stemming: a plain restatement, letter by letter ---

IRREGULAR = dict(
    sky="sky", skies="sky", dying="die", lying="lie", tying="tie", news="news", inning="inning", innings="inning",
    outing="outing", outings="outing", canning="canning", cannings="canning", howe="howe", proceed="proceed",
    exceed="exceed", succeed="succeed",
)


def shape(word):
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word):
    return len(re.findall("v+c", shape(word)))


def closed(word):
    s = shape(word)
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and s == "vc")


def pick(word, rules):
    for suffix, new, test in rules:
        if word.endswith(suffix):
            head = word[: len(word) - len(suffix)]
            return head + new if test(head) else word
    return word


def slow_porter(word):
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    m0, m1, always = (lambda h: measure(h) > 0), (lambda h: measure(h) > 1), (lambda h: True)
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    else:
        word = pick(word, [("sses", "ss", always), ("ies", "i", always), ("ss", "ss", always), ("s", "", always)])
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = pick(word, [("eed", "ee", m0)])
    else:
        for suffix in ("ed", "ing"):
            head = word[: len(word) - len(suffix)]
            if word.endswith(suffix) and "v" in shape(head):
                word = head
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c":
                    word = word if word[-1] in "lsz" else word[:-1]
                elif measure(word) == 1 and closed(word):
                    word += "e"
                break
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and measure(word[:-4]) > 0:
        word = word[:-2]
    second = (
        "ational ate tional tion enci ence anci ance izer ize bli ble alli al entli ent eli e ousli ous ization ize "
        "ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble fulli ful"
    ).split()
    rules = [(a, b, m0) for a, b in zip(second[::2], second[1::2])]
    word = pick(word, rules + [("logi", "log", lambda h: measure(h + "l") > 0)])
    word = pick(word, [("icate", "ic", m0), ("ative", "", m0), ("alize", "al", m0), ("iciti", "ic", m0), ("ical", "ic", m0), ("ful", "", m0), ("ness", "", m0)])
    fourth = "al ance ence er ic able ible ant ement ment ent".split()
    rules = [(s, "", m1) for s in fourth] + [("ion", "", lambda h: measure(h) > 1 and h[-1] in "st")]
    word = pick(word, rules + [(s, "", m1) for s in "ou ism ate iti ous ive ize".split()])
    if word.endswith("e"):
        head = word[:-1]
        if measure(head) > 1 or (measure(head) == 1 and not closed(head)):
            word = head
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


PAIRS = dict(
    caresses="caress", ponies="poni", ties="tie", caress="caress", cats="cat", feed="feed", agreed="agre", plastered="plaster",
    bled="bled", motoring="motor", sing="sing", conflated="conflat", troubled="troubl", sized="size", hopping="hop",
    tanned="tan", falling="fall", hissing="hiss", fizzed="fizz", failing="fail", filing="file", happy="happi", sky="sky",
    relational="relat", conditional="condit", valenci="valenc", digitizer="digit", radicalli="radic", vietnamization="vietnam",
    operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope", callousness="callous", formaliti="formal",
    sensitiviti="sensit", sensibiliti="sensibl", triplicate="triplic", formative="form", formalize="formal", electrical="electr",
    goodness="good", revival="reviv", allowance="allow", inference="infer", airliner="airlin", adjustable="adjust",
    defensible="defens", irritant="irrit", replacement="replac", adjustment="adjust", dependent="depend", adoption="adopt",
    communism="commun", activate="activ", homologous="homolog", effective="effect", bowdlerize="bowdler", probate="probat",
    rate="rate", cease="ceas", controll="control", roll="roll", died="die", dying="die", news="news", enjoy="enjoy",
)


def test_stems(spark, tables):
    words = list(PAIRS) + ["y", "yes", "yyyed", "ayying", "syzygy", "a", "is", "ed", "sing", "11ed", "élevées", "yay", "say", "theology", "archaeologi"]
    words += [r.token for r in token_counts(tables.documents).select("token").collect()]
    words = sorted(set(words))
    df = porter(spark.createDataFrame([(w,) for w in words], "token string"))
    got = {r.token: r.stem for r in df.collect()}
    assert {w: got[w] for w in PAIRS} == PAIRS
    assert got == {w: slow_porter(w) for w in words}


# --- log-likelihood: the loop over tokens and words ---


def slow_scores(texts):
    tokens = {k: re.findall(r"\w+|[^\w\s]", t.lower()) for k, t in texts.items()}
    counts = {}
    for ts in tokens.values():
        for w in ts:
            counts[slow_porter(w)] = counts.get(slow_porter(w), 0) + 1
    out = {}
    for k, t in texts.items():
        words = t.lower().split()
        total = 0.0
        for w in tokens[k]:
            f = counts[slow_porter(w)]
            total += words.count(w) * (math.log(f) if f > 1 else 0.0)
        out[k] = total / len(counts)
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_log_likelihood(spark, tables, broadcast):
    """The join with the lexicon, broadcast or shuffled, agrees with the loop, and so do its rows."""
    posts = tables.store.select("uid", "text").filter(F.length("text") < 1500)
    texts = {r.uid: r.text for r in posts.collect()}
    texts["blank"] = ""
    texts["apart"] = "(cat) (dog)"
    posts = spark.createDataFrame(list(texts.items()), "uid string, text string")
    lex = lexicon(posts)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = {r.uid: r.loglikelihood for r in log_likelihood(posts, lex, ("uid",)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    expected = slow_scores(texts)
    assert "blank" not in found and "apart" not in found
    for uid, score in expected.items():
        assert abs(found.get(uid, 0.0) - score) <= 0.00501
    assert {r.uid for r in scored_posts(posts, lex).collect()} == set(texts)


def test_first_nonempty_falls_back_in_order(spark):
    from pyspark.sql import functions as F

    from threadlens.functions import values

    rows = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("", ""), (None, None)], "long string, short string")
    shown = rows.select(values.first_nonempty(F.col("long"), F.col("short"), fallback=F.lit("no text")).alias("t")).collect()
    assert [r.t for r in shown] == ["a", "b", "b", "no text", "no text"]
