"""Markup: linear ways against plain ones, worst cases of one megabyte."""

import random
import time

import pytest
from pyspark.sql import functions as F

from threadlens.functions import markup
from threadlens.functions.markdown import html_markdown

PIECES = (
    "a", " ", "\n", "<", ">", "[", "<b>", '<td class="linenos">', '<td class="code">', "</td>", '<ol class="linenums">', "</ol>",
    '<pre class="prettyprint inline prettyprinted"', "<pre>", "</pre>", "[code]", "[/code]", '<div class="OriginallyAnsweredBanner">',
    '<div class="ContentFooter AnswerFooter" ', '<div class="codeblock inline_codeblock">', "</div>", '<a class="user"',
    'action_mousedown="UserLinkClickthrough"', "</a>", "$1", "\\",
)


@pytest.mark.parametrize("rules", [markup.QUESTION_RULES, markup.ANSWER_RULES], ids=["question", "answer"])
def test_marks_are_matched_as_by_the_plain_patterns(spark, rules):
    rng = random.Random(7)
    texts = ["".join(rng.choices(rng.sample(PIECES, 6), k=rng.randrange(1, 25))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    both = df.select("t", markup.rewrite(F.col("t"), rules).alias("plain"), markup.rewrite_marks(F.col("t"), rules).alias("got"))
    assert both.where("plain <> t").count() > 500
    assert both.where("not plain <=> got").collect() == []


@pytest.mark.parametrize("piece", [p for p in PIECES if len(p) > 4] + ['<pre class="prettyprint inline prettyprinted">', "[code]>", '<a class="user"action_mousedown="UserLinkClickthrough"'])
def test_unclosed_marks_take_linear_time(spark, piece):
    df = spark.createDataFrame([(piece * (1_000_000 // len(piece)),)], "t string").select(
        F.length(markup.code_markup(F.col("t"), "question")), F.length(markup.code_markup(F.col("t"), "answer"))
    )
    start = time.perf_counter()
    df.collect()
    assert time.perf_counter() - start < 5


def markdown(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    return [r.m for r in df.select("i", html_markdown(F.col("t")).alias("m")).orderBy("i").collect()]


def test_markdown_keeps_the_structure(spark):
    cases = {
        "<h2>Head &amp; tail</h2>text": "## Head & tail\ntext",
        '<ol start="3"><li>one<li><p>two <b>bold</b></p><ul><li>in</li></ul></li><li>x</ol>': "3. one\n4. two **bold**\n  * in\n5. x",
        "it&#8217;s &#x41; &unknown; &amp;#65; &#55296;": "it’s A &unknown; &#65; &#55296;",
        '<img src="a.png" width="3" alt="p"><img src=\'b.png\'><img>': '<img src="a.png" width="3" alt="p" />![](b.png)',
        "<table><tr><th>a<th>b</tr><tr><td>1</td><td>2 </td></tr></table>": "a | b\n---|---\n1 | 2",
        "<blockquote><p>q<p>r<blockquote>s</blockquote></blockquote>t": "> q\n> r\n> > s\nt",
        "a<hr>b<pre>x\n  y</pre>": "a\n* * *\nb\nx\n  y",
        '<a href="u?a&amp;b">l <i>k</i></a> <a>n</a> <a href="v">open': "[l _k_](<u?a&b>) n [open](<v>)",
        '<a href="u">one<a href="v">two</a></a>': "[one](<u>)[two](<v>)",
        "</ul></blockquote></pre></a><li>x": "* x",
        "a < b<p></p><p> </p><br>c <!-- no --><script>no</script>": "a < b\nc",
        "": "",
    }
    assert markdown(spark, *cases, None) == [*cases.values(), None]


def test_blocks_of_tokens_change_nothing(spark):
    """Texts of 1 to 60 items: the fold is cut at other places in each."""
    pages = ["<ol>" + "".join(f"<li>i{k} <b>x</b>" for k in range(n)) + "</ol>" for n in range(1, 60)]
    assert markdown(spark, *pages) == ["\n".join(f"{k + 1}. i{k} **x**" for k in range(n)) for n in range(1, 60)]


@pytest.mark.parametrize("piece", ["<ol><li>x", "<blockquote>", '<a href="b">', "&#65;"])
def test_markdown_takes_linear_time(spark, piece):
    def seconds(size):
        start = time.perf_counter()
        markdown(spark, piece * (size // len(piece)))
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(80_000) < 8 * max(seconds(20_000), 0.5)
