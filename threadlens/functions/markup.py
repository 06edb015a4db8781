"""HTML and code-markup rewriting as ordered pattern lists over a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-markup rewrites. (?d) makes "." stop at \n only. How they run in linear time: ``rewrite_marks``.
LINE_NUMBERS = (r'(?s)<td class="linenos">.*?</td>', "")
CODE_RULES = (
    (r'(?d)<ol class="linenums">(.*?)</ol>', "```$1```"),
    (r'(?d)<pre class="prettyprint inline prettyprinted".*?>(.*?)</pre>', "`$1`"),
    (r"</?pre>", ""),
    (r"(?d)\[code\](.*?)\[/code\]", "```$1```"),
    (r'(?d)<td class="code">(.*?)</td>', "```$1```"),
    (r'(?d)<div class="codeblock inline_codeblock">(.*?)</div>', "`$1`"),
)
BANNER = (r'(?s)<div class="OriginallyAnsweredBanner">.*?</div>', "")
FOOTER = (r'(?s)<div class="ContentFooter AnswerFooter" .*?</div>', "")
USER_LINK = (r'(?d)<a class="user".*?action_mousedown="UserLinkClickthrough".*?</a>', "")

QUESTION_RULES = (LINE_NUMBERS, *CODE_RULES)
ANSWER_RULES = (BANNER, LINE_NUMBERS, FOOTER, USER_LINK, *CODE_RULES)

# Time is linear in the text: what is not closed runs to the end (as browsers have it), a tag ends before the
# next "<", and a link's text before the next link.
DROP_RULES = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<(script|style|head|noscript)\b[^<>]*+>.*?(?:</\1\s*+>|\z)", ""),
)
KEEP_LINK = (r"""(?is)<a\b[^<>]*?\bhref\s*+=\s*+["']([^"'<>]*+)["'][^<>]*+>((?:(?!<a\b|</a>).)*+)</a>""", "[$2]($1)")
SHAPE_RULES = (
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(?:p|div|li|tr|h[1-6]|pre)\s*>", "\n"),
    (r"(?i)</?(?:b|strong)>", "**"),
    (r"(?i)</?(?:i|em)>", "_"),
    (r"<[^<>]*+>", ""),
)
# Character entities; the ampersand last, so that nothing is decoded twice.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
)
SQUEEZE_RULES = ((r"(?<![ \t\r])[ \t\r]*+\n[ \t\r\n]*+", "\n"),)


def rewrite(c: Column, rules) -> Column:
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


# A rule of marks: flags, open mark, a mark on the way if any, the text up to the end mark, end mark.
MARKS = re.compile(r"(\(\?\w\))(.+?)(?:\.\*\?([^.*?()]+))?(\(?\.\*\?\)?)([^.*?()]+)")


def _replacing(pattern: str, replacement: str):
    return lambda c: F.regexp_replace(c, pattern, replacement)


def rewrite_marks(c: Column, rules) -> Column:
    """``rewrite`` for rules of an open mark, a lazy middle and an end mark, in linear time whatever is not closed.

    Where the first open mark has no end mark, a later one in its reach has none either. So each rule gets a second
    way, the open mark and all in its reach, which is taken once and left as it is; no open mark is tried twice.
    Rules without a lazy middle are plain ones.
    """
    for pattern, replacement in rules:
        parts = MARKS.fullmatch(pattern)
        if parts is None:
            c = F.regexp_replace(c, pattern, replacement)
            continue
        flags, opening, on_the_way, text, end = parts.groups()
        # whatever follows a later mark on the way follows the first one too, so the first is final
        begin = opening + (f"(?>.*?{on_the_way})" if on_the_way else "")
        if replacement == "":
            c = F.regexp_replace(c, f"{flags}{begin}{text}{end}|({opening}.*)", "$1")
            continue
        first = opening.lstrip("\\")[0]
        cut = rf"{flags}{begin}{text}{end}|{opening}.*|[^\{first}]++|\{first}"
        whole = rf"{flags}\A{begin}(.*){end}\z"
        pieces = F.regexp_extract_all(c, F.lit(cut), F.lit(0))
        c = F.array_join(F.transform(pieces, _replacing(whole, replacement)), "")
    return c


def code_markup(html: Column, kind: str = "question") -> Column:
    return rewrite_marks(html, ANSWER_RULES if kind == "answer" else QUESTION_RULES)


def html_text(html: Column, links: bool = True) -> Column:
    """Readable text of an HTML fragment in light Markdown; ``links=False`` keeps only the link texts."""
    c = rewrite(html, DROP_RULES)
    if links:
        c = rewrite(c, (KEEP_LINK,))
    c = rewrite(c, SHAPE_RULES)
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(rewrite(c, SQUEEZE_RULES), F.lit(" \t\n"))


def html_blocks(html: Column, tag: str) -> Column:
    """Inner HTML of each ``<tag>…</tag>`` of a page, in page order. What follows the last end mark holds no
    block and is cut off first, so that every search for an end mark succeeds and time is linear."""
    closed = F.regexp_extract(html, rf"(?is)^(.*</{tag}\s*+>)", 1)
    return F.regexp_extract_all(closed, F.lit(rf"(?is)<{tag}\b[^<>]*+>(.*?)</{tag}\s*+>"), F.lit(1))
