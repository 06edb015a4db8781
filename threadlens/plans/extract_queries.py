"""Queries that turn page parts into posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import markup, values
from threadlens.functions.urls import thread_from_url
from threadlens.operators import extract as ex
from threadlens.operators.frontier import dedup_last
from threadlens.plans.bridges import Tables
from threadlens.plans.registry import query
from threadlens.schema import STORE_DATE, THREAD

FORMAT = "'%Y-%m-%d %H:%M:%S'"


def chained(start: str, rules: list[tuple[str, str]]) -> str:
    sql = start
    for pattern, replacement in rules:
        pattern = pattern.replace("'", "''")
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    return sql


def html_sql(column: str, keep_links: bool = True) -> str:
    """RE2 has no back-references, so each dropped element has a rule of its own."""
    rules = [("(?s)<!--.*?(-->|\\z)", "")]
    rules += [(rf"(?is)<{tag}\b[^<>]*>.*?(</{tag}\s*>|\z)", "") for tag in ("head", "script", "style", "noscript")]
    if keep_links:
        rules += [(r"""(?is)<a\b[^<>]*?\bhref\s*=\s*["']([^"'<>]*)["'][^<>]*>(.*?)</a>""", r"[\2](\1)")]
    rules += [
        (r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|pre)\s*>", "\n"),
        ("(?i)</?(b|strong)>", "**"),
        ("(?i)</?(i|em)>", "_"),
        ("<[^<>]*>", ""),
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
        ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
        ("[ \t\r]*\n[ \t\r\n]*", "\n"),
        ("^[ \t\n]+", ""),
        ("[ \t\n]+$", ""),
    ]
    return chained(column, rules)


@query("q_ex_html_text", f"select page_id, {html_sql('html')} as text, {html_sql('html', False)} plain from pages")
def html_text(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.pages.select(
        "page_id", markup.html_text(html).alias("text"), markup.html_text(html, links=False).alias("plain")
    )


# The rules of the code markup.
CODE_SQL = [
    ('(?s)<td class="linenos">.*?</td>', ""),
    ('<ol class="linenums">(.*?)</ol>', r"```\1```"),
    ('<pre class="prettyprint inline prettyprinted".*?>(.*?)</pre>', r"`\1`"),
    ("<pre>", ""),
    ("</pre>", ""),
    (r"\[code\](.*?)\[/code\]", r"```\1```"),
    ('<td class="code">(.*?)</td>', r"```\1```"),
    ('<div class="codeblock inline_codeblock">(.*?)</div>', r"`\1`"),
]
ANSWER_SQL = [
    ('(?s)<div class="OriginallyAnsweredBanner">.*?</div>', ""),
    ('(?s)<div class="ContentFooter AnswerFooter" .*?</div>', ""),
    ('<a class="user".*?action_mousedown="UserLinkClickthrough".*?</a>', ""),
]


@query("q_ex_code_markup_q", f"select doc_id, {chained('html', CODE_SQL)} as text from code", "code")
def code_markup_q(t: Tables) -> DataFrame:
    return t.code().select("doc_id", markup.code_markup(F.col("html"), "question").alias("text"))


@query("q_ex_code_markup_a", f"select doc_id, {chained('html', ANSWER_SQL + CODE_SQL)} as text from code", "code")
def code_markup_a(t: Tables) -> DataFrame:
    return t.code().select("doc_id", markup.code_markup(F.col("html"), "answer").alias("text"))


SHORT = "<h1>(.*?)</h1>"
LONG = "(?s)<p>(.*?)</p>"


@query(
    "q_ex_first_nonempty",
    f"""select page_id, coalesce(nullif(regexp_extract(html, '{LONG}', 1), ''), nullif(regexp_extract(html, '{SHORT}', 1), ''), 'no text') as text
    from pages""",
)
def first_nonempty(t: Tables) -> DataFrame:
    """Of every page as it stands its first paragraph, its heading where that is empty, a fallback where both are."""
    long, short = F.regexp_extract("html", LONG, 1), F.regexp_extract("html", SHORT, 1)
    return t.pages.select("page_id", values.first_nonempty(long, short, fallback=F.lit("no text")).alias("text"))


COUNT_SQL = """select event_id, cast(floor(coalesce(try_cast(replace(
    regexp_extract(views_text, '([0-9][0-9,]*(\\.[0-9]+)?)k? Views', 1), ',', '') as double), 0)
    * case when views_text like '%k Views' then 1000 else 1 end) as bigint) views from counts"""


@query("q_ex_count_k", COUNT_SQL, "counts")
def count_k(t: Tables) -> DataFrame:
    return t.counts().select("event_id", values.parse_count(F.col("views_text"), "Views").alias("views"))


@query(
    "q_ex_count_comma",
    f"select c.event_id, k.views, replace(c.views_text, ' Views', '') views_raw from counts c join ({COUNT_SQL}) k on c.event_id = k.event_id",
    "counts",
)
def count_comma(t: Tables) -> DataFrame:
    text = F.col("views_text")
    return t.counts().select(
        "event_id", values.parse_count(text, "Views").alias("views"), values.strip_label(text).alias("views_raw")
    )


@query(
    "q_ex_answer_count",
    """select event_id, cast(case event_id % 3 when 0 then event_id % 40 when 1 then 1 else 0 end as int) answers from counts""",
    "counts",
)
def answer_count(t: Tables) -> DataFrame:
    return t.counts().select("event_id", values.parse_answer_count(F.col("answers_text")).alias("answers"))


@query("q_ex_date_prefix", f"select event_id, strftime(ts, {FORMAT}) date_text from events")
def date_prefix(t: Tables) -> DataFrame:
    return t.date_captions().select("event_id", values.clean_date(F.col("caption")).alias("date_text"))


@query(
    "q_ex_date_relative",
    f"""select event_id, strftime(case event_id % 8
       when 0 then anchor - to_seconds(n) when 1 then anchor - to_minutes(n) when 2 then anchor - to_hours(n)
       when 3 then anchor - to_days(n) when 4 then anchor - to_weeks(n) when 5 then anchor - to_months(n)
       when 6 then anchor - to_years(n) end, {FORMAT}) date_time
    from (select *, cast(event_id % 50 + 1 as int) n from ages)""",
    "ages",
)
def date_relative(t: Tables) -> DataFrame:
    when = values.resolve_age(F.col("age"), F.col("anchor"))
    return t.ages().select("event_id", F.date_format(when, STORE_DATE).alias("date_time"))


@query(
    "q_ex_date_month",
    f"""select event_id, strftime(try_strptime(list_extract(regexp_extract_all(header,
      '[A-Z][a-z][a-z] [0-9]+, [0-9]+ [0-9]+:[0-9]+ [AP]M'), -1), '%b %d, %Y %I:%M %p'), {FORMAT}) date_time from headers""",
    "headers",
)
def date_month(t: Tables) -> DataFrame:
    return t.headers().select(
        "event_id", F.date_format(values.month_date(F.col("header")), STORE_DATE).alias("date_time")
    )


@query(
    "q_ex_date_fallback",
    f"""select event_id, strftime(case when event_id % 5 < 3 then date_trunc('minute', ts) when event_id % 5 = 3 then ts end,
      {FORMAT}) date_time from events""",
)
def date_fallback(t: Tables) -> DataFrame:
    return t.headers().select(
        "event_id", F.date_format(values.header_date(F.col("header")), STORE_DATE).alias("date_time")
    )


@query("q_ex_default_author", "select uid, case when author = '' then 'anonymous' else author end author from posts", "posts")
def default_author(t: Tables) -> DataFrame:
    return t.posts().select("uid", values.default_author(F.col("author")).alias("author"))


@query("q_ex_tags_pack", "select doc_id, concat('<', lang, '> <', source, '> ') packed from documents")
def tags_pack(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", values.tags_pack(F.array("lang", "source")).alias("packed"))


@query("q_ex_tags_unpack", "select doc_id, unnest([lang, source]) tag from documents")
def tags_unpack(t: Tables) -> DataFrame:
    return t.tagged().select("doc_id", F.explode(values.tags_unpack(F.col("tags_packed"))).alias("tag"))


@query(
    "q_ex_topic_gate",
    """select doc_id, tags_packed from tagged where exists (select 1 from topics
      where regexp_matches(topic, '[02468]$') and position(concat('<', topic, '>') in tags_packed) > 0)""",
    "topics",
    "tagged",
)
def topic_gate(t: Tables) -> DataFrame:
    even = t.topics().filter(F.col("topic").rlike("[02468]$"))
    return ex.topic_gate(t.tagged(), even, "doc_id", values.tags_unpack(F.col("tags_packed")))


@query(
    "q_ex_date_lookup",
    """select p.uid, p.url, coalesce(f.date, 'not available') date from posts p
       left join (select url, arg_max(date, seq) date from frontier group by url) f on p.url = f.url""",
    "posts",
    "frontier",
)
def date_lookup(t: Tables) -> DataFrame:
    last = dedup_last(t.frontier(), "url", "seq")
    return ex.attach_date(t.posts().select("uid", "url"), last)


@query(
    "q_ex_uid_question",
    "select url, row_number() over (order by url) question_id from posts where type = 'question'",
    "posts",
)
def uid_question(t: Tables) -> DataFrame:
    questions = t.posts().filter(F.col("type") == "question").select("url")
    return ex.assign_uid(questions, ["url"], "question_id")


@query("q_ex_uid_from_url", "select page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) thread_id from pages")
def uid_from_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", thread_from_url(F.col("url")).alias("thread_id"))


NUMBERED_SQL = """select uid, cast(row_number() over (partition by thread_id
   order by case when l_linenumber = 2 then 0 else 1 end, l_linenumber, l_partkey, l_suppkey) as int) ordinal from lines"""


@query("q_ex_uid_answer", NUMBERED_SQL, "lines")
def uid_answer(t: Tables) -> DataFrame:
    """The second line is the best answer; a line number is a page, part and supplier the place on it."""
    answers = t.lines().withColumn("is_best", F.col("l_linenumber") == 2)
    order = ("l_linenumber", "l_partkey", "l_suppkey")
    return ex.number_answers(answers, THREAD, "is_best", order, t.large_threads).select("uid", "ordinal")


@query(
    "q_ex_solution_mark",
    """select l.uid, case when s.thread_id is not null then 'solution' else '---' end resolve from lines l
       left join (select * from lines where status <> 'Not Answered.'
         qualify row_number() over (partition by thread_id order by l_linenumber, l_partkey, l_suppkey) = 1) s
       on l.thread_id = s.thread_id and l.author = s.author and l.date_time = s.date_time""",
    "lines",
)
def solution_mark(t: Tables) -> DataFrame:
    lines = t.answer_lines()
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    first = lines.groupBy(*THREAD).agg(
        F.min_by("author", place).alias("solution_user"), F.min_by("date_time", place).alias("solution_date")
    )
    threads = first.join(t.order_threads(), list(THREAD))
    answers = lines.select(*THREAD, "uid", "author", "date_time")
    return ex.mark_solution(answers, threads, ).select("uid", "resolve")


@query(
    "q_ex_question_status",
    """select cast(o_orderkey as varchar) thread_id, case when max(case when resolve = 'solution' then 1 else 0 end) = 1
      then 'True' else 'False' end resolve from orders left join lines on thread_id = cast(o_orderkey as varchar) group by o_orderkey""",
    "lines",
)
def question_status(t: Tables) -> DataFrame:
    answers = t.lines().select("thread_id", (F.col("resolve") == "solution").alias("is_best"))
    return ex.question_status(answers, t.order_threads(), ("thread_id",))


@query(
    "q_ex_text_offset",
    """select page_id, i, list_extract(blocks, cast(i + 1 + case when answered and i > 0 then 1 else 0 end as int)) block
    from (select page_id, page_id % 3 = 0 answered, regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1) blocks from pages)
    cross join lateral (select unnest(range(len(blocks))) i)""",
)
def text_offset(t: Tables) -> DataFrame:
    """Content of each post of each page, one post per block."""
    blocks = t.pages.select(
        "page_id", (F.col("page_id") % 3 == 0).alias("answered"), markup.html_blocks(F.col("html"), "p").alias("blocks")
    )
    posts = blocks.select("*", F.posexplode("blocks").alias("i", "own"))
    return posts.select(
        "page_id", F.col("i").cast("long").alias("i"),
        values.pick_block(F.col("blocks"), F.col("i"), F.col("answered")).alias("block"),
    )


PAGE_POSTS_SQL = f"""
parts as (select page_id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) thread_id, url,
    regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1) blocks,
    regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1) h1 from pages),
cut as (select page_id, thread_id, url, h1, blocks, unnest(range(len(blocks))) i from parts),
page_posts as (
  select case when i = 0 then page_id::varchar else concat(page_id, '.', i) end uid,
    case when i = 0 then 'question' else 'answer' end type, 'anonymous' author,
    case when i = 0 then {html_sql('h1')} else '' end title, {html_sql('list_extract(blocks, cast(i + 1 as int))')} as text,
    cast(case when i = 0 then len(blocks) - 1 else 0 end as int) answers, url, page_id::varchar thread_id, cast(i as int) ordinal
  from cut)"""


@query("q_ex_post_union", "select * from page_posts", extra=PAGE_POSTS_SQL)
def post_union(t: Tables) -> DataFrame:
    """Pages to posts: the first paragraph is the question, the others are its answers in page order."""
    parts = t.pages.select(
        F.col("page_id").cast("string").alias("thread_id"),
        "url",
        F.get(markup.html_blocks(F.col("html"), "h1"), F.lit(0)).alias("h1"),
        markup.html_blocks(F.col("html"), "p").alias("blocks"),
    )
    blocks = parts.select("*", F.posexplode("blocks").alias("ordinal", "block"))
    shared = [values.default_author(F.lit(None).cast("string")).alias("author"), F.lit("page").alias("site"), "url",
              "thread_id", "ordinal", markup.html_text(F.col("block")).alias("text")]
    questions = blocks.filter(F.col("ordinal") == 0).select(
        *shared,
        F.col("thread_id").alias("uid"),
        F.lit("question").alias("type"),
        markup.html_text(F.coalesce("h1", F.lit(""))).alias("title"),
        (F.size("blocks") - 1).alias("answers"),
    )
    answers = blocks.filter(F.col("ordinal") > 0).select(
        *shared,
        F.concat_ws(".", "thread_id", "ordinal").alias("uid"),
        F.lit("answer").alias("type"),
        F.lit("").alias("title"),
        F.lit(0).alias("answers"),
    )
    return ex.to_posts(questions, answers).select(
        "uid", "type", "author", "title", "text", "answers", "url", "thread_id", "ordinal"
    )
