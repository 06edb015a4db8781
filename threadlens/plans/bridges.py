"""Community data seen in the given tables: conversations as threads, order lines as answers with votes,
events as sightings and captions, pages as a link graph. Each bridge has its SQL twin for the oracle."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators.skew import HotKeys, attach_group, heavy_keys, number_rows
from threadlens.schema import POST, THREAD
from threadlens.session import spread, stage

FORUM_URL = "https://forum.example.org/question/"
UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _age() -> Column:
    unit = F.get(F.array(*[F.lit(u) for u in UNITS]), (F.col("event_id") % 8).cast("int"))
    plural = F.when(F.col("event_id") % 50 == 0, "").otherwise("s")
    age = F.concat(_text(F.col("event_id") % 50 + 1), F.lit(" "), unit, plural, F.lit(" ago"))
    return F.when(F.col("event_id") % 8 == 7, "not available").otherwise(age)


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @cached_property
    def pages(self) -> DataFrame:
        return spread(self.table("pages"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @staticmethod
    def _conversations(talk: DataFrame, hot: HotKeys) -> DataFrame:
        """All turns, numbered, with their number: one exchange."""
        numbered = number_rows(talk, ["conv_id"], ["turn", "role"], "number", hot)
        return attach_group(numbered, ["conv_id"], {"posts": F.count("*")}, hot)

    def posts(self) -> DataFrame:
        """A conversation is a thread: its first turn is the question, all later turns are the answers."""
        talk = self.table("conversations").select("conv_id", "turn", "role", "text")
        hot = heavy_keys(talk, ["conv_id"])
        numbered = reduce(DataFrame.unionByName, [self._conversations(part, keys) for part, keys in hot.parts(talk)])
        users = self.events.groupBy("user_id").agg(
            F.count_if(F.col("event_type") == "view").alias("views"),
            F.count_if(F.col("event_type") == "click").alias("upvotes"),
            F.min("ts").cast("timestamp").alias("date_time"),
        )
        span = self.events.agg(F.max("user_id") + 1).scalar()
        rows = numbered.select(
            "*",
            (F.col("number") - 1).alias("ordinal"),
            ((F.col("conv_id") * 31 + F.col("turn") * 17) % span).alias("user_id"),
        )
        rows = rows.join(users, "user_id", "left")
        thread, q = _text("conv_id"), F.col("ordinal") == 0
        solved = F.col("conv_id") % 3 != 0
        return rows.select(
            F.lit("a").alias("site"),
            F.when(q, thread).otherwise(F.concat(thread, F.lit("."), _text("ordinal"))).alias("uid"),
            F.when(q, "question").otherwise("answer").alias("type"),
            F.when(F.col("user_id") % 10 == 0, "").otherwise(F.concat("role", _text("user_id"))).alias("author"),
            F.when(q, F.concat(F.lit("Thread "), thread)).otherwise("").alias("title"),
            "text",
            "date_time",
            F.when(
                q & (F.col("conv_id") % 4 != 0),
                F.array(F.concat(F.lit("topic"), _text(F.col("conv_id") % 5)), F.lit("forum")),
            ).alias("tags"),
            F.coalesce("views", F.lit(0)).cast("long").alias("views"),
            F.when(q, F.col("posts") - 1).otherwise(0).cast("int").alias("answers"),
            F.when(q & solved, "True").when(q, "False").when((F.col("ordinal") == 1) & solved, "solution")
            .otherwise("").alias("resolve"),
            F.coalesce("upvotes", F.lit(0)).cast("long").alias("upvotes"),
            F.concat(F.lit(FORUM_URL), thread).alias("url"),
            thread.alias("thread_id"),
            F.col("ordinal").cast("int").alias("ordinal"),
        ).select(*POST.fieldNames())

    @cached_property
    def store(self) -> DataFrame:
        """Posts as the harvest leaves them: a written store."""
        return stage(self.posts(), "posts")

    def posts_gap(self) -> DataFrame:
        """Posts with missing answers, empty texts, tagged answers, and marks that disagree: solutions that lost their mark,
        questions that count as open beside one."""
        thread, ordinal = F.col("thread_id").cast("long"), F.col("ordinal")
        kept = self.store.filter(~((thread % 4 == 1) & (ordinal == 2)))
        return kept.withColumn("text", F.when((thread % 5 == 2) & (ordinal == 1), "").otherwise(F.col("text"))).withColumn(
            "tags", F.when((thread % 6 == 3) & (ordinal > 0), F.array(F.lit("x"))).otherwise(F.col("tags"))
        ).withColumn(
            "resolve",
            F.when((thread % 5 == 3) & (ordinal == 1), "").when((thread % 5 == 4) & (ordinal == 0), "False")
            .otherwise(F.col("resolve")),
        )

    @cached_property
    def large_orders(self) -> HotKeys:
        return heavy_keys(self.table("lineitem"), ["l_orderkey"])

    @cached_property
    def large_threads(self) -> HotKeys:
        """The same, as threads of ``lines``."""
        frame = self.large_orders.frame
        named = frame and frame.select(F.lit("c").alias("site"), _text("l_orderkey").alias("thread_id"))
        return HotKeys(THREAD, named)

    def answer_lines(self) -> DataFrame:
        """The lines as answers, without what only their order tells."""
        return self.table("lineitem").select(
            F.lit("c").alias("site"),
            _text("l_orderkey").alias("thread_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("l_shipdate").cast("timestamp").alias("date_time"),
            F.concat(F.lit("user"), _text("l_suppkey")).alias("author"),
        )

    def lines(self) -> DataFrame:
        """An order is a thread, its lines are the answers."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus"),
            (F.col("o_orderkey") % 5 + 2).alias("declared"),
        )
        line = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
        )
        joined = line.join(orders, "l_orderkey")
        comma = (F.col("l_orderkey") % 50 == 0) & (F.col("l_linenumber") == 1)
        return joined.select(
            F.lit("c").alias("site"),
            _text("l_orderkey").alias("thread_id"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("uid"),
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.when(F.col("l_returnflag") == "N", "---").otherwise(_text(F.floor("l_quantity"))).alias("upvotes"),
            F.when(comma, "1,234").otherwise(_text(F.floor("l_extendedprice"))).alias("views"),
            F.col("l_shipdate").cast("timestamp").alias("date_time"),
            F.col("o_orderdate").cast("timestamp").alias("question_date"),
            F.concat(F.lit("user"), _text("l_suppkey")).alias("author"),
            F.when(F.col("o_orderstatus") == "F", "Answered.").when(F.col("o_orderstatus") == "O", "Not Answered.")
            .otherwise("Assumed Answered.").alias("status"),
            F.when(F.col("l_returnflag") == "R", "solution").otherwise("---").alias("resolve"),
            "declared",
        )

    def order_threads(self) -> DataFrame:
        """All orders as threads, with lines or without."""
        status = (
            F.when(F.col("o_orderstatus") == "F", "Answered.").when(F.col("o_orderstatus") == "O", "Not Answered.")
            .otherwise("Assumed Answered.")
        )
        return self.table("orders").select(
            F.lit("c").alias("site"), _text("o_orderkey").alias("thread_id"), status.alias("status")
        )

    def ages(self) -> DataFrame:
        return self.events.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("anchor"),
            F.concat(F.lit("Computing - "), _age()).alias("caption"),
            _age().alias("age"),
        )

    def headers(self) -> DataFrame:
        """Post headers with a month date, a second-line date, or none."""
        stamp = F.date_format("ts", "MMM d, yyyy h:mm a")
        return self.events.select(
            "event_id",
            F.when(F.col("event_id") % 5 < 3, F.concat(F.lit("user Jan 1, 2001 1:00 AM on "), stamp, F.lit(" in forum")))
            .when(F.col("event_id") % 5 == 3, F.concat(F.lit("user\n"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
            .otherwise("user, some day").alias("header"),
        )

    def date_captions(self) -> DataFrame:
        stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
        kind = F.col("event_id") % 5
        return self.events.select(
            "event_id",
            F.when(kind == 0, F.concat(F.lit("Last asked: "), stamp))
            .when(kind == 1, F.concat(F.lit("Written "), stamp))
            .when(kind == 2, F.concat(F.lit("Updated "), stamp))
            .when(kind == 3, F.concat(F.lit("by user "), _text("user_id"), F.lit(" on "), stamp))
            .otherwise(F.concat(F.lit("· "), stamp)).alias("caption"),
        )

    def frontier(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("seq"),
            F.concat(F.lit(FORUM_URL), _text("user_id")).alias("url"),
            _age().alias("date"),
            F.col("event_type").alias("origin"),
        )

    def counts(self) -> DataFrame:
        e, kind = F.col("event_id"), F.col("event_id") % 4
        return self.events.select(
            "event_id",
            F.when(kind == 0, F.concat(_text(e % 97), F.lit("."), _text(e % 10), F.lit("k Views")))
            .when(kind == 1, F.concat(_text(e % 9 + 1), F.lit(","), F.lpad(_text(e % 1000), 3, "0"), F.lit(" Views")))
            .when(kind == 2, F.concat(_text(e % 1000), F.lit(" Views")))
            .otherwise("Asked by kim").alias("views_text"),
            F.when(e % 3 == 0, F.concat(_text(e % 40), F.lit(" answers"))).when(e % 3 == 1, "1 answer").otherwise("")
            .alias("answers_text"),
        )

    def edges(self) -> DataFrame:
        n = self.pages.agg(F.count("*")).scalar()
        page = F.col("page_id")
        kinds = F.array(
            F.struct(((page * 7 + 3) % n).alias("dst"), F.lit("related").alias("kind")),
            F.struct(((page * 13 + 1) % n).alias("dst"), F.lit("related").alias("kind")),
            F.struct((page + 1).alias("dst"), F.lit("next").alias("kind")),
        )
        return (
            self.pages.select(page.alias("src"), F.explode(kinds).alias("e"), n.alias("n"))
            .select("src", "e.dst", "e.kind", "n")
            .filter((F.col("kind") == "related") | (F.col("dst") < F.col("n")))
            .drop("n")
        )

    def english(self) -> DataFrame:
        url = F.col("url")
        return self.pages.filter(F.contains(url, F.lit("/en/"))).select(
            F.col("page_id").alias("node"), F.contains(url, F.lit("utm_source=feed")).alias("feed")
        )

    def listing(self) -> DataFrame:
        page, english = F.col("page_id"), F.contains(F.col("url"), F.lit("/en/"))
        return self.pages.select(
            "page_id",
            "url",
            F.when(page % 3 == 0, "question").when(page % 3 == 1, "correct").otherwise("poll").alias("icon"),
            (page % 5 != 0).alias("author_linked"),
            F.when(english, "Programming & Design").otherwise("Cooking").alias("category"),
        )

    def topics(self) -> DataFrame:
        """All sources."""
        return self.table("documents").select(F.col("source").alias("topic")).distinct()

    def tagged(self) -> DataFrame:
        return self.documents.select(
            "doc_id", F.concat(F.lit("<"), F.col("lang"), F.lit("> <"), F.col("source"), F.lit("> ")).alias("tags_packed")
        )

    def raw_tags(self) -> DataFrame:
        """Tag texts: five documents are a thread, the first of them its question."""
        doc = F.col("doc_id")
        return self.documents.select(
            _text(F.floor(doc / 5)).alias("thread_id"),
            (doc % 5).cast("int").alias("ordinal"),
            F.when(doc % 5 == 0, F.concat_ws(".", "source", "lang")).when(doc % 3 == 0, "N/A")
            .otherwise(F.concat_ws(" ", "lang", "source")).alias("tags_raw"),
        )

    def edge_text(self) -> DataFrame:
        kind, text = F.col("doc_id") % 7, F.col("text")
        return self.documents.select(
            "doc_id",
            F.when(kind == 0, F.concat(text, F.lit(" https://x.example/a")))
            .when(kind == 1, F.concat(text, F.lit(" Foo.JAVA ")))
            .when(kind == 2, F.concat(text, F.lit(" {x}")))
            .when(kind == 3, F.concat(text, F.lit(" LAMBDA")))
            .when(kind == 4, "").otherwise(text).alias("text"),
        )

    def code(self) -> DataFrame:
        """Code markup around whole texts."""
        return self.documents.select(
            "doc_id",
            F.concat(
                F.lit('<div class="OriginallyAnsweredBanner">b\nc</div><td class="linenos">1\n2</td><ol class="linenums">'),
                F.col("source"),
                F.lit('</ol><pre class="prettyprint inline prettyprinted" id="q">'),
                F.col("lang"),
                F.lit('</pre><pre>[code]'),
                F.col("text"),
                F.lit('[/code]</pre><td class="code">y</td><div class="codeblock inline_codeblock">z</div>'
                      '<a class="user" href="/u" action_mousedown="UserLinkClickthrough">me</a>'
                      '<div class="ContentFooter AnswerFooter" id="f">foot\nend</div>'),
            ).alias("html"),
        )


_AGE_SQL = (
    "case when event_id % 8 = 7 then 'not available' else concat(event_id % 50 + 1, ' ', "
    "['second','minute','hour','day','week','month','year'][event_id % 8 + 1], "
    "case when event_id % 50 = 0 then '' else 's' end, ' ago') end"
)

# DuckDB twins; a CTE may use the ones named before it.
CTES = {
    "posts": """
pu as (select max(user_id) + 1 m from events),
pe as (select user_id, sum(case when event_type = 'view' then 1 else 0 end) views,
              sum(case when event_type = 'click' then 1 else 0 end) upvotes, min(ts) ts from events group by user_id),
pp as (select c.conv_id, c.turn, c.role, c.text, row_number() over (partition by c.conv_id order by c.turn, c.role) - 1 ordinal,
              (c.conv_id * 31 + c.turn * 17) % (select m from pu) k from conversations c),
pn as (select conv_id, max(ordinal) answers from pp group by conv_id),
posts as (
 select 'a' site, cast(pp.conv_id as varchar) thread_id, cast(pp.ordinal as int) ordinal,
  case when pp.ordinal = 0 then cast(pp.conv_id as varchar) else concat(pp.conv_id, '.', pp.ordinal) end uid,
  case when pp.ordinal = 0 then 'question' else 'answer' end type,
  case when k % 10 = 0 then '' else concat(pp.role, k) end author,
  case when pp.ordinal = 0 then concat('Thread ', pp.conv_id) else '' end title,
  pp.text, pe.ts date_time,
  case when pp.ordinal = 0 and pp.conv_id % 4 <> 0 then [concat('topic', pp.conv_id % 5), 'forum'] end tags,
  cast(case when pp.ordinal = 0 then pn.answers else 0 end as int) answers,
  cast(coalesce(pe.views, 0) as bigint) views, cast(coalesce(pe.upvotes, 0) as bigint) upvotes,
  case when pp.ordinal = 0 then (case when pp.conv_id % 3 <> 0 then 'True' else 'False' end)
       when pp.ordinal = 1 and pp.conv_id % 3 <> 0 then 'solution' else '' end resolve,
  concat('https://forum.example.org/question/', pp.conv_id) url
 from pp join pn on pp.conv_id = pn.conv_id left join pe on pe.user_id = pp.k)""",
    "posts_gap": """
posts_gap as (select * replace (
   case when thread_id::int % 5 = 2 and ordinal = 1 then '' else text end as text,
   case when thread_id::int % 6 = 3 and ordinal > 0 then ['x'] else tags end as tags,
   case when thread_id::int % 5 = 3 and ordinal = 1 then '' when thread_id::int % 5 = 4 and ordinal = 0 then 'False'
        else resolve end as resolve)
 from posts where not (thread_id::int % 4 = 1 and ordinal = 2))""",
    "lines": """
lines as (select 'c' site, cast(l_orderkey as varchar) thread_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) uid, l_linenumber, l_partkey, l_suppkey,
  case when l_returnflag = 'N' then '---' else cast(cast(floor(l_quantity) as bigint) as varchar) end upvotes,
  case when l_orderkey % 50 = 0 and l_linenumber = 1 then '1,234'
       else cast(cast(floor(l_extendedprice) as bigint) as varchar) end views,
  l_shipdate date_time, o_orderdate question_date, concat('user', l_suppkey) author,
  case o_orderstatus when 'F' then 'Answered.' when 'O' then 'Not Answered.' else 'Assumed Answered.' end status,
  case when l_returnflag = 'R' then 'solution' else '---' end resolve, o_orderkey % 5 + 2 declared
 from lineitem join orders on l_orderkey = o_orderkey)""",
    "ages": f"""
ages as (select event_id, ts anchor, concat('Computing - ', {_AGE_SQL}) caption, {_AGE_SQL} age from events)""",
    "headers": """
headers as (select event_id, case when event_id % 5 < 3
   then concat('user Jan 1, 2001 1:00 AM on ', strftime(ts, '%b %-d, %Y %-I:%M %p'), ' in forum')
   when event_id % 5 = 3 then concat('user', chr(10), strftime(ts, '%Y-%m-%d %H:%M:%S')) else 'user, some day' end header
 from events)""",
    "date_captions": """
date_captions as (select event_id, concat(case event_id % 5 when 0 then 'Last asked: ' when 1 then 'Written '
   when 2 then 'Updated ' when 3 then concat('by user ', user_id, ' on ') else '· ' end,
   strftime(ts, '%Y-%m-%d %H:%M:%S')) caption from events)""",
    "frontier": f"""
frontier as (select event_id seq, concat('https://forum.example.org/question/', user_id) url, {_AGE_SQL} date,
   event_type origin from events)""",
    "counts": """
counts as (select event_id, case event_id % 4 when 0 then concat(event_id % 97, '.', event_id % 10, 'k Views')
   when 1 then concat(event_id % 9 + 1, ',', lpad(cast(event_id % 1000 as varchar), 3, '0'), ' Views')
   when 2 then concat(event_id % 1000, ' Views') else 'Asked by kim' end views_text,
   case event_id % 3 when 0 then concat(event_id % 40, ' answers') when 1 then '1 answer' else '' end answers_text
 from events)""",
    "edges": """
edges as (select page_id src, (page_id * 7 + 3) % n dst, 'related' kind from pages, (select count(*) n from pages)
   union all select page_id, (page_id * 13 + 1) % n, 'related' from pages, (select count(*) n from pages)
   union all select page_id, page_id + 1, 'next' from pages, (select count(*) n from pages) where page_id + 1 < n),
english as (select page_id node, url like '%utm_source=feed%' feed from pages where url like '%/en/%')""",
    "listing": """
listing as (select page_id, url, case page_id % 3 when 0 then 'question' when 1 then 'correct' else 'poll' end icon,
   page_id % 5 <> 0 author_linked,
   case when url like '%/en/%' then 'Programming & Design' else 'Cooking' end category from pages)""",
    "topics": """
topics as (select distinct source topic from documents)""",
    "tagged": """
tagged as (select doc_id, concat('<', lang, '> <', source, '> ') tags_packed from documents)""",
    "raw_tags": """
raw_tags as (select cast(doc_id // 5 as varchar) thread_id, cast(doc_id % 5 as int) ordinal,
   case when doc_id % 5 = 0 then concat(source, '.', lang) when doc_id % 3 = 0 then 'N/A'
        else concat(lang, ' ', source) end tags_raw from documents)""",
    "edge_text": """
edge_text as (select doc_id, case doc_id % 7 when 0 then concat(text, ' https://x.example/a')
   when 1 then concat(text, ' Foo.JAVA ') when 2 then concat(text, ' {x}') when 3 then concat(text, ' LAMBDA')
   when 4 then '' else text end text from documents)""",
    "code": """
code as (select doc_id, concat('<div class="OriginallyAnsweredBanner">b', chr(10), 'c</div><td class="linenos">1', chr(10),
   '2</td><ol class="linenums">', source, '</ol><pre class="prettyprint inline prettyprinted" id="q">', lang,
   '</pre><pre>[code]', text, '[/code]</pre><td class="code">y</td><div class="codeblock inline_codeblock">z</div>',
   '<a class="user" href="/u" action_mousedown="UserLinkClickthrough">me</a><div class="ContentFooter AnswerFooter" id="f">foot',
   chr(10), 'end</div>') html from documents)""",
}
