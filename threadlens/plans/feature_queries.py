"""Queries over threads, answer features and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators import features as ft
from threadlens.operators import ranks as rk
from threadlens.operators import reports as rp
from threadlens.operators import threads as th
from threadlens.operators.skew import heavy_keys
from threadlens.plans.bridges import Tables
from threadlens.plans.corpus_queries import loglik_sql, stem_sql
from threadlens.plans.registry import query
from threadlens.schema import THREAD
from threadlens.session import fresh_path
from threadlens.sources.posts import read_store, write_posts
from threadlens.sources.tables import FEATURE_SEP, read_features, write_features

FORMAT = "'%Y-%m-%d %H:%M:%S'"

# --- threads ----------------------------------------------------------------------------------------------

JOIN_SQL = """select a.uid, a.ordinal, q.uid question_uid, q.answers answers_count, q.resolve resolved
from posts a join posts q on a.site = q.site and a.thread_id = q.thread_id and q.type = 'question'"""


def thread_columns(df: DataFrame) -> DataFrame:
    return df.select("uid", "ordinal", "question_uid", "answers_count", "resolved")


@query("q_th_join", JOIN_SQL + " where a.type = 'answer' and a.ordinal between 1 and q.answers", "posts")
def th_join(t: Tables) -> DataFrame:
    return thread_columns(th.threads(t.store.drop("text")))


@query("q_th_join_compat_c", JOIN_SQL + " where a.ordinal + 1 between 1 and q.answers", "posts")
def th_join_compat_c(t: Tables) -> DataFrame:
    return thread_columns(th.threads(t.store.drop("text"), compat="c"))


@query(
    "q_th_exclude_empty",
    "select thread_id from posts where type = 'answer' group by thread_id having min(ordinal) = 1",
    "posts",
)
def th_exclude_empty(t: Tables) -> DataFrame:
    return th.threads(t.store.drop("text")).select("thread_id").distinct()


@query(
    "q_th_nested",
    """select q.thread_id, q.uid question_uid, q.answers answers_count, a.ordinal, a.uid answer_uid, a.text
    from posts a join posts q on a.thread_id = q.thread_id and q.type = 'question' and a.type = 'answer'""",
    "posts",
)
def th_nested(t: Tables) -> DataFrame:
    nested = th.nest(t.store)
    return nested.select("thread_id", "question_uid", "answers_count", "ordinal", F.col("answer.uid").alias("answer_uid"), "answer.text")


THREAD_TAGS_SQL = """thread_tags as (select distinct thread_id, tag from (select thread_id,
   unnest(case when ordinal = 0 then string_split(tags_raw, '.') else string_split(tags_raw, ' ') end) tag from raw_tags)
   where tag not in ('N/A', ''))"""


@query(
    "q_th_tags",
    "select r.thread_id, t.tag from (select distinct thread_id from raw_tags) r left join thread_tags t on r.thread_id = t.thread_id",
    "raw_tags",
    extra=THREAD_TAGS_SQL,
)
def th_tags(t: Tables) -> DataFrame:
    tags = th.split_tags(F.col("tags_raw"), F.col("ordinal"))
    return th.thread_tags(t.raw_tags(), tags, ("thread_id",))


@query(
    "q_ft_has_tags",
    "select r.thread_id, count(t.tag) > 0 has_tags from raw_tags r left join thread_tags t on r.thread_id = t.thread_id group by r.thread_id",
    "raw_tags",
    extra=THREAD_TAGS_SQL,
)
def has_tags(t: Tables) -> DataFrame:
    return th.has_tags(t.raw_tags(), th.split_tags(F.col("tags_raw"), F.col("ordinal")), ("thread_id",))


# --- features of one text ---------------------------------------------------------------------------------

WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> ''))"
# RE2 cannot look behind: sentence ends are marked, then split.
SENTENCES = r"list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"
SENTENCE_WORDS = f"list_transform({SENTENCES}, lambda s: {WORDS.format('s')})"
SYLLABLES = (
    r"len(regexp_extract_all({0}, '[aeiouy]+')) - len(list_filter(regexp_split_to_array({0}, '\s+'), "
    r"lambda w: (w like '%es' and length(w) > 2) or (w like '%e' and length(w) > 1)))"
)
# Marks of program code.
CODE_SQL = (
    r"regexp_matches({0}, '(?i)(\{{|\}}| package |\.jar| class | namespace |exception |<<| end | def |<\?php| soap | <xml"
    r"| wsdl |\.cs|\.java|\.php|\.rb|lambda)')"
)


def ratio_sql(a: str, b: str) -> str:
    return f"case when {b} > 0 then cast((200 * {a} + {b}) // (2 * {b}) as double) / 100 else cast(0 as double) end"


@query("q_ft_len", "select doc_id, length(text) len from documents")
def ft_len(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.length(F.col("text")).alias("len"))


@query("q_ft_wordcount", f"select doc_id, {WORDS.format('text')} wordcount from documents")
def ft_wordcount(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("wordcount"))


@query(
    "q_ft_chars_per_word",
    f"select doc_id, {ratio_sql('l', 'w')} avg_chars_per_word from (select doc_id, length(text) l, {WORDS.format('text')} w from documents)",
)
def ft_chars_per_word(t: Tables) -> DataFrame:
    return rated(t, "avg_chars_per_word")


def rated(t: Tables, column: str) -> DataFrame:
    return ft.text_features(t.documents.select("doc_id", "text")).select("doc_id", F.col(f"`{column}`").alias(column))


@query("q_ft_sentences", f"select doc_id, len({SENTENCES.format('text')}) sentences from documents")
def ft_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.sentence_count(F.col("text")).alias("sentences"))


@query(
    "q_ft_words_per_sentence",
    f"""select doc_id, {ratio_sql('w', 's')} avg_words_per_sentence
    from (select doc_id, {WORDS.format('text')} w, len({SENTENCES.format('text')}) s from documents)""",
)
def ft_words_per_sentence(t: Tables) -> DataFrame:
    return rated(t, "avg_words_per_sentence")


@query("q_ft_longest_sentence", f"select doc_id, coalesce(list_max({SENTENCE_WORDS.format('text')}), 0) longest_sentence from documents")
def ft_longest_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.longest_sentence(F.col("text")).alias("longest_sentence"))


@query("q_ft_syllables", f"select doc_id, {SYLLABLES.format('text')} syllables from documents")
def ft_syllables(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.syllables(F.col("text")).alias("syllables"))


FK_SQL = "cast(0.39 as double) * {0} + cast(11.8 as double) * {1} - cast(15.59 as double)"


@query(
    "q_ft_readability",
    f"""select doc_id, {FK_SQL.format('wps', 'syl')} readability from (select doc_id, syl, {ratio_sql('w', 's')} wps
    from (select doc_id, {WORDS.format('text')} w, len({SENTENCES.format('text')}) s, {SYLLABLES.format('text')} syl from documents))""",
)
def ft_readability(t: Tables) -> DataFrame:
    return rated(t, "F-K").withColumnRenamed("F-K", "readability")


@query("q_ft_has_links", "select doc_id, regexp_matches(text, 'https?://') has_links from edge_text", "edge_text")
def ft_has_links(t: Tables) -> DataFrame:
    return t.edge_text().select("doc_id", tx.has_links(F.col("text")).alias("has_links"))


@query("q_ft_has_code", f"select doc_id, {CODE_SQL.format('text')} has_code from edge_text", "edge_text")
def ft_has_code(t: Tables) -> DataFrame:
    return t.edge_text().select("doc_id", tx.has_code(F.col("text")).alias("has_code"))


DIFF_SQL = "abs(epoch_us({0}) - epoch_us(coalesce({1}, timestamp '1970-01-01'))) / cast(1000000 as double)"


@query("q_ft_time_difference", f"select uid, {DIFF_SQL.format('date_time', 'question_date')} time_difference from lines", "lines")
def ft_time_difference(t: Tables) -> DataFrame:
    return t.lines().select(
        "uid", ft.time_difference(F.col("date_time"), F.col("question_date")).alias("time_difference")
    )


@query("q_ft_solution", "select uid, resolve = 'solution' solution from posts where type = 'answer'", "posts")
def ft_solution(t: Tables) -> DataFrame:
    return t.posts().filter(F.col("type") == "answer").select("uid", ft.solution(F.col("resolve")).alias("solution"))


# --- the feature table ------------------------------------------------------------------------------------

# What is ranked, and which way.
RANK_SQL = ", ".join(
    f"""rank() over (partition by site, thread_id order by {key} {way} nulls last)::int {name}"""
    for key, way, name in (
        ("upvotes", "desc", "upvotes_rank"),
        ("sentences", "desc", "sentences_rank"),
        ("len", "desc", "len_rank"),
        ("views", "desc", "views_rank"),
        ("wordcount", "desc", "wordcount_rank"),
        ("avg_chars_per_word", "desc", "avg_chars_per_word_rank"),
        ("avg_words_per_sentence", "desc", "avg_words_per_sentence_rank"),
        ("longest_sentence", "desc", "longest_sentence_rank"),
        ("time_difference", "asc", "time_difference_rank"),
        ("loglikelihood", "desc", "loglikelihood_descending_rank"),
        ("loglikelihood", "asc", "loglikelihood_ascending_rank"),
        ('"F-K"', "desc", '"F-K_descending_rank"'),
        ('"F-K"', "asc", '"F-K_ascending_rank"'),
    )
)

ANSWERS = "a.type = 'answer' and a.ordinal <= q.answers"


def feature_sql(source: str = "posts", pairs: str = ANSWERS) -> str:
    """CTEs up to ``features`` over the posts of ``source``; ``pairs`` says which posts are answers of q."""
    return (
        f"src as (select *, concat(site, '/', uid) sid from {source}),"
        + stem_sql("src")
        + ","
        + loglik_sql("src", "sid")
        + f""",
measured as (select a.site, a.thread_id, a.ordinal, a.uid, a.sid, a.text, a.date_time dt, a.views, a.upvotes, a.resolve,
   q.uid question_uid, q.answers answers_count, q.resolve resolved, coalesce(len(q.tags) > 0, false) has_tags,
   {DIFF_SQL.format('a.date_time', 'q.date_time')} time_difference, length(a.text) len, {WORDS.format('a.text')} wordcount,
   len({SENTENCES.format('a.text')}) sentences, coalesce(list_max({SENTENCE_WORDS.format('a.text')}), 0) longest_sentence,
   {SYLLABLES.format('a.text')} syl, regexp_matches(a.text, 'https?://') has_links, {CODE_SQL.format('a.text')} has_code_snippet
  from src a join src q on a.site = q.site and a.thread_id = q.thread_id and q.type = 'question' and {pairs}),
rated as (select m.*, {ratio_sql('len', 'wordcount')} avg_chars_per_word, {ratio_sql('wordcount', 'sentences')} avg_words_per_sentence,
   loglikelihood from measured m join loglik l on m.sid = l.sid),
scored as (select *, {FK_SQL.format('avg_words_per_sentence', 'syl')} "F-K" from rated),
features as (select site, thread_id, ordinal, resolved, question_uid, answers_count, uid answer_uid, strftime(dt, {FORMAT}) date_time,
   time_difference, resolve = 'solution' solution, len, wordcount, avg_chars_per_word, sentences, avg_words_per_sentence,
   longest_sentence, views, loglikelihood, "F-K", upvotes, has_links, has_code_snippet, has_tags, {RANK_SQL} from scored)"""
    )


FEATURE_SQL = feature_sql()


@query("q_ft_feature_table", "select * from features", "posts", extra=FEATURE_SQL)
def feature_table(t: Tables) -> DataFrame:
    return ft.features(t.store)


POSTS_C_SQL = """posts_c as (select * replace ('c' as site,
  case when thread_id::int % 7 = 3 and ordinal = 1 then null else views end as views) from posts),
"""


def posts_c(t: Tables) -> DataFrame:
    """The store as one of the second site, where some views are not known."""
    unknown = (F.col("thread_id").cast("long") % 7 == 3) & (F.col("ordinal") == 1)
    return t.store.withColumns({"site": F.lit("c"), "views": F.when(~unknown, F.col("views"))})


FEATURES_C_SQL = """select * exclude (upvotes_rank) replace (case when bool_or(views is null) over (partition by site, thread_id)
  then null else views_rank end as views_rank), cast(null as int) upvotes_rank from features"""


def features_c(t: Tables) -> DataFrame:
    return ft.features(posts_c(t), compat="c", unranked=("upvotes_rank",), guarded=("views_rank",))


PAIRS_C = "a.ordinal + 1 between 1 and q.answers"


@query("q_ft_feature_table_c", FEATURES_C_SQL, "posts", extra=POSTS_C_SQL + feature_sql("posts_c", PAIRS_C))
def feature_table_c(t: Tables) -> DataFrame:
    """The table of the second site: its pairing, no ranks of votes, ranks of views where all are known."""
    return features_c(t)


@query(
    "q_sink_features_csv_c",
    f"""select * exclude (site, thread_id, ordinal, is_first) replace (
      case when is_first then resolved else '' end as resolved, case when is_first then question_uid else '' end as question_uid)
    from (select *, ordinal = min(ordinal) over (partition by site, thread_id) is_first from ({FEATURES_C_SQL}))""",
    "posts",
    extra=POSTS_C_SQL + feature_sql("posts_c", PAIRS_C),
)
def features_csv_c(t: Tables) -> DataFrame:
    """The second site's file, with commas."""
    path, table = fresh_path(t.spark, "features-c"), features_c(t)
    write_features(table, path, FEATURE_SEP["c"])
    return read_features(t.spark, path, table.select(*[F.col(f"`{c}`") for c in ft.FEATURES]).schema, FEATURE_SEP["c"])


STORES_SQL = """stores as (select * from posts union all select * replace ('b' as site, upvotes + ordinal as upvotes,
  concat(text, ' More words, then some.') as text) from posts),
"""


@query("q_ft_feature_table_stores", "select * from features", "posts", extra=STORES_SQL + feature_sql("stores"))
def feature_table_stores(t: Tables) -> DataFrame:
    """Two stores whose threads and posts have the same ids: one corpus, threads apart."""
    other = t.store.withColumns(
        {
            "site": F.lit("b"),
            "upvotes": F.col("upvotes") + F.col("ordinal"),
            "text": F.concat("text", F.lit(" More words, then some.")),
        }
    )
    path = fresh_path(t.spark, "stores")
    write_posts(t.store.unionByName(other), path)
    return ft.features(read_store(t.spark, path))


# --- ranks ------------------------------------------------------------------------------------------------


def rank_query(name: str, key: str, descending: bool, out: str):
    way = "desc" if descending else "asc"
    sql = f"""select answer_uid, "{key}", rank() over (partition by thread_id order by "{key}" {way} nulls last)::int "{out}" from features"""

    @query(name, sql, "posts", extra=FEATURE_SQL)
    def ranked(t: Tables) -> DataFrame:
        if key == "loglikelihood":
            ranked = ft.features(t.store)
        else:
            posts = t.store
            hot = heavy_keys(posts, THREAD)
            answers = th.threads(posts, ft.measured_answers(posts)).withColumn("answer_uid", F.col("uid"))
            ranked = rk.add_rank(answers, key, descending, out, hot=hot)
        return ranked.select("answer_uid", F.col(f"`{key}`"), F.col(f"`{out}`"))


for _name, _key, _descending, _out in (
    ("q_wn_sentences", "sentences", True, "sentences_rank"),
    ("q_wn_len", "len", True, "len_rank"),
    ("q_wn_wordcount", "wordcount", True, "wordcount_rank"),
    ("q_wn_chars_per_word", "avg_chars_per_word", True, "avg_chars_per_word_rank"),
    ("q_wn_words_per_sentence", "avg_words_per_sentence", True, "avg_words_per_sentence_rank"),
    ("q_wn_longest_sentence", "longest_sentence", True, "longest_sentence_rank"),
    ("q_wn_loglik_desc", "loglikelihood", True, "loglikelihood_descending_rank"),
    ("q_wn_loglik_asc", "loglikelihood", False, "loglikelihood_ascending_rank"),
    ("q_wn_readability_desc", "F-K", True, "F-K_descending_rank"),
    ("q_wn_readability_asc", "F-K", False, "F-K_ascending_rank"),
):
    rank_query(_name, _key, _descending, _out)

LINE_NUMBERS_SQL = """
numbers as (select *, coalesce(try_cast(upvotes as bigint), 0) votes, cast(replace(views, ',', '') as bigint) seen from lines)"""


def line_numbers(t: Tables) -> DataFrame:
    return t.lines().withColumns(
        {
            "votes": rp.votes(F.col("upvotes")),
            "seen": F.replace("views", F.lit(","), F.lit("")).cast("long"),
        }
    )


@query(
    "q_wn_rank_generic",
    """select uid, rank() over (partition by thread_id order by votes desc)::int votes_rank,
      rank() over (partition by thread_id order by seen)::int seen_rank from numbers""",
    "lines",
    extra=LINE_NUMBERS_SQL,
)
def rank_generic(t: Tables) -> DataFrame:
    numbers, hot = line_numbers(t), t.large_threads
    specs = [rk.RankSpec("votes", "votes_rank"), rk.RankSpec("seen", "seen_rank", descending=False)]
    ranked = rk.add_ranks(numbers.select(*THREAD, "uid", "votes", "seen"), specs, hot=hot)
    return ranked.select("uid", "votes_rank", "seen_rank")


@query(
    "q_wn_upvotes",
    "select uid, votes, rank() over (partition by thread_id order by votes desc)::int upvotes_rank from numbers",
    "lines",
    extra=LINE_NUMBERS_SQL,
)
def rank_upvotes(t: Tables) -> DataFrame:
    numbers, hot = line_numbers(t), t.large_threads
    ranked = rk.add_rank(numbers.select(*THREAD, "uid", "votes"), "votes", out="upvotes_rank", hot=hot)
    return ranked.select("uid", "votes", "upvotes_rank")


@query(
    "q_wn_views",
    "select uid, seen, rank() over (partition by thread_id order by seen desc)::int views_rank from numbers",
    "lines",
    extra=LINE_NUMBERS_SQL,
)
def rank_views(t: Tables) -> DataFrame:
    numbers, hot = line_numbers(t), t.large_threads
    ranked = rk.add_rank(numbers.select(*THREAD, "uid", "seen"), "seen", out="views_rank", hot=hot)
    return ranked.select("uid", "seen", "views_rank")


@query(
    "q_wn_time_difference",
    f"""select uid, time_difference, rank() over (partition by thread_id order by time_difference)::int time_difference_rank
    from (select *, {DIFF_SQL.format('date_time', 'question_date')} time_difference from lines)""",
    "lines",
)
def rank_time_difference(t: Tables) -> DataFrame:
    numbers, hot = line_numbers(t), t.large_threads
    timed = numbers.select(
        *THREAD, "uid", ft.time_difference(F.col("date_time"), F.col("question_date")).alias("time_difference")
    )
    return rk.add_rank(timed, "time_difference", descending=False, hot=hot).select(
        "uid", "time_difference", "time_difference_rank"
    )


@query(
    "q_wn_rank_guard",
    """select uid, case when bad = 0 then r end::int views_rank from (select uid,
        rank() over (partition by thread_id order by try_cast(views as double) desc nulls last) r,
        sum(case when try_cast(views as double) is null then 1 else 0 end) over (partition by thread_id) bad from lines)""",
    "lines",
)
def rank_guard(t: Tables) -> DataFrame:
    numbers, hot = line_numbers(t), t.large_threads
    return rk.guarded_rank(numbers.select(*THREAD, "uid", "views"), "views", hot=hot).select("uid", "views_rank")


@query(
    "q_wn_first_row",
    """select a.uid, case when a.ordinal = min(a.ordinal) over (partition by a.thread_id) then q.resolve else '' end resolved,
      case when a.ordinal = min(a.ordinal) over (partition by a.thread_id) then q.uid else '' end question_uid
    from posts a join posts q on a.thread_id = q.thread_id and q.type = 'question' and a.type = 'answer' and a.ordinal <= q.answers""",
    "posts",
)
def first_row(t: Tables) -> DataFrame:
    posts = t.store.drop("text")
    hot = heavy_keys(posts, THREAD)
    return rk.first_row(th.threads(posts), ("resolved", "question_uid"), THREAD, hot).select(
        "uid", "resolved", "question_uid"
    )
