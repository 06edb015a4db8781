"""Queries over quality checks, the baseline evaluation and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators import quality as qc
from threadlens.operators import reports as rp
from threadlens.plans.bridges import Tables
from threadlens.plans.registry import query
from threadlens.schema import THREAD


@query(
    "q_qc_answer_count",
    """select q.thread_id, q.answers expected, cast(least(q.answers, coalesce(p.found, 0)) as int) answers
    from posts_gap q left join (select thread_id, count(*) found from (select thread_id, ordinal,
        row_number() over (partition by thread_id order by ordinal) rn
        from (select distinct thread_id, ordinal from posts_gap where type = 'answer')) where ordinal = rn group by thread_id) p
      on q.thread_id = p.thread_id where q.type = 'question'""",
    "posts",
    "posts_gap",
)
def answer_count(t: Tables) -> DataFrame:
    return qc.reconcile_counts(t.posts_gap()).select("thread_id", "expected", "answers")


@query(
    "q_qc_fixed_posts",
    """select q.uid, cast(case when q.type = 'question' then least(q.answers, coalesce(p.found, 0)) else q.answers end as int) answers, q.text
    from posts_gap q left join (select thread_id, count(*) found from (select thread_id, ordinal,
        row_number() over (partition by thread_id order by ordinal) rn
        from (select distinct thread_id, ordinal from posts_gap where type = 'answer')) where ordinal = rn group by thread_id) p
      on q.thread_id = p.thread_id""",
    "posts",
    "posts_gap",
)
def fixed_posts(t: Tables) -> DataFrame:
    return qc.fix_counts(t.posts_gap()).select("uid", "answers", "text")


@query("q_qc_empty_text", "select uid from posts_gap where coalesce(text, '') = ''", "posts", "posts_gap")
def empty_text(t: Tables) -> DataFrame:
    return qc.empty_text(t.posts_gap()).select("uid")


@query(
    "q_qc_answer_tags",
    """select q.uid, t.tag, bool_and(t.type = 'answer') lifted from posts_gap q join (select thread_id, type, unnest(tags) tag
      from posts_gap) t on q.thread_id = t.thread_id where q.type = 'question' group by all""",
    "posts",
    "posts_gap",
)
def answer_tags(t: Tables) -> DataFrame:
    return qc.lift_tags(t.posts_gap()).select("uid", "tag", "lifted")


@query(
    "q_qc_load_mismatch",
    """select q.thread_id, q.answers expected, count(a.uid) loaded from posts_gap q left join posts_gap a
      on q.thread_id = a.thread_id and a.type = 'answer' and a.ordinal <= q.answers
    where q.type = 'question' and q.answers > 0 group by all having count(a.uid) <> q.answers""",
    "posts",
    "posts_gap",
)
def load_mismatch(t: Tables) -> DataFrame:
    return qc.load_mismatch(t.posts_gap()).select("thread_id", "expected", "loaded")


@query(
    "q_qc_solution_consistency",
    """select * from (select thread_id, bool_or(type = 'question' and resolve = 'True') resolved,
      bool_or(type = 'answer' and resolve = 'solution') solved from posts_gap group by thread_id) where resolved <> solved""",
    "posts",
    "posts_gap",
)
def solution_consistency(t: Tables) -> DataFrame:
    return qc.solution_consistency(t.posts_gap()).select("thread_id", "resolved", "solved")


TOP_SQL = """
voted as (select *, coalesce(try_cast(upvotes as bigint), 0) votes from lines),
predicted as (select *, case when votes = greatest(0, max(votes) over (partition by thread_id)) then 'solution' else '' end prediction
  from voted)"""


@query(
    "q_rp_max_upvotes",
    """select cast(o_orderkey as varchar) thread_id, greatest(0, coalesce(max(votes), 0)) max_upvotes from orders
    left join voted on thread_id = cast(o_orderkey as varchar) group by o_orderkey""",
    "lines",
    extra=TOP_SQL,
)
def max_upvotes(t: Tables) -> DataFrame:
    return rp.max_upvotes(t.lines(), t.order_threads(), ("thread_id",))


@query("q_rp_predict_top", "select uid, prediction from predicted", "lines", extra=TOP_SQL)
def predict_top(t: Tables) -> DataFrame:
    lines = t.lines().select(*THREAD, "uid", "upvotes")
    return rp.predict_top(lines, hot=t.large_threads).select("uid", "prediction")


@query(
    "q_rp_confusion",
    """select *, cast(a + b as double) / total_answers accuracy from (
      select count(*) filter (prediction = 'solution' and resolve = 'solution') a,
        count(*) filter (prediction = '' and resolve = '---') b,
        count(*) filter (prediction = 'solution' and resolve = '---') c,
        count(*) filter (prediction = '' and resolve = 'solution') d, (select cast(sum(o_orderkey % 5 + 2) as bigint) from orders
          where o_orderkey in (select l_orderkey from lineitem)) total_answers from predicted)""",
    "lines",
    extra=TOP_SQL,
)
def confusion(t: Tables) -> DataFrame:
    return rp.strawman(t.lines(), ("thread_id",), declared="declared")


@query(
    "q_rp_status_counts",
    """select (select count(*) from orders) questions, (select count(*) from orders where o_orderstatus = 'F') answered,
      (select count(*) from lineitem where l_returnflag = 'R') solutions,
      (select count(*) from orders where o_orderstatus = 'O') not_answered,
      (select count(*) from orders where o_orderstatus not in ('F', 'O')) assumed_answered""",
)
def status_counts(t: Tables) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", "Answered.").when(F.col("o_orderstatus") == "O", "Not Answered.")
        .otherwise("Assumed Answered.")
    )
    mark = F.when(F.col("l_returnflag") == "R", "solution").otherwise("---")
    posts = t.table("orders").select(F.lit("Question").alias("type"), status.alias("resolve")).unionByName(
        t.table("lineitem").select(F.lit("Answer").alias("type"), mark.alias("resolve"))
    )
    return rp.status_counts(posts, F.col("type") == "Question", F.col("resolve"))


@query(
    "q_rp_type_counts",
    "select count(*) filter (type = 'question') questions, count(*) filter (type <> 'question') answers from posts",
    "posts",
)
def type_counts(t: Tables) -> DataFrame:
    return rp.type_counts(t.posts())


@query("q_rp_last_uid", "select max(cast(uid as bigint)) last_uid from posts where type = 'question'", "posts")
def last_uid(t: Tables) -> DataFrame:
    return rp.last_uid(t.posts())


@query("q_rp_topic_counts", "select count(distinct source) topics from documents")
def topic_counts(t: Tables) -> DataFrame:
    return rp.topic_count(t.documents.select(F.col("source").alias("topic")))


@query("q_rp_link_counts", "select origin, count(*) links from frontier group by origin", "frontier")
def link_counts(t: Tables) -> DataFrame:
    return rp.links_by_origin(t.frontier())
