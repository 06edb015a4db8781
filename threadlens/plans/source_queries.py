"""Queries over sources and sinks: write to a fresh shared folder, read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.corpus import frequency, stems, token_counts
from threadlens.operators.features import FEATURES, features
from threadlens.plans.bridges import Tables
from threadlens.plans.corpus_queries import STEM_SQL
from threadlens.plans.feature_queries import FEATURE_SQL
from threadlens.plans.registry import query
from threadlens.schema import DUMP_FIELDS, FRONTIER, POST, STORE_DATE
from threadlens.session import fresh_path
from threadlens.sources.posts import (
    read_frontier,
    read_posts,
    read_store,
    read_topics,
    typed_posts,
    write_posts,
    write_topics,
)
from threadlens.sources.records import read_jsonl, read_record_dump, write_fields, write_jsonl, write_record_dump
from threadlens.streaming.ledger import post_store
from threadlens.sources.tables import materialize, materialize_for, read_features, read_freq, write_features, write_freq


def flat(posts: DataFrame) -> DataFrame:
    """Posts with dates and tags as text, so that both engines show them alike."""
    shown: dict[str, Column] = {
        "date_time": F.date_format("date_time", STORE_DATE),
        "tags": F.array_join("tags", " "),
    }
    return posts.withColumns(shown)


FLAT_SQL = """select * replace (strftime(date_time, '%Y-%m-%d %H:%M:%S') as date_time,
  array_to_string(tags, ' ') as tags{site}) from posts"""
TWO_SITES = FLAT_SQL.format(site=", case when thread_id::int % 2 = 0 then 'a' else 'b' end as site")


def two_sites(t: Tables) -> DataFrame:
    even = F.col("thread_id").cast("long") % 2 == 0
    return t.posts().withColumn("site", F.when(even, "a").otherwise("b"))


def two_stores(t: Tables) -> dict[str, str]:
    posts, stores = two_sites(t), {}
    for site in ("a", "b"):
        stores[site] = fresh_path(t.spark, f"store-{site}")
        posts.filter(F.col("site") == site).write.parquet(stores[site])
    return stores


@query("q_src_posts", TWO_SITES, "posts")
def src_posts(t: Tables) -> DataFrame:
    return flat(read_posts(t.spark, two_stores(t)))


@query("q_src_select_source", f"select * from ({TWO_SITES}) where site = 'b'", "posts")
def src_select_source(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "posts")
    write_posts(two_sites(t), path)
    return flat(read_store(t.spark, path, site="b"))


@query("q_src_frontier", "select url, date from frontier", "frontier")
def src_frontier(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "frontier")
    t.frontier().select(*FRONTIER.fieldNames()).write.parquet(path)
    return read_frontier(t.spark, path)


@query("q_src_topics", "select distinct source topic from documents")
def src_topics(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "topic-files")
    t.documents.select(F.col("source").alias("value")).write.text(path)
    return read_topics(t.spark, f"{path}/*.txt")


@query("q_sink_topics", "select distinct regexp_replace(concat(source, '-', lang, '-é'), '[^\\x00-\\x7F]', '', 'g') topic from documents")
def sink_topics(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "topics")
    write_topics(t.documents.select(F.concat_ws("-", "source", "lang", F.lit("é")).alias("topic")), path)
    return read_topics(t.spark, path)


DUMP_SQL = f"""select {", ".join(
    "coalesce(strftime(date_time, '%Y-%m-%d %H:%M:%S'), 'null') date_time" if n == "date_time"
    else "coalesce(array_to_string(list_transform(tags, lambda t: concat('<', t, '> ')), ''), 'null') tags" if n == "tags"
    else f"coalesce(cast({n} as varchar), 'null') as {n}" for n in DUMP_FIELDS)} from posts"""


@query("q_src_records_import", DUMP_SQL, "posts")
def src_records_import(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "dump")
    write_record_dump(t.posts(), path)
    return read_record_dump(t.spark, path)


# Posts with program code, quotes, record ends and tags of several words.
ODD_SQL = """odd as (select * replace (concat('int f() { return ''x''; }', chr(10), text, ' }', chr(10), ''', uid: ''') as text,
  case when tags is not null then ['data base', 'java'] end as tags) from posts)"""


def odd_posts(t: Tables) -> DataFrame:
    text = F.concat(F.lit("int f() { return 'x'; }\n"), "text", F.lit(" }\n', uid: '"))
    tags = F.when(F.col("tags").isNotNull(), F.array(F.lit("data base"), F.lit("java")))
    return t.posts().withColumns({"text": text, "tags": tags})


TYPED_SQL = """select * replace (nullif(author, '') as author, nullif(title, '') as title,
  strftime(date_time, '%Y-%m-%d %H:%M:%S') as date_time, coalesce(array_to_string(tags, ' '), '') as tags) from odd"""


@query("q_src_typed_posts", TYPED_SQL, "posts", extra=ODD_SQL)
def src_typed_posts(t: Tables) -> DataFrame:
    """Harvested text fields to the typed record."""
    path = fresh_path(t.spark, "dump")
    write_record_dump(odd_posts(t), path)
    raw = read_record_dump(t.spark, path).withColumn("site", F.lit("a"))
    return flat(typed_posts(raw))


@query(
    "q_src_typed_posts_c",
    """select * replace (nullif(author, '') as author, nullif(title, '') as title, 'c' as site, views + 1000 as views,
      concat(thread_id, '.', ordinal + 1) as uid, strftime(date_trunc('minute', date_time), '%Y-%m-%d %H:%M:%S') as date_time,
      coalesce(array_to_string(tags, ' '), '') as tags) from odd""",
    "posts",
    extra=ODD_SQL,
)
def src_typed_posts_c(t: Tables) -> DataFrame:
    """The layout of the site that writes dumps: month dates, a list of tags as text, commas in numbers, the
    question as post 1."""
    path = fresh_path(t.spark, "dump")
    posts = odd_posts(t)
    renumbered = posts.withColumns(
        {"views": F.col("views") + 1000, "uid": F.concat_ws(".", "thread_id", F.col("ordinal") + 1)}
    )
    fields = renumbered.select("*", F.date_format("date_time", "MMM d, yyyy h:mm a").alias("month_date"))
    listed = F.concat(F.lit("['"), F.array_join("tags", "', '"), F.lit("']"))
    shown = {
        "views": F.regexp_replace(F.col("views").cast("string"), "(?<=[0-9])(?=[0-9]{3}$)", ","),
        "tags": listed,
        "date_time": F.col("month_date"),
    }
    raw = fields.select(*[shown.get(n, F.col(n).cast("string")).alias(n) for n in DUMP_FIELDS])
    write_fields(raw, path)
    return flat(typed_posts(read_record_dump(t.spark, path).withColumn("site", F.lit("c")), question_number=1))


@query("q_sink_records_dump", DUMP_SQL.replace("from posts", "from odd"), "posts", extra=ODD_SQL)
def sink_records_dump(t: Tables) -> DataFrame:
    """What a written dump shows, its escapes undone."""
    path = fresh_path(t.spark, "dump")
    write_record_dump(odd_posts(t), path)
    return read_record_dump(t.spark, path)


@query("q_sink_jsonl", FLAT_SQL.format(site=""), "posts")
def sink_jsonl(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "jsonl")
    write_jsonl(t.posts(), path)
    return flat(read_jsonl(t.spark, path, POST))


@query("q_sink_posts", f"{TWO_SITES} union all {FLAT_SQL.format(site='')}", "posts")
def sink_posts(t: Tables) -> DataFrame:
    """Override, then append: the store holds both writes."""
    path = fresh_path(t.spark, "posts")
    write_posts(t.posts(), path, "override")
    write_posts(two_sites(t), path, "override")
    write_posts(t.posts(), path, "append")
    return flat(read_store(t.spark, path))


UPSERT_SQL = f"""select * replace (case when thread_id::int % 3 = 1 then upvotes + 1 else upvotes end as upvotes)
from ({FLAT_SQL.format(site='')})"""


@query("q_sink_posts_upsert", UPSERT_SQL, "posts")
def sink_posts_upsert(t: Tables) -> DataFrame:
    """A harvest run several times: half the threads, then all with changed votes, twice; an untouched thread stays."""
    store, thread = post_store(fresh_path(t.spark, "keyed-posts"), buckets=16), F.col("thread_id").cast("long")
    store.upsert(t.store.filter(thread % 3 != 2))
    changed = t.store.withColumn("upvotes", F.when(thread % 3 == 1, F.col("upvotes") + 1).otherwise(F.col("upvotes")))
    store.upsert(changed.filter(thread % 3 != 0))
    if store.upsert(changed):
        raise AssertionError("a batch that changes nothing was written")
    return flat(store.read(t.spark))


FREQ_SQL = "select stem, cast(sum(n) as bigint) n from stems group by stem"


def _freq_file(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "freq")
    write_freq(frequency(stems(token_counts(t.documents))), path)
    return read_freq(t.spark, path)


@query("q_sink_freq_csv", FREQ_SQL, extra=STEM_SQL)
def sink_freq_csv(t: Tables) -> DataFrame:
    return _freq_file(t)


@query("q_src_freq_csv", f"select stem, n from ({FREQ_SQL}) where n > 1", extra=STEM_SQL)
def src_freq_csv(t: Tables) -> DataFrame:
    return _freq_file(t).filter(F.col("n") > 1)


@query("q_sink_corpus_artifacts", "select token, n, stem from stems", extra=STEM_SQL)
def sink_corpus_artifacts(t: Tables) -> DataFrame:
    """Built by the first call, read by the second."""
    path = fresh_path(t.spark, "corpus")
    materialize(t.spark, path, lambda: stems(token_counts(t.documents)))
    return materialize(t.spark, path, lambda: t.documents.select(F.raise_error(F.lit("corpus is rebuilt"))))


@query("q_sink_corpus_artifacts_addressed", "select token, n, stem from stems", extra=STEM_SQL)
def sink_corpus_artifacts_addressed(t: Tables) -> DataFrame:
    """Built for half of the documents, then for all of them, which is another input; asked for again, it is read."""
    folder, docs = fresh_path(t.spark, "artifacts"), t.documents.select("doc_id", "text")

    def build(rows: DataFrame) -> DataFrame:
        return stems(token_counts(rows))

    def fail(rows: DataFrame) -> DataFrame:
        raise AssertionError("corpus is rebuilt")

    materialize_for(t.spark, folder, docs.filter(F.col("doc_id") % 2 == 0), "stems-1", build)
    materialize_for(t.spark, folder, docs, "stems-1", build)
    return materialize_for(t.spark, folder, docs, "stems-1", fail)


FILE_SQL = """select * exclude (site, thread_id, ordinal, is_first) replace (
  case when is_first then resolved else '' end as resolved,
  case when is_first then question_uid else '' end as question_uid)
from (select *, ordinal = min(ordinal) over (partition by site, thread_id) is_first from features)"""


@query("q_sink_features_csv", FILE_SQL, "posts", extra=FEATURE_SQL)
def sink_features_csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "features")
    table = features(t.store)
    write_features(table, path)
    file_schema = table.select(*[F.col(f"`{c}`") for c in FEATURES]).schema
    return read_features(t.spark, path, file_schema)
