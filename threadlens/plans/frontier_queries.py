"""Queries over the URL frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.urls import resolve_url, seed_url, topic_from_url
from threadlens.functions.values import age_text
from threadlens.operators import frontier as fr
from threadlens.operators.closure import chain, closure, extend_closure
from threadlens.plans.bridges import Tables
from threadlens.plans.registry import query
from threadlens.session import fresh_path


@query("q_fr_dedup_last", "select url, arg_max(date, seq) date, arg_max(origin, seq) origin from frontier group by url", "frontier")
def dedup_last(t: Tables) -> DataFrame:
    return fr.dedup_last(t.frontier(), "url", "seq").drop("seq")


@query("q_fr_merge_frontier", "select url, arg_max(date, seq) date, max(seq) seq, arg_max(origin, seq) origin from frontier group by url", "frontier")
def merge_frontier(t: Tables) -> DataFrame:
    """Three sessions into a kept frontier, the newest before an older one; the last of them again changes nothing."""
    store, session = fr.frontier_store(fresh_path(t.spark, "kept-frontier"), buckets=16), F.col("seq") % 3
    for i in (0, 2, 1):
        fr.merge_frontier(store, t.frontier().filter(session == i))
    if fr.merge_frontier(store, t.frontier()):
        raise AssertionError("sightings that change nothing were written")
    return store.read(t.spark)


LINKS_SQL = """links as (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) href from pages)"""


@query("q_fr_dedup_set", "select distinct page_id, href from links", extra=LINKS_SQL)
def dedup_set(t: Tables) -> DataFrame:
    return fr.dedup_set(fr.page_links(t.pages), ["page_id", "href"])


@query(
    "q_fr_session_counts",
    """select count(*) filter (origin = 'view') urls_before, count(*) urls_after, count(distinct url) urls_distinct
    from frontier""",
    "frontier",
)
def session_counts(t: Tables) -> DataFrame:
    earlier = F.col("origin") == "view"
    return fr.session_counts(t.frontier().filter(earlier), t.frontier().filter(~earlier))


@query("q_fr_age_text", "select event_id, nullif(regexp_extract(caption, '([0-9]+ \\w+ ago)$', 1), '') age from ages", "ages")
def ages(t: Tables) -> DataFrame:
    return t.ages().select("event_id", age_text(F.col("caption")).alias("age"))


@query("q_fr_category_gate", "select page_id, url from listing where position('Design' in category) > 0", "listing")
def category_gate(t: Tables) -> DataFrame:
    return t.listing().filter(fr.category_gate(F.col("category"))).select("page_id", "url")


NAV = "(?s)<a href=\"[^\"]*\">([^<]*)</a>"


@query(
    "q_fr_link_text_gate",
    f"""select page_id, url from pages where list_contains(regexp_extract_all(html, '{NAV}', 1),
      (select max(x) from (select unnest(regexp_extract_all(html, '{NAV}', 1)) x from pages)))""",
)
def link_text_gate(t: Tables) -> DataFrame:
    """Pages that have the alphabetically last link text of all pages."""
    texts = t.pages.withColumn("texts", F.regexp_extract_all("html", F.lit(NAV), F.lit(1)))
    wanted = texts.select(F.explode("texts").alias("x")).agg(F.max("x")).scalar()
    return fr.link_text_gate(texts, "texts", wanted).select("page_id", "url")


@query("q_fr_listing_filter", "select * from listing where icon in ('question', 'correct') and author_linked", "listing")
def listing_filter(t: Tables) -> DataFrame:
    return fr.listing_filter(t.listing())


@query("q_fr_links", "select page_id, href, count(*) n from links group by page_id, href", extra=LINKS_SQL)
def links(t: Tables) -> DataFrame:
    return fr.page_links(t.pages).groupBy("page_id", "href").agg(F.count("*").alias("n"))


# Link forms made from real links: root, absolute, other host, relative, query, fragment, parent, this page.
HREF_SQL = (
    LINKS_SQL
    + """,
forms as (select page_id, url, case page_id % 8 when 0 then href when 1 then concat('https://x.example', href)
  when 2 then concat('//cdn.example.org', href) when 3 then substr(href, 2) when 4 then concat('?q=', substr(href, 2))
  when 5 then concat('#', substr(href, 2)) when 6 then concat('../', substr(href, 2)) else '' end href,
  regexp_extract(url, '^([a-z]+:)//', 1) scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '(\\?[^#]*)', 1) q from links)"""
)


@query(
    "q_fr_urljoin",
    """select distinct page_id, href, case page_id % 8 when 0 then concat(scheme, '//', host, href) when 1 then href
      when 2 then concat(scheme, href) when 3 then concat(scheme, '//', host, regexp_extract(path, '^(.*/)', 1), href)
      when 4 then concat(scheme, '//', host, path, href) when 5 then concat(scheme, '//', host, path, q, href)
      when 6 then concat(scheme, '//', host, regexp_replace(regexp_extract(path, '^(.*/)', 1), '[^/]*/$', ''), substr(href, 4))
      else concat(scheme, '//', host, path, q) end target from forms""",
    extra=HREF_SQL,
)
def urljoin(t: Tables) -> DataFrame:
    href, rest, kind = F.col("href"), F.substring(F.col("href"), F.lit(2), F.length("href")), F.col("page_id") % 8
    form = (
        F.when(kind == 0, href)
        .when(kind == 1, F.concat(F.lit("https://x.example"), href))
        .when(kind == 2, F.concat(F.lit("//cdn.example.org"), href))
        .when(kind == 3, rest)
        .when(kind == 4, F.concat(F.lit("?q="), rest))
        .when(kind == 5, F.concat(F.lit("#"), rest))
        .when(kind == 6, F.concat(F.lit("../"), rest))
        .otherwise("")
    )
    formed = fr.page_links(t.pages).select("page_id", "url", form.alias("href"))
    return formed.select("page_id", "href", resolve_url(F.col("url"), F.col("href")).alias("target")).distinct()


@query(
    "q_fr_seed_urls",
    """select topic, concat('https://forum.example.org/topic/', topic, '/all_questions') seed, topic as from_url from topics""",
    "topics",
)
def seed_urls(t: Tables) -> DataFrame:
    topic_file = F.concat(F.lit("Topic/"), F.col("topic"), F.lit(".txt"))
    organize = F.concat(F.lit("https://forum.example.org/topic/"), F.col("topic"), F.lit("/organize"))
    return t.topics().select(
        "topic", seed_url(topic_file).alias("seed"), topic_from_url(organize).alias("from_url")
    )


def reach_sql(kind: str) -> str:
    return f"""
gated as (select distinct e.src, e.dst from edges e join english a on e.src = a.node join english b on e.dst = b.node
  where kind = '{kind}'),
reach(node, depth) as (select node, cast(0 as bigint) from english where feed
  union select g.dst, r.depth + 1 from reach r join gated g on r.node = g.src
  where r.depth < (select count(*) from english))"""


REACH = "select node, min(depth) depth from reach group by node"


def seeds(t: Tables) -> DataFrame:
    """Pages found through the feed."""
    return t.english().filter("feed")


@query("q_fr_related_closure", REACH, "edges", extra=reach_sql("related"), recursive=True)
def related_closure(t: Tables) -> DataFrame:
    related = t.edges().filter(F.col("kind") == "related")
    return closure(seeds(t), related, t.english()).withColumn("depth", F.col("depth").cast("long"))


@query("q_fr_related_closure_extended", REACH, "edges", extra=reach_sql("related"), recursive=True)
def related_closure_extended(t: Tables) -> DataFrame:
    """The closure of the links from even pages and of the first half of the seeds, extended by the others."""
    related, start = t.edges().filter(F.col("kind") == "related"), seeds(t)
    early_edges, early_seeds = F.col("src") % 2 == 0, F.col("node") % 4 < 2
    known = closure(start.filter(early_seeds), related.filter(early_edges), t.english())
    return extend_closure(
        known, related.filter(early_edges), related.filter(~early_edges), t.english(), start.filter(~early_seeds)
    )


@query("q_fr_next_chain", REACH, "edges", extra=reach_sql("next"), recursive=True)
def next_chain(t: Tables) -> DataFrame:
    return chain(seeds(t), t.edges().filter(F.col("kind") == "next"), t.english())


@query(
    "q_fr_union_sightings",
    """select seq, url, date, origin from frontier union all
       select page_id, url, 'not available', 'link' from pages""",
    "frontier",
)
def union_sightings(t: Tables) -> DataFrame:
    from_links = t.pages.select(F.col("page_id").alias("seq"), "url", F.lit("link").alias("origin"))
    users = t.frontier().filter(F.col("origin") == "view")
    category = t.frontier().filter(F.col("origin") != "view")
    return fr.union_sightings(users, category, from_links)
