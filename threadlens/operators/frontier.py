"""URL frontier: sightings, dedup, gates and links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.urls import links, resolve_url
from threadlens.schema import SIGHTING
from threadlens.sources.keyed import KeyedStore

# Fixed value: the category word that pages are kept for.
CATEGORY_WORDS = ("Design",)
UNKNOWN_DATE = "not available"


def dedup_last(df: DataFrame, key: Sequence[str] | str, order: str) -> DataFrame:
    """One row per key, the last sighting wins. An aggregate, so repeats collapse before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def dedup_set(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def session_counts(before: DataFrame, found: DataFrame) -> DataFrame:
    """Rows before a session, after it, and after dedup, in one pass over both."""
    both = before.select("url", F.lit(1).alias("_old")).unionByName(found.select("url", F.lit(0).alias("_old")))
    per_url = both.groupBy("url").agg(F.sum("_old").alias("_old"), F.count("*").alias("_all"))
    return per_url.agg(
        F.coalesce(F.sum("_old"), F.lit(0)).alias("urls_before"),
        F.coalesce(F.sum("_all"), F.lit(0)).alias("urls_after"),
        F.count("*").alias("urls_distinct"),
    )


def category_gate(category: Column, keywords: Sequence[str] = CATEGORY_WORDS, every: bool = False) -> Column:
    gate = F.lit(every)
    for word in keywords:
        hit = F.contains(category, F.lit(word))
        gate = (gate & hit) if every else (gate | hit)
    return gate


def link_text_gate(df: DataFrame, texts: str, wanted: str) -> DataFrame:
    return df.filter(F.array_contains(F.col(texts), wanted))


def listing_filter(df: DataFrame) -> DataFrame:
    """Listing rows of questions or answered questions whose author is linked."""
    return df.filter(F.col("icon").isin("question", "correct") & F.col("author_linked"))


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link, in page order, with its full address."""
    found = pages.select("page_id", "url", F.posexplode(links(F.col("html"))).alias("pos", "href"))
    return found.withColumn("target", resolve_url(F.col("url"), F.col("href")))


def frontier_store(path: str, buckets: int = 64) -> KeyedStore:
    """A frontier that is kept: one row a URL."""
    return KeyedStore(path, SIGHTING, ("url",), buckets)


def merge_frontier(store: KeyedStore, sightings: DataFrame) -> int:
    """Merge new ``sightings`` (url, date, seq, origin) into a stored frontier: of each URL the last sighting stays, whichever
    session brings it. Gives the number of buckets that changed."""
    return store.upsert(sightings, order="seq", newest="seq")


def union_sightings(*sightings: DataFrame) -> DataFrame:
    """Sightings of several origins as one (seq, url, date, origin) table; a missing date is 'not available'."""
    shaped = [
        s.withColumn("date", F.coalesce(F.col("date"), F.lit(UNKNOWN_DATE)) if "date" in s.columns else F.lit(UNKNOWN_DATE))
        .select("seq", "url", "date", "origin")
        for s in sightings
    ]
    out = shaped[0]
    for s in shaped[1:]:
        out = out.unionByName(s)
    return out
