"""Post stores, the URL frontier and topic lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.values import month_date, stored_date, tags_unpack
from threadlens.schema import FRONTIER, POST, SENTINELS, no_sentinel


def read_posts(spark: SparkSession, stores: dict[str, str], only: str | None = None) -> DataFrame:
    """Several named stores as one table; ``only`` reads a single one (the others are not opened)."""
    if only not in (None, "all"):
        stores = {only: stores[only]}
    out = None
    for site, path in stores.items():
        store = spark.read.schema(POST).parquet(path).withColumn("site", F.lit(site)).select(*POST.fieldNames())
        out = store if out is None else out.unionByName(store)
    return out


def read_store(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """A store written by ``write_posts``: one folder per site, so a site filter prunes folders."""
    posts = spark.read.schema(POST).parquet(path).select(*POST.fieldNames())
    return posts if site in (None, "all") else posts.filter(F.col("site") == site)


def write_posts(posts: DataFrame, path: str, mode: str = "append") -> None:
    """``mode='append'`` keeps what is there, ``'override'`` starts afresh."""
    spark_mode = {"append": "append", "override": "overwrite"}[mode]
    posts.select(*POST.fieldNames()).write.mode(spark_mode).partitionBy("site").parquet(path)


def tag_list(raw: Column) -> Column:
    """Tags of a text: '<a> <b c> ', "['a', 'b c']" (a list written as text), or words between blanks."""
    quoted = F.transform(
        F.regexp_extract_all(raw, F.lit("'[^']*'|\"[^\"]*\""), F.lit(0)), lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    )
    tags = F.when(raw.startswith("<"), tags_unpack(raw)).when(raw.startswith("["), quoted).otherwise(F.split(raw, " "))
    return F.filter(tags, lambda t: ~t.isin(*SENTINELS))


def number(raw: Column) -> Column:
    """'1,234' and '1234' as 1234; NULL where there is no number."""
    return F.replace(no_sentinel(raw), F.lit(","), F.lit("")).try_cast("long")


def typed_posts(raw: DataFrame, question_number: int = 0) -> DataFrame:
    """Text fields as harvested -> the typed post record; sentinels become NULL.

    '<thread>' and '<thread>.<n>' name the posts of a thread. Two sites number answers from 1 and leave the
    question without a number; one (``question_number=1``) numbers the question 1 and answers from 2. Dates
    are stored ones or like 'Feb 3, 2016 4:05 PM'.
    """

    def text(name: str) -> Column:
        return no_sentinel(F.col(name))

    uid = F.col("uid")
    given = F.nullif(F.regexp_extract(uid, r"\.([0-9]+)$", 1), F.lit("")).try_cast("int")
    return raw.select(
        F.col("site"),
        uid,
        F.lower("type").alias("type"),
        text("author").alias("author"),
        text("title").alias("title"),
        F.col("text"),
        F.coalesce(stored_date(F.col("date_time")), month_date(F.col("date_time"))).alias("date_time"),
        tag_list(F.col("tags")).alias("tags"),
        number(F.col("views")).alias("views"),
        number(F.col("answers")).try_cast("int").alias("answers"),
        F.col("resolve"),
        number(F.col("upvotes")).alias("upvotes"),
        F.col("url"),
        F.regexp_extract(uid, r"^([^.]*)", 1).alias("thread_id"),
        F.coalesce(given - question_number, F.lit(0)).alias("ordinal"),
    ).select(*POST.fieldNames())


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """Harvested (url, date) rows; an empty frontier is an error."""
    frontier = spark.read.schema(FRONTIER).parquet(path)
    if frontier.isEmpty():
        raise ValueError(f"URL frontier is empty: {path}")
    return frontier


def read_topics(spark: SparkSession, pattern: str) -> DataFrame:
    """Distinct lines of all topic files."""
    return spark.read.text(pattern).select(F.col("value").alias("topic")).distinct()


def ascii_topic(topic: Column) -> Column:
    return F.regexp_replace(topic, r"[^\x00-\x7F]", "")


def write_topics(df: DataFrame, path: str) -> None:
    df.select(ascii_topic(F.col("topic")).alias("value")).distinct().write.text(path)
