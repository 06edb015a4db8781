"""The post record: one typed shape for questions and answers of every site."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("date_time", T.TimestampType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("views", T.LongType()),
        T.StructField("answers", T.IntegerType()),
        T.StructField("resolve", T.StringType()),
        T.StructField("upvotes", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
    ]
)

FRONTIER = T.StructType([T.StructField("url", T.StringType()), T.StructField("date", T.StringType())])

# A sighting of a URL, numbered in the order of sightings.
SIGHTING = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("origin", T.StringType()),
    ]
)

# A thread is named by these two columns everywhere.
THREAD = ("site", "thread_id")
POST_KEY = ("site", "thread_id", "uid")

# Field names of the text record dump, in dump order.
DUMP_FIELDS = (
    "url", "uid", "type", "author", "title", "date_time", "tags", "views", "answers", "resolve", "upvotes", "text",
)

# What the three sites write where they have nothing to say.
SENTINELS = ("", "N/A", "null", "---", "not available", "0000-00-00 00:00:00")

# Date layouts of stored posts.
STORE_DATE = "yyyy-MM-dd HH:mm:ss"


def no_sentinel(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*SENTINELS), c)


def is_question() -> Column:
    """Stored posts carry the type in lower case, so the filter reaches the file scan."""
    return F.col("type") == "question"


def is_answer() -> Column:
    return F.col("type") != "question"
