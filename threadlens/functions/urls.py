"""Links of a page and their full addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r'href="([^"]*)"'
PAGE = r"^([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#]*)([^?#]*)(\?[^#]*)?"
FORUM = "https://forum.example.org/topic/"


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def _tidy_path(path: Column) -> Column:
    """Resolve '.' and '..' segments."""

    def step(kept: Column, segment: Column) -> Column:
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return (
            F.when(segment == "..", parent).when(segment == ".", kept).otherwise(F.array_append(kept, segment))
        )

    segments = F.split(path, "/")
    # a path that ends in '.' or '..' names a folder
    closed = F.when(path.rlike(r"/\.\.?$"), F.array_append(segments, F.lit(""))).otherwise(segments)
    rest = F.slice(closed, F.lit(2), F.greatest(F.size(closed) - 1, F.lit(0)))
    folded = F.array_join(F.aggregate(rest, F.array(F.lit("")), step), "/")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), folded).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Full address of ``href`` found on page ``base``."""
    scheme, host, path, query = (F.regexp_extract(base, PAGE, i) for i in (1, 2, 3, 4))
    site = F.concat(scheme, F.lit("//"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*/)", 1))
    ref_path = F.regexp_extract(href, "^[^?#]*", 0)
    tail = F.substring(href, F.length(ref_path) + 1, F.length(href))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, _tidy_path(ref_path), tail))
        .when(href == "", F.concat(site, path, query))
        .when(href.startswith("?"), F.concat(site, path, href))
        .when(href.startswith("#"), F.concat(site, path, query, href))
        .otherwise(F.concat(site, _tidy_path(F.concat(folder, ref_path)), tail))
    )


def thread_from_url(url: Column) -> Column:
    """What names the thread: the address without site, query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def topic_name(path: Column) -> Column:
    """Topic from a file name such as 'Topic/Computer-Programming.txt'."""
    return F.regexp_replace(path, r"[\\/]|Topic|\.txt", "")


def seed_url(topic_file: Column, prefix: str = FORUM) -> Column:
    return F.concat(F.lit(prefix), topic_name(topic_file), F.lit("/all_questions"))


def topic_from_url(url: Column, prefix: str = FORUM) -> Column:
    return F.replace(F.replace(url, F.lit(prefix), F.lit("")), F.lit("/organize"), F.lit(""))
