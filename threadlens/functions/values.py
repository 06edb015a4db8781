"""Counts, dates, ages, names and tags found in captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.schema import no_sentinel

NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)(k?)"

# Words cut off a caption before its date is read.
DATE_PREFIXES = r"Last asked: |Written |Updated |·|by .*? on "
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
MONTH_DATE = rf"(?:{MONTHS}) [0-9]{{1,2}}, [0-9]{{4}} [0-9]{{1,2}}:[0-9]{{2}} (?:AM|PM)"
AGE = r"([0-9]+) (second|minute|hour|day|week|month|year)s? ago"


def parse_count(caption: Column, label: str = "") -> Column:
    """'1.2k Views' -> 1200, '1,234 Views' -> 1234, anything else -> 0. ``label`` is the word after the number."""
    pattern = f"{NUMBER} {label}" if label else f"^{NUMBER}$"
    number = F.replace(F.regexp_extract(caption, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    scale = F.when(F.regexp_extract(caption, pattern, 2) == "k", 1000).otherwise(1)
    return F.coalesce((number * scale).cast("long"), F.lit(0))


def strip_label(caption: Column, label: str = "Views") -> Column:
    return F.replace(caption, F.lit(f" {label}"), F.lit(""))


def parse_answer_count(caption: Column) -> Column:
    return F.coalesce(F.regexp_extract(caption, "([0-9]+) answers?", 1).try_cast("int"), F.lit(0))


def age_text(caption: Column) -> Column:
    """Trailing '3 days ago' of a caption, NULL if there is none."""
    return F.nullif(F.regexp_extract(caption, r"([0-9]+ \w+ ago)$", 1), F.lit(""))


def clean_date(caption: Column) -> Column:
    return F.trim(F.regexp_replace(caption, DATE_PREFIXES, ""))


def resolve_age(age: Column, anchor: Column) -> Column:
    """'3 years ago' seen from ``anchor``; NULL where the text is not an age."""
    n = F.regexp_extract(age, AGE, 1).try_cast("int")
    unit = F.regexp_extract(age, AGE, 2)

    def of(name: str) -> Column:
        return F.when(unit == name, n).otherwise(0)

    span = F.make_interval(
        of("year"), of("month"), of("week"), of("day"), of("hour"), of("minute"), of("second")
    )
    return F.when(n.isNotNull(), anchor - span)


def month_date(header: Column) -> Column:
    """Last 'Feb 3, 2016 4:05 PM' of a header."""
    found = F.regexp_extract_all(header, F.lit(MONTH_DATE), F.lit(0))
    return F.try_to_timestamp(F.try_element_at(found, F.lit(-1)), F.lit("MMM d, yyyy h:mm a"))


def line_date(header: Column, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The text after the first line break, read as a date."""
    rest = F.when(F.instr(header, "\n") > 0, F.regexp_replace(header, r"(?s)^[^\n]*\n", ""))
    return F.try_to_timestamp(rest, F.lit(layout))


def header_date(header: Column) -> Column:
    """Month date, else the second line, else NULL."""
    return F.coalesce(month_date(header), line_date(header))


def stored_date(text: Column) -> Column:
    return F.try_to_timestamp(no_sentinel(text), F.lit("yyyy-MM-dd HH:mm:ss"))


def default_author(name: Column, fallback: str = "anonymous") -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(fallback))


def first_nonempty(*choices: Column, fallback: Column | None = None) -> Column:
    picks = [F.nullif(c, F.lit("")) for c in choices]
    return F.coalesce(*picks, *([] if fallback is None else [fallback]))


def tags_pack(tags: Column) -> Column:
    """['a', 'b'] -> '<a> <b> '."""
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<"), t, F.lit("> "))), "")


def tags_unpack(packed: Column) -> Column:
    return F.regexp_extract_all(packed, F.lit("<([^<>]*)> "), F.lit(1))


def pick_block(blocks: Column, i: Column, answered: Column) -> Column:
    """Content block of post ``i`` (0 = question). On answered threads the solution is shown again before the
    answers, so they sit one block further on."""
    return F.try_element_at(blocks, (i + 1 + F.when(answered & (i > 0), 1).otherwise(0)).cast("int"))
