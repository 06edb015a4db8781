"""The text record dump and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.values import tags_pack
from threadlens.schema import DUMP_FIELDS, STORE_DATE

# One record ends with " }" and a line break.
RECORD_END = " }\n"
FIELD_MARK = r"',\s(?:" + "|".join(DUMP_FIELDS[1:]) + r"):\s'"
FIRST_MARK = rf"(?s)^[\s\[\]]*\{{\s{DUMP_FIELDS[0]}:\s'"
# What stands between the records of two pages.
PAGE_MARKS = r"^[\s\[\]]*$"

# What a value may not hold as it is, and how it is written; undone from the last to the first.
ESCAPES = (("&", "&amp;"), ("'", "&#39;"), ("\n", "&#10;"), ("\r", "&#13;"))


def escaped(value: Column) -> Column:
    for plain, written in ESCAPES:
        value = F.replace(value, F.lit(plain), F.lit(written))
    return value


def unescaped(value: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        value = F.replace(value, F.lit(written), F.lit(plain))
    return value


def dump_fields(posts: DataFrame) -> DataFrame:
    """The twelve fields as text, the way the dump shows them."""

    def shown(name: str) -> Column:
        if name == "date_time":
            return F.date_format("date_time", STORE_DATE)
        if name == "tags":
            return tags_pack(F.col("tags"))
        return F.col(name).cast("string")

    return posts.select(*[F.coalesce(shown(n), F.lit("null")).alias(n) for n in DUMP_FIELDS])


def write_fields(fields: DataFrame, path: str, names: Sequence[str] = DUMP_FIELDS) -> None:
    """One record a row and line. Quotes and line breaks within values are escaped, so that no value can end
    its field or record."""
    body = [F.concat(F.lit(f"{n}: '"), escaped(F.coalesce(F.col(n), F.lit("null"))), F.lit("'")) for n in names]
    record = F.concat(F.lit("{ "), F.concat_ws(", ", *body))
    fields.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def write_record_dump(posts: DataFrame, path: str) -> None:
    write_fields(dump_fields(posts), path)


def read_record_dump(spark: SparkSession, path: str, escapes: bool = True, strict: bool = True) -> DataFrame:
    """Records of a dump, field by field; page marks between records are skipped.

    ``escapes=False`` reads dumps of other writers, whose values stand as they are. A record that cannot be
    read raises; with ``strict=False`` it comes back with all fields NULL but ``text``, which holds the record, so that it
    can be counted.
    """
    records = spark.read.option("lineSep", RECORD_END).text(path).filter(~F.col("value").rlike(PAGE_MARKS))
    # cut once: the last field keeps whatever looks like a mark within the text
    cut = F.split(F.regexp_replace("value", FIRST_MARK, ""), FIELD_MARK, len(DUMP_FIELDS))
    parts = records.select("value", F.when(F.col("value").rlike(FIRST_MARK), cut).alias("cut"))
    whole = (F.size("cut") == len(DUMP_FIELDS)) & F.col("value").endswith("'")
    if strict:
        failed = F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 200))).cast("string")
        first = F.when(F.coalesce(whole, F.lit(False)), F.get("cut", F.lit(0))).otherwise(failed)
        text = F.get("cut", F.lit(len(DUMP_FIELDS) - 1))
    else:
        whole = F.coalesce(whole, F.lit(False))
        first = F.when(whole, F.get("cut", F.lit(0)))
        text = F.when(whole, F.get("cut", F.lit(len(DUMP_FIELDS) - 1))).otherwise(F.concat("value", F.lit("'")))
    middle = [F.when(whole, F.get("cut", F.lit(i))) for i in range(1, len(DUMP_FIELDS) - 1)]
    fields = [first, *middle, F.substring(text, F.lit(1), F.length(text) - 1)]
    back = unescaped if escapes else (lambda c: c)
    return parts.select(*[back(c).alias(n) for c, n in zip(fields, DUMP_FIELDS, strict=True)])


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per row; what was there is replaced."""
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
