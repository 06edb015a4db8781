"""Operator 1: line dedup over content-defined chunks of lines.

A text is its lines, split at line feeds. A rolling hash runs over the hashes of ``WINDOW`` = 2 neighbouring
lines; a chunk ends after a line whose rolling hash is a local minimum (below the one before, not above the
one after). Whether a line ends a chunk depends on four lines only, so that an insertion moves no boundary
elsewhere, and two boundaries are never neighbours: every chunk of a text of two lines or more has at least
two lines. A chunk whose bytes occur more than once in the whole table stays at its first place (smallest
doc_id, then position) and is removed everywhere else.

Main path: DataFrame functions only. Hashes travel first (16 bytes a chunk); only texts with a chunk whose
hash repeats give their repeated chunks to the byte comparison. Texts are shuffled by document, never by
chunk, and the counts are combined before the shuffle, so a chunk in a third of all documents is one row a
task.

Defined results: a null text stays null; an empty text and a text of one line have no chunk of two lines and
stay as they are; a chunk without a non-blank line is left in place; rows that repeat a doc_id and text are
treated alike (each keeps what the first keeps); a null doc_id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import fresh, let, quoted
from threadlens.session import stage

WINDOW = 2
# Fixed values of the rolling hash: base and modulus; line hashes are below 2**32, so products fit a long.
BASE, MODULUS = 1_000_003, 4_294_967_291


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def rolling(hashes: Column) -> Column:
    """Rolling hash at each line: of it and the line before (0 before the first)."""
    before = F.slice(F.concat(F.array(F.lit(0).cast("long")), hashes), F.lit(1), F.size(hashes))
    return F.zip_with(before, hashes, lambda p, h: (p * F.lit(BASE) + h) % F.lit(MODULUS))


def chunks(text: Column) -> Column:
    """Array of chunks, each the array of its lines. Joined with line feeds they are the text again."""

    def cut(lines: Column) -> Column:
        n = F.size(lines)

        def at(r: Column) -> Column:
            inner = F.when(n > 3, F.sequence(F.lit(2), n - 2)).otherwise(F.array().cast("array<int>"))
            ends = F.filter(
                inner,
                lambda i: (F.element_at(r, i) < F.element_at(r, i - 1)) & (F.element_at(r, i) <= F.element_at(r, i + 1)),
            )
            return let(
                ends,
                lambda e: F.zip_with(
                    F.concat(F.array(F.lit(1)), F.transform(e, lambda i: i + 1)),
                    F.concat(e, F.array(n)),
                    lambda first, last: F.slice(lines, first, last - first + 1),
                ),
            )

        return let(rolling(F.transform(lines, line_hash)), at)

    return let(F.split(text, "\n"), cut)


def _repeatable(chunk: Column) -> Column:
    return (F.size(chunk) > 1) & F.exists(chunk, lambda line: F.trim(line) != "")


def _joined(chunk: Column) -> Column:
    return F.array_join(chunk, "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks removed from ``text_col``, and behind its columns ``n_lines`` and
    ``n_removed`` (lines; under other names where ``docs`` has these)."""
    text = quoted(text_col)
    several = docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where(
        F.instr("text", "\n") > 0
    )
    listed = several.select(
        "id",
        "th",
        F.posexplode(F.transform(chunks(F.col("text")), lambda c: F.when(_repeatable(c), F.xxhash64(_joined(c))))).alias("no", "h"),
    )
    hashes = stage(listed.where(F.col("h").isNotNull()), "chunk-hashes")
    # written, so that the join reads both sides from exchanges of their own, which can be split where a hash is hot
    repeated = stage(hashes.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h"), "repeated-hashes")
    marks = hashes.join(repeated, "h").groupBy("id", "th").agg(F.collect_set("no").alias("marks"))

    # byte comparison of the chunks whose hash repeats
    owner = [F.col("d.id").eqNullSafe(F.col("m.id")), F.col("d.th") == F.col("m.th")]
    held = several.alias("d").join(marks.alias("m"), owner).select("d.id", "d.th", "marks", "text")
    wanted = let(
        chunks(F.col("text")),
        lambda cs: F.transform(
            F.col("marks"), lambda no: F.struct(no.alias("no"), _joined(F.element_at(cs, no + 1)).alias("chunk"))
        ),
    )
    same = stage(
        held.select("id", "th", F.explode(wanted).alias("c")).select("id", "th", "c.no", "c.chunk"), "repeated-chunks"
    ).withColumn("h", F.xxhash64("chunk"))
    place = F.struct("id", "th", "no")
    first = stage(same.groupBy("h", "chunk").agg(F.min(place).alias("first")), "first-places")
    gone = same.join(first, ["h", "chunk"]).where(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "th").agg(F.collect_set("no").alias("gone"))

    th, gid, gth, cut, done, n_lines, n_removed = fresh(docs, "th", "gone_id", "gone_th", "gone", "done", "n_lines", "n_removed")
    joined = docs.withColumn(th, F.xxhash64(text)).join(
        gone.toDF(gid, gth, cut), quoted(id_col).eqNullSafe(F.col(gid)) & (F.col(th) == F.col(gth)), "left"
    )

    def without(cs: Column) -> Column:
        stay = F.filter(cs, lambda c, i: ~F.array_contains(F.col(cut), i))
        taken = F.transform(F.col(cut), lambda no: F.size(F.element_at(cs, no + 1)))
        return F.struct(
            F.array_join(F.flatten(stay), "\n").alias("text"), F.aggregate(taken, F.lit(0), lambda a, b: a + b).alias("lines")
        )

    judged = joined.withColumn(done, F.when(F.col(cut).isNotNull(), let(chunks(text), without)))
    left = F.when(F.col(cut).isNull(), text).otherwise(F.col(done)["text"])
    return judged.select(
        *[(left if c == text_col else quoted(c)).alias(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias(n_lines),
        F.coalesce(F.col(done)["lines"], F.lit(0)).alias(n_removed),
    )


# The same rule in SQL; (doc_id, text) is unique there.
SQL = f"""
with lines as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents
), hashed as (
  select *, list_transform(ls, lambda l: ('0x' || substr(md5(l), 1, 8))::bigint) as h from lines
), rolled as (
  select *, list_transform(range(1, len(h) + 1), lambda i: ((case when i = 1 then 0 else h[i - 1] end) * {BASE} + h[i]) % {MODULUS}) as r
  from hashed
), ended as (
  select *, list_concat(list_filter(range(2, len(ls) - 1), lambda i: r[i] < r[i - 1] and r[i] <= r[i + 1]), [len(ls)]) as ends from rolled
), chunk as (
  select doc_id, no, ls[(case when no = 1 then 1 else ends[no - 1] + 1 end):ends[no]] as c
  from (select doc_id, ls, ends, unnest(range(1, len(ends) + 1)) as no from ended)
), placed as (
  select *, array_to_string(c, chr(10)) as body, len(c) > 1 and len(list_filter(c, lambda l: trim(l) <> '')) > 0 as repeatable from chunk
), judged as (
  select *, repeatable and row_number() over (partition by body, repeatable order by doc_id, no) > 1 as gone from placed
)
select d.doc_id,
  case when d.text is null then null else coalesce(string_agg(j.body, chr(10) order by j.no) filter (where not j.gone), '') end as text,
  coalesce(sum(len(j.c)), 0)::int as n_lines,
  coalesce(sum(len(j.c)) filter (where j.gone), 0)::int as n_removed
from documents d left join judged j on d.doc_id = j.doc_id
group by d.doc_id, d.text
"""
