"""Operator 5: SimHash near-dedup by anchor-point covering.

Fingerprint: texts are lower-cased (A-Z), cut into words at blanks (space, tab to carriage return), and
every three neighbouring words, joined by one space, are hashed with XXH64 (seed 42); a bit is 1 if it is set
in over half the hashes, repeats included. A text of fewer words has one shingle, the whole sequence; a null
text or one without words has fingerprint zero, which is linked like any other.

Links: fingerprints that differ in at most three bits. Two such fingerprints differ in at most one bit of one
32-bit half, hence of the 31 bits kept of it. The 2**26 words of the Hamming code of length 31 are the anchors
of a half; each word of 31 bits lies within covering radius 1 of one of them. A fingerprint goes to every
anchor within covering radius plus threshold, 1 + 1 (one anchor for a code word, else 16), and meets there the
fingerprints whose nearest anchor it is. No link is missed, and of 2**26 anchors a half, few are shared by
chance.

Only distinct fingerprints are compared, so exact copies cost one row, and links are pairs of different
fingerprints. The join on the anchor is a plain equi-join, which adaptive execution splits where one anchor
is crowded.

Defined results: rows that repeat a doc_id have one row each; a null doc_id takes part but names no
component (a component of rows without doc_id only has a null component_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import arrow_columns, components, fresh, quoted
from threadlens.session import stage

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK = 65_536


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint of a text in UTF-8. Memory: the words and ``BLOCK`` hashes at once."""
    # of bytes, lower() and split() know ASCII letters and ASCII blanks only
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(len(words) - SHINGLE_WORDS + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(SHINGLE_WORDS, len(words)) - 1 :] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        some = [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    packed = np.packbits((counts * 2 > n).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row, fp as a signed long."""

    def start():
        return lambda texts: [pa.array([fingerprint(t) for t in texts.to_pylist()], pa.int64())]

    fp = T.StructType([T.StructField("fp", T.LongType())])
    return arrow_columns(docs, [id_col], [quoted(text_col).cast("binary")], fp, start).toDF("id", "fp")


def _parity_masks(bits: int = 31) -> list[int]:
    """Mask k has the bits whose position (from 1) has bit k: the parity checks of the Hamming code."""
    return [sum(1 << (p - 1) for p in range(1, bits + 1) if p >> k & 1) for k in range(bits.bit_length())]


def _syndrome(word: Column) -> Column:
    """0 for a code word, else the position (from 1) whose flip gives the nearest code word."""
    out = F.lit(0)
    for k, mask in enumerate(_parity_masks()):
        out = out + (F.bit_count(word.bitwiseAND(F.lit(mask))) % 2) * (1 << k)
    return out


def _halves(classes: DataFrame) -> DataFrame:
    """(fp, half, word, s): both 31-bit words of a fingerprint and their syndromes."""
    low, high = F.col("fp").bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned("fp", 33)
    cut = F.array(*[F.struct(F.lit(i).alias("half"), w.alias("word")) for i, w in enumerate((low, high))])
    return classes.select("fp", F.explode(cut).alias("w")).select("fp", "w.half", "w.word").withColumn("s", _syndrome(F.col("word")))


def anchors(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(half, anchor, home) and (half, anchor, guest): each fingerprint at its nearest anchor, and at every
    anchor within covering radius plus threshold."""
    halves = _halves(classes)
    nearest = F.expr("if(s = 0, word, word ^ shiftleft(1L, s - 1))")
    # two flips give a code word if their positions have the syndrome as exclusive or
    pairs = F.expr(
        "transform(filter(sequence(1, 31), i -> s > 0 and i < (i ^ s)), "
        "i -> word ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    )
    homes = halves.select("half", nearest.alias("anchor"), F.col("fp").alias("home"))
    guests = halves.select("half", F.explode(F.concat(F.array(nearest), pairs)).alias("anchor"), F.col("fp").alias("guest"))
    return homes, guests


def links(classes: DataFrame) -> DataFrame:
    """(a, b): different fingerprints of ``classes`` (distinct ``fp``) at ``MAX_BITS`` bits or fewer."""
    homes, guests = anchors(classes)
    near = (F.bit_count(F.col("home").bitwiseXOR(F.col("guest"))) <= MAX_BITS) & (F.col("home") != F.col("guest"))
    return homes.join(guests, ["half", "anchor"]).where(near).select(F.col("home").alias("a"), F.col("guest").alias("b"))


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fp (signed long), component_id."""
    marks = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(marks.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    linked = components(links(classes))
    grouped = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.withColumn("root", F.coalesce("component", "fp"))
    roots = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(grouped.select("fp", "root").join(roots, "root").select("fp", "component_id"), "fp").select(
        "id", "fp", "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (rows without doc_id last),
    then the smallest hash of its text. A row goes only if another row of its component stays."""
    th, node, mark = fresh(docs, "th", "kept_id", "kept_th")
    hashed = docs.withColumn(th, F.xxhash64(quoted(text_col)))
    key = F.struct(quoted(id_col).alias("id"), F.col(th).alias("th"))
    marks = stage(fingerprints(hashed.select(key.alias("key"), quoted(text_col).alias("text")), "key", "text"), "row-fingerprints")
    place = F.struct(F.col("id.id").isNull().alias("last"), F.col("id.id").alias("id"), F.col("id.th").alias("th"))
    classes = stage(marks.groupBy("fp").agg(F.min(place).alias("least")), "row-classes")
    grouped = classes.join(components(links(classes)).withColumnRenamed("node", "fp"), "fp", "left")
    heads = grouped.groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("least").alias("head"))
    heads = heads.select(F.col("head.id").alias(node), F.col("head.th").alias(mark))
    kept = hashed.join(heads, quoted(id_col).eqNullSafe(F.col(node)) & (F.col(th) == F.col(mark)))
    return kept.dropDuplicates([id_col, th]).select(*[quoted(c) for c in docs.columns])


def hex16(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
