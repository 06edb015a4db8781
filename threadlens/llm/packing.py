"""Operator 3: variable-capacity best-fit packing.

Documents are packed into sequences of several permitted lengths (``SIZES``, in tokens). Best-fit decreasing:
lengths are placed from the largest down, each piece into the open sequence with the least room that holds
it. Where none does, sequences of one size are opened: the size with the least cost for each token that it is
expected to hold, namely the pieces of this length and what the shorter pieces still to come can fill of the
rest. At the end each sequence is cut down to the smallest permitted length that holds its contents, and the
cost of that length is what counts (``cost``: length plus a constant for each sequence).

Pieces of one length are interchangeable, so the whole plan follows from the histogram of lengths, which has
at most max(``SIZES``) rows for any number of documents. Only the histogram comes to the driver; sequences are
planned in bulk as ranges of numbers, and a piece finds its sequence from its place among the pieces of its
length. That place comes from a range partitioning by (length, document), so a length that a third of all
pieces have is spread over many tasks.

Length: words (runs of non-blank characters), or any column. Defined results: a text without words has
length 0 and no sequence (null ``bin_id``); one longer than the largest size is cut into pieces of that size
and a rest; rows that repeat a doc_id are packed as rows of their own.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlens.llm.common import quoted
from threadlens.session import stage

SIZES = (1024, 2048, 4096, 8192)
# Cost of a sequence besides its tokens.
OVERHEAD = 16


def cost(size: int) -> float:
    return size + OVERHEAD


@dataclass(frozen=True)
class Placed:
    """Pieces number ``first`` … ``first + count - 1`` of one length, ``each`` to a sequence, go to sequences
    ``bin``, ``bin + 1``, … behind the ``used`` tokens that these hold."""

    length: int
    first: int
    count: int
    each: int
    bin: int
    used: int


@dataclass(frozen=True)
class Bins:
    """Sequences ``bin`` … ``bin + count - 1``, opened with ``size`` and holding ``used`` tokens."""

    bin: int
    count: int
    used: int
    size: int


def opening(length: int, count: int, shorter: list[tuple[int, int]], sizes: tuple[int, ...], price: Callable[[int], float]) -> int:
    """Size to open for ``count`` pieces of ``length``. ``shorter``: (length, count) of the pieces to come,
    ascending. Each new sequence is expected to get its share of these, longest first."""
    best = None
    for size in sorted(sizes):
        if size < length:
            continue
        each = min(size // length, count)
        bins = -(-count // (size // length))
        room, filled, top = size - each * length, each * length, len(shorter)
        while room > 0 and top:
            top = min(top, bisect.bisect_right(shorter, (room, float("inf"))))
            if not top:
                break
            top -= 1
            piece, many = shorter[top]
            take = min(room // piece, many // bins)
            filled += take * piece
            room -= take * piece
        rate = price(size) / filled
        if best is None or rate < best[0]:
            best = (rate, size)
    return best[1]


def plan(
    histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, price: Callable[[int], float] = cost
) -> tuple[list[Placed], list[Bins]]:
    """Best-fit decreasing over a histogram of lengths (1 … max(sizes))."""
    placed: list[Placed] = []
    open_: dict[int, list[Bins]] = {}  # room left -> groups of sequences, the latest last
    rooms: list[int] = []  # sorted keys of open_
    full: list[Bins] = []
    lengths, made = sorted(histogram.items()), 0

    def put(group: Bins) -> None:
        room = group.size - group.used
        if not room:
            full.append(group)
            return
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append(group)

    def fill(group: Bins, length: int, first: int, count: int) -> int:
        """Fill ``group`` sequence by sequence; the number of pieces that it took."""
        each = (group.size - group.used) // length
        whole = min(group.count, count // each)
        rest = count - whole * each if whole < group.count else 0
        at, done = group.bin, 0
        for bins, pieces in ((whole, each), (1 if rest else 0, rest)):
            if bins:
                placed.append(Placed(length, first + done, bins * pieces, pieces, at, group.used))
                put(Bins(at, bins, group.used + pieces * length, group.size))
                at, done = at + bins, done + bins * pieces
        if at < group.bin + group.count:
            put(Bins(at, group.bin + group.count - at, group.used, group.size))
        return done

    for k in range(len(lengths) - 1, -1, -1):
        length, left = lengths[k]
        first = 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                size = opening(length, left, lengths[:k], sizes, price)
                group = Bins(made, -(-left // (size // length)), 0, size)
                made += group.count
            took = fill(group, length, first, left)
            first, left = first + took, left - took
    return placed, full + [g for groups in open_.values() for g in groups]


def downsized(used: int, sizes: tuple[int, ...]) -> int:
    return min(s for s in sizes if s >= used)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    length: Column | None = None,
    sizes: tuple[int, ...] = SIZES,
    price: Callable[[int], float] = cost,
) -> DataFrame:
    """One row for each piece of a document: doc_id, piece, start and length (tokens of the document), bin_id,
    bin_start (place in the sequence), bin_size (final length of the sequence)."""
    top, sizes = max(sizes), tuple(sorted(sizes))
    length = words_in(quoted("text")) if length is None else length
    # staged, as the range partitioning below reads them twice
    lengths = stage(docs.select(quoted(id_col).alias("doc_id"), length.cast("long").alias("n")), "lengths")
    pieces = lengths.where(F.col("n") > 0).select(
        "doc_id", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(top).cast("long"))).alias("piece", "start"), "n"
    )
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(top)).alias("length"))
    order = ["length", "doc_id", "piece"]

    def number(batches):
        """Place of each row among the rows of its length in this task; rows come sorted."""
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(3).to_numpy()
            out = np.empty(len(values), np.int64)
            cuts = np.flatnonzero(np.diff(values)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
                if lo == hi:
                    continue
                before = seen.get(int(values[lo]), 0)
                out[lo:hi] = np.arange(before, before + hi - lo)
                seen = {int(values[hi - 1]): before + hi - lo}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), task), pa.int32()), pa.array(out, pa.int64())],
                names=["doc_id", "piece", "start", "length", "task", "place"],
            )

    id_type = lengths.schema["doc_id"].dataType.simpleString()
    ranged = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stage(
        ranged.mapInArrow(number, f"doc_id {id_type}, piece int, start long, length long, task int, place long"), "pieces"
    )
    # One row for each length and task that has it: at most the lengths plus the tasks, as tasks hold ranges.
    parts = ranged.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).collect()
    histogram: dict[int, int] = {}
    for row in offsets:
        histogram[row.length] = histogram.get(row.length, 0) + row.n
    placed, bins = plan(histogram, sizes, price)
    before = {(r.length, r.task): r.before for r in offsets}
    by_length: dict[int, list[Placed]] = {}
    for p in placed:
        by_length.setdefault(p.length, []).append(p)
    tables = {n: np.array([(p.first, p.each, p.bin, p.used) for p in ps], np.int64) for n, ps in by_length.items()}
    groups = sorted(bins, key=lambda b: b.bin)
    ends = (
        np.array([b.bin for b in groups], np.int64),
        np.array([downsized(b.used, sizes) for b in groups], np.int64),
    )
    sent = docs.sparkSession.sparkContext.broadcast((before, tables, ends))

    def assign(batches):
        before, tables, (first_bin, size) = sent.value
        for batch in batches:
            length, task, place = (batch.column(i).to_numpy() for i in (3, 4, 5))
            out = np.empty((3, len(length)), np.int64)
            keys = length * (1 << 32) + task
            for key in np.unique(keys).tolist():
                rows, n = np.flatnonzero(keys == key), key >> 32
                at = place[rows] + before[(n, key & 0xFFFFFFFF)]
                table = tables[n]
                k = np.searchsorted(table[:, 0], at, side="right") - 1
                within = at - table[k, 0]
                out[0, rows] = table[k, 2] + within // table[k, 1]
                out[1, rows] = table[k, 3] + within % table[k, 1] * n
            out[2] = size[np.searchsorted(first_bin, out[0], side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *[pa.array(o, pa.int64()) for o in out]],
                names=["doc_id", "piece", "start", "length", "bin_id", "bin_start", "bin_size"],
            )

    shape = f"doc_id {id_type}, piece int, start long, length long, bin_id long, bin_start long, bin_size long"
    packed = ranged.mapInArrow(assign, shape)
    none = F.lit(None).cast("long")
    empty = lengths.where(F.col("n") == 0).select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
        none.alias("bin_id"), none.alias("bin_start"), none.alias("bin_size"),
    )
    return packed.unionByName(empty)
