"""Operator 12: periodic runs of words, found online on sparse diagonals.

A run is a stretch of words with smallest period q (words q apart are the same) of at least ``max(MIN_WORDS, 2 * q)``
words that no neighbouring word extends. Each lag is a diagonal: going through the words, every earlier
occurrence of what ends at a word adds one to the match length of the diagonal of its distance, and a diagonal
that is not met again ends there and gives its run at once if it is long enough.

What keeps the diagonals few, without losing a run:

* A run of period q holds at least ``max(MIN_WORDS - q, q)`` matches in a row, so with lags dealt into levels
  [g, 2g), only occurrences of whole g-grams (six words at least) need to be met. Grams are told apart
  by ranks of pairs of half as long ones, exactly, for a slice of texts at once; the search ends at the level where
  no gram repeats.
* Occurrences q apart with q below g overlap, so all between them has period q, and the lags 2q, 3q, … only
  repeat the run of q: of such a progression the nearest occurrence alone is met.
* Runs with the same words as one of a shorter period are left out: theirs is not the smallest period.

``collapsed`` is the text without what repeats: of each run its first q words stay, and all words outside of runs;
they are joined by one blank. Words are separated by the blanks of ASCII.

Defined results: a null or blank text has no words, no runs, and collapses to the empty text; repeated rows are
treated alike; whole texts are searched, whatever their length. Rows stay in their partition; a task holds one slice
of texts (``SLICE_BYTES``, or one longer text) at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import arrow_columns, fresh, quoted

MIN_WORDS = 12
# Texts that are ranked together.
SLICE_BYTES = 2 << 20
WORD = r"[^\x20\x09-\x0D]+"
RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)


class Chains:
    """Occurrences of the grams of one length: ``rank`` tells them apart, ``prev`` is the occurrence before
    (-1: none), ``step`` the distance to it (0: none), ``beyond`` the next one behind all that lie in one
    progression with this and the one before."""

    def __init__(self, key: np.ndarray):
        n = len(key)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.ones(n, np.bool_)
        first[1:] = ordered[1:] != ordered[:-1]
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.cumsum(first) - 1
        before = np.full(n, -1, np.int64)
        before[1:] = order[:-1]
        before[first] = -1
        self.prev = np.empty(n, np.int64)
        self.prev[order] = before
        self.repeats = not first.all()
        if self.repeats:
            steps = np.where(before >= 0, order - before, 0)
            turn = first.copy()
            turn[1:] |= steps[1:] != steps[:-1]
            began = np.maximum.accumulate(np.where(turn, np.arange(n), 0))
            oldest = order[np.maximum(began - 1, 0)]
            self.step, self.beyond = np.empty((2, n), np.int64)
            self.step[order] = steps
            self.beyond[order] = np.where(steps > 0, self.prev[oldest], -1)


def paired(left: np.ndarray, right: np.ndarray, apart: int) -> np.ndarray:
    """At each place a key of (left ``apart`` places before, right here); places without one get keys of their own."""
    n = len(right)
    wide = int(max(left.max(), right.max())) + n + 2
    out = np.empty(n, np.int64)
    out[apart:] = left[: n - apart] * wide + right[apart:]
    out[:apart] = wide * wide + np.arange(min(apart, n))
    return out


def online(chains: Chains, gram: int, low: int, high: int, found: list[tuple[int, int, int]]) -> None:
    """Runs (first, last, lag) of the lags in [low, high), from the occurrences of grams of ``gram`` words."""
    step, beyond, prev = chains.step, chains.beyond, chains.prev
    place = np.arange(len(step))
    near = (step >= low) & (step < high)
    far = (step > 0) & (beyond >= 0) & (place - beyond < high)
    met = np.flatnonzero(near | far)
    active: dict[int, int] = {}
    last = -2

    def end(diagonals: dict[int, int], at: int) -> None:
        for lag, grams in diagonals.items():
            matches = grams + gram - 1
            if matches >= max(MIN_WORDS - lag, lag):
                found.append((at - matches + 1 - lag, at, lag))

    for i, lag, j in zip(met.tolist(), step[met].tolist(), beyond[met].tolist(), strict=True):
        if i != last + 1:
            end(active, last)
            active = {}
        now = {}
        if low <= lag < high:
            now[lag] = active.pop(lag, 0) + 1
        while j >= 0:
            lag = i - j
            if lag >= high:
                break
            if lag >= low:
                now[lag] = active.pop(lag, 0) + 1
            j = int(prev[j])
        if active:
            end(active, last)
        active, last = now, i
    end(active, last)


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each text (a list of words) its runs (start, length, period), by start, then period."""
    sizes = np.array([len(words) for words in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not (sizes >= MIN_WORDS).any():
        return out
    # every text behind a mark that occurs once
    code: dict[bytes, int] = {}
    flat = [code.setdefault(w, len(code)) for words in texts for w in words]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes
    word = np.empty(len(owner), np.int64)
    word[begin - 1] = len(code) + np.arange(len(texts))
    mask = np.ones(len(owner), np.bool_)
    mask[begin - 1] = False
    word[mask] = flat

    two = Chains(paired(word, word, 1)).rank
    three = Chains(paired(two, word, 1)).rank
    chains, gram = Chains(paired(three, three, 3)), MIN_WORDS // 2
    place = np.arange(len(word))
    found: list[tuple[int, int, int]] = []
    low = 1
    while chains.repeats:
        high = 2 * gram
        some: list[tuple[int, int, int]] = []
        online(chains, gram, low, high, some)
        found += [(int(place[a]), int(place[b]), lag) for a, b, lag in some]
        # only texts with a repeated gram, and long enough, can hold more
        again = np.zeros(len(texts), np.bool_)
        again[owner[chains.prev >= 0]] = True
        again &= sizes >= 4 * gram
        keep = again[owner]
        if not keep.any():
            break
        owner, place, rank = owner[keep], place[keep], chains.rank[keep]
        chains = Chains(paired(rank, rank, gram))
        gram, low = 2 * gram, high

    least: dict[tuple[int, int], int] = {}
    for a, b, lag in found:
        least[a, b] = min(lag, least.get((a, b), lag))
    starts = begin.tolist()
    for (a, b), lag in least.items():
        k = int(np.searchsorted(begin, a, side="right")) - 1
        out[k].append((a - starts[k], b - a + 1, lag))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs and the first period of each run."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    return b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)


def periodic_runs(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (all, unless named) and, behind them, ``n_words``, ``runs`` (start, length,
    period, by start and period) and ``collapsed``, the text without its repetitions; under other names where ``docs``
    has these."""
    keep = docs.columns if keep is None else keep
    names = fresh(docs.select(*[quoted(c) for c in keep]), "n_words", "runs", "collapsed")
    results = T.StructType(
        [T.StructField(names[0], T.LongType()), T.StructField(names[1], RUNS), T.StructField(names[2], T.StringType())]
    )

    def start():
        def work(texts: pa.Array):
            counts, runs, collapsed, part, held = [], [], [], [], 0

            def flush():
                for words, got in zip(part, find_runs(part), strict=True):
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                    collapsed.append(collapse(words, got))

            for value in texts:
                raw = value.as_py() or b""
                # bytes are split at the same six characters as WORD
                part.append(raw.split())
                held += len(raw)
                if held >= SLICE_BYTES:
                    flush()
                    part, held = [], 0
            flush()
            return counts, runs, pa.array(collapsed, pa.binary()).cast(pa.string())

        return work

    return arrow_columns(docs, keep, [quoted(text_col).cast("binary")], results, start)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the query: in one of ten texts, chosen by the checksum of its id, the words from some place on
    repeat with a period. All others are as they are."""
    zero = F.lit(0).cast("long")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).select(
        "doc_id",
        "text",
        F.floor(F.col("h") / 10).alias("g"),
        F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"),
    )
    sized = chosen.select("*", F.nullif(F.size("words").cast("long"), zero).alias("n"))
    placed = sized.select("*", (F.col("g") % F.col("n")).alias("a"))
    left, parts = F.col("n") - F.col("a"), F.col("g") % 8 + 3
    spaced = placed.select("*", (F.floor(left / parts) + 1).alias("p"))
    def word(i: Column) -> Column:
        at = F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
        return F.element_at("words", (at + 1).cast("int"))

    repeated = F.array_join(F.transform(F.sequence(zero, F.col("n") - 1), word), " ")
    return spaced.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query, from ``doc_id``, ``runs`` and ``collapsed``."""
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return shown.select(
        "doc_id",
        "n_runs",
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
