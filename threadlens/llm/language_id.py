"""Operator 9: language identification by cross-parsing entropy.

Each language is a bounded sample of labelled text, held as a suffix automaton. A text is parsed from left to
right into the longest pieces that occur in the sample (Ziv and Merhav, 1993); the fewer pieces, the closer
the language. Pieces are normalised by the sample's length: pieces * log2(sample) / letters. A piece of one
character says nothing about the language and costs in each what it costs in the largest sample, so that a tiny
sample never wins by its length. The smallest value wins; ties go to the language that sorts first.

What is learned: at most ``SAMPLE_ROWS`` rows a language, those with the smallest hash of their id, of each at
most ``SAMPLE_CHARS`` characters (of a longer text, from a hashed place among its letters), and of their letters
the ``MAX_LETTERS`` most frequent ones. A sample without a letter is no language. That is a bound
on the model, not on the texts that are judged: these are parsed whole, in blocks of ``BLOCK`` characters that
are parsed on their own, so that memory is bounded and many blocks advance at once.

Letters are lower-cased, everything else is one blank. A text without a letter, or a null text, is ``und``.
The score is 1 - smallest value / second smallest value: 0 for a tie, and 1 if only one language is known
(0 for ``und``). With nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadlens.llm.common import arrow_columns, let, quoted

SAMPLE_ROWS = 48
SAMPLE_CHARS = 768
MAX_LETTERS = 254
BLOCK = 1024
# Symbols of blocks that are parsed at once.
AT_ONCE = 2_000_000
FOLDS = 5
UNKNOWN = "und"


def fold(id_col: Column) -> Column:
    """0 for held-out documents; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def samples(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Per language of ``labelled`` (id, text, lang) its sample, at most ``rows`` pieces of ``chars``
    characters. The limit a language holds in each task before rows are shuffled."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64("id"))

    def somewhere(only: Column) -> Column:
        places = F.greatest(F.length(only) - chars + 1, F.lit(1))
        return F.substring(only, (F.pmod(F.xxhash64("key"), places) + 1).cast("int"), F.lit(chars))

    long = let(F.trim(F.regexp_replace("text", r"\P{L}+", " ")), somewhere)
    piece = F.when(F.length("text") <= chars, F.col("text")).otherwise(long)
    known = known.select("lang", "key", piece.alias("piece"))
    first = Window.partitionBy("lang").orderBy("key", "piece")
    chosen = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows)
    out: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "n").collect():
        out.setdefault(row.lang, []).append(row.piece)
    return out


@lru_cache(maxsize=65_536)
def is_letter(c: str) -> bool:
    return c.isalpha()


def letters_only(text: str) -> str:
    """Lower case; each run of other characters is one blank, none at the ends."""
    return " ".join("".join(c if is_letter(c) else " " for c in text.lower()).split())


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: every path from state 0 spells a factor of it."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = now
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 != length[q]:
                clone = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[now] = q
        last = now
    return to


class Parser:
    """Counts the pieces of many blocks at once in one language's sample.

    ``step[state * width + symbol]`` is twice (next state * width), plus 1 where a new piece starts. The last
    state stands before the first character and after a character that the sample lacks: everything starts a
    piece there. Symbol 0 is a character outside the alphabet.
    """

    def __init__(self, pieces: list[str]):
        text = " ".join(dict.fromkeys(letters_only(p) for p in pieces))
        common = [c for c, _ in sorted(Counter(text).items(), key=lambda x: (-x[1], x[0])) if c != " "]
        alphabet = [" ", *common[:MAX_LETTERS]]
        symbol = {c: i for i, c in enumerate(alphabet, 1)}
        to = automaton([symbol.get(c, 0) for c in text])
        self.width, start = len(alphabet) + 1, len(to)
        self.code = np.zeros(0x110000, np.uint8)
        for c, i in symbol.items():
            self.code[ord(c)] = i
        # a character outside the alphabet is a piece of its own everywhere
        fresh = np.full(self.width, start, np.int64)
        for c, s in to[0].items():
            if c:
                fresh[c] = s
        step = np.tile(fresh * self.width * 2 + 1, start + 1)
        for state, moves in enumerate(to):
            for c, s in moves.items():
                if c:
                    step[state * self.width + c] = s * self.width * 2
        self.step = step.astype(np.int32 if step.max() < 2**31 else np.int64)
        self.before = start * self.width
        self.bits = math.log2(len(text) + 2)

    def count(self, columns: np.ndarray, alive: list[int]) -> np.ndarray:
        """Pieces of each block. ``columns[t]`` has character t of all blocks, the longest first; ``alive[t]``
        blocks have one."""
        return self.counts(columns, alive)[0]

    def counts(self, columns: np.ndarray, alive: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each block, and those of one character among them."""
        n = columns.shape[1]
        state = np.full(n, self.before, self.step.dtype)
        pieces, single, last = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, self.step.dtype)
        for t, some in enumerate(alive):
            now = self.step[state[:some] + self.code[columns[t, :some]]]
            new = now & 1
            pieces[:some] += new
            # a piece that begins right behind the begin of another
            single[:some] += new & last[:some]
            last[:some] = new
            np.right_shift(now, 1, out=state[:some])
        return pieces, single + last.astype(np.int32)


_PARSERS: dict[tuple, dict[str, Parser]] = {}


def parsers(model: tuple[tuple[str, tuple[str, ...]], ...]) -> dict[str, Parser]:
    """The automata of a model, built once in each Python process."""
    if model not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model] = {lang: Parser(list(pieces)) for lang, pieces in model}
    return _PARSERS[model]


# Of each code point: is it a letter?
def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


_TABLES: list[np.ndarray] = []


def letters(text: bytes | None) -> np.ndarray | None:
    """Code points of ``letters_only`` of a text, None if there is no letter."""
    if not text:
        return None
    if not _TABLES:
        _TABLES.append(_letter_table())
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), "<u4")
    known = _TABLES[0][points]
    if not known.any():
        return None
    points = np.where(known, points, 32)
    first, last = np.flatnonzero(known)[[0, -1]]
    points, known = points[first : last + 1], known[first : last + 1]
    keep = known.copy()
    keep[1:] |= known[:-1]
    return points[keep]


def judge(texts: list[np.ndarray | None], model: dict[str, Parser]) -> tuple[list[str], list[float]]:
    langs = sorted(model)
    lengths = [0 if t is None else len(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [-(-n // BLOCK) for n in lengths])
    blocks = [t[at : at + BLOCK] for t in texts if t is not None for at in range(0, len(t), BLOCK)]
    pieces, single = np.zeros((2, len(langs), len(texts)), np.int64)
    if blocks and langs:
        size = np.fromiter(map(len, blocks), np.int64, len(blocks))
        order = np.argsort(-size, kind="stable")
        columns = np.zeros((int(size[order[0]]), len(blocks)), np.uint32)
        for place, b in enumerate(order):
            columns[: size[b], place] = blocks[b]
        alive = np.searchsorted(-size[order], -np.arange(1, len(columns) + 1), side="right").tolist()
        for i, lang in enumerate(langs):
            several, alone = model[lang].counts(columns, alive)
            np.add.at(pieces[i], owner[order], several)
            np.add.at(single[i], owner[order], alone)
    top = max((model[lang].bits for lang in langs), default=0.0)
    found, scores = [], []
    for k, n in enumerate(lengths):
        if not n or not langs:
            found.append(UNKNOWN)
            scores.append(0.0)
            continue
        cost = sorted(
            ((float(pieces[i, k] - single[i, k]) * model[lang].bits + float(single[i, k]) * top) / n, lang)
            for i, lang in enumerate(langs)
        )
        found.append(cost[0][1])
        scores.append(1.0 if len(cost) == 1 else 1.0 - cost[0][0] / cost[1][0])
    return found, scores


def identify(
    docs: DataFrame,
    samples_of: dict[str, list[str]],
    keep: list[str],
    text_col: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep`` columns of ``docs`` with the predicted language and its score."""
    model = tuple(sorted((lang, tuple(pieces)) for lang, pieces in samples_of.items() if any(map(letters_only, pieces))))

    def start():
        known = parsers(model)

        def work(texts: pa.Array):
            found, scores, some, held = [], [], [], 0

            def flush():
                langs, values = judge(some, known)
                found.extend(langs)
                scores.extend(values)

            for text in texts.to_pylist():
                some.append(letters(text))
                held += 0 if some[-1] is None else len(some[-1])
                if held >= AT_ONCE:
                    flush()
                    some, held = [], 0
            flush()
            return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

        return work

    results = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return arrow_columns(docs, keep, [quoted(text_col).cast("binary")], results, start)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Samples of the documents that are not held out."""
    labelled = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    return samples(labelled.where(fold(F.col("id")) != 0))
