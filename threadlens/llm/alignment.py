"""Operator 11: alignment of two tokenizers over the same bytes.

Each text is encoded by a byte-level BPE (A) and a BPE of pieces with byte fallback (B). Both spell the same bytes, so the
cumulative ends of their tokens are comparable: a dictionary from end to index on each side, the
intersection of the two key sets, and its sorted keys cut both id lists into groups that cover the same bytes. In
each group one token of A and one of B end together, at the group's end: that is a link. The dictionaries are
arrays over the bytes of a batch of texts: both sides spell each text of it, so an end is common to tokens of one text only.

Counts of linked id pairs are taken over all texts. Two tokens that end together spell the same last bytes, so the shorter is a
suffix of the longer: a token has at most as many partners shorter than itself as it has bytes. The table of counts so
holds at most as many pairs as both vocabularies have bytes (``Encoder.most_pairs``, about half a million here), however large
the corpus, and is broadcast.

Texts are encoded once; the links are written, the second pass reads these. Long texts are encoded
in pieces that begin at a blank between two letters or digits of ASCII, where neither tokenizer joins anything: no token of
either has a letter or digit before a blank (checked against the vocabulary files; if one had, long texts would stay whole).

Defined results: a null or empty text, and a text that either tokenizer does not spell exactly (B normalises its input, so
a text with U+2581, say), has no tokens: empty lists. Marks of special tokens within a text are plain text.
Repeated rows are counted as often as they occur. Tokenizer files are read by each Python process from the paths given; they must
exist on every machine.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadlens.llm.common import arrow_columns, fresh, quoted
from threadlens.session import stage

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Longer texts are encoded in pieces; texts are handed to a tokenizer in batches of about this many characters.
PIECE_CHARS = 200_000
SAFE_CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
BLANK = "▁"
# Fixed value: how a byte-level BPE of this kind cuts a text into words before it merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
IDS = T.ArrayType(T.IntegerType(), False)
LISTS = pa.list_(pa.int32())


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible ones for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(BLANK, " ").encode()


class Encoder:
    """Both tokenizers, with the bytes of all their tokens.

    A's vocabulary and merges are those of the JSON file. As its ids are in the order of its merges (checked), they serve as ranks, and
    ``tiktoken`` runs them: the same ids in a third of the time and without a record a token."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(a_path, encoding="utf-8") as file:
            stored = json.load(file)
        byte = byte_of_char()
        ids = stored["model"]["vocab"]
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in ids.items() if token not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in stored["model"]["merges"]]
        if [ids[m] for m in merges] != list(range(256, 256 + len(merges))) or not stored["pre_tokenizer"]["use_regex"]:
            raise ValueError(f"not a byte-level vocabulary in the order of its merges: {a_path}")
        self.a = Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*((t.encode(), i) for t, i in special.items()), *ranks.items()]:
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)]
        self.a_spelling, self.b_spelling = (pa.array(x, pa.binary()) for x in (self.a_bytes, self.b_bytes))
        self.a_size, self.b_size = (np.array([len(y) for y in x]) for x in (self.a_bytes, self.b_bytes))
        self.shown = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])
        # a cut between a letter or digit and a blank is safe only if no token holds both in this order
        self.cuttable = not any(re.search(rb"[0-9A-Za-z] ", x) for x in (*self.a_bytes, *self.b_bytes))

    @property
    def most_pairs(self) -> int:
        """Most pairs of tokens that can end together."""
        return int(self.a_size.sum() + self.b_size.sum())

    def pieces(self, text: str) -> Iterator[str]:
        """``text`` in pieces; between two of them one blank is left out."""
        at = 0
        while self.cuttable and len(text) - at > PIECE_CHARS:
            cut = SAFE_CUT.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:] if at else text

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text, in order; nothing where one of them does not spell the text."""
        a, b = self.ids(texts)
        return zip(a.to_pylist(), b.to_pylist(), strict=True)

    def ids(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """As ``encode``, in two columns."""
        parts = [list(self.pieces(t)) for t in texts]
        flat = [p for some in parts for p in some]
        ends = sums([len(some) for some in parts])
        a = joined_lists(pa.array([self.a.encode_ordinary(f" {p}") for p in flat], LISTS), ends)
        b = joined_lists(pa.array(self.b.encode(flat, num_threads=1), LISTS), ends)
        whole = pa.array([f" {t}".encode() for t in texts], pa.binary())
        same = pc.and_(pc.equal(spelt(self.a_spelling, a), whole), pc.equal(spelt(self.b_spelling, b), whole))
        kept = np.array(same, bool) & np.array([bool(t) for t in texts], bool)
        return only(a, kept), only(b, kept)

    def cuts(self, a: pa.ListArray, b: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
        """Where the groups end in both lists: after so many tokens of A, and of B."""
        a_index, b_index = index_of_end(self.a_size[np.array(a.values)]), index_of_end(self.b_size[np.array(b.values)])
        common = np.flatnonzero((a_index > 0) & (b_index > 0))
        return counted_within(a_index[common], a), counted_within(b_index[common], b)

    def groups_text(self, a: pa.ListArray, b: pa.ListArray, a_cuts: pa.ListArray, b_cuts: pa.ListArray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3``: the groups of each text in order."""
        sides = []
        for ids, cuts in ((a, a_cuts), (b, b_cuts)):
            ends = np.array(cuts.values) + np.repeat(np.array(ids.offsets)[:-1], np.diff(cuts.offsets))
            ends = np.concatenate([np.zeros(1, np.int32), ends])
            sides.append(pc.binary_join(pa.ListArray.from_arrays(ends, self.shown.take(ids.values)), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        return pc.binary_join(pa.ListArray.from_arrays(a_cuts.offsets, groups), ";")


def sums(sizes: Any) -> np.ndarray:
    """Offsets of lists of these sizes."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def joined_lists(lists: pa.ListArray, ends: np.ndarray) -> pa.ListArray:
    """The lists up to each of ``ends`` as one."""
    return pa.ListArray.from_arrays(lists.offsets.take(pa.array(ends)), lists.values)


def spelt(table: pa.Array, ids: pa.ListArray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, table.take(ids.values)), b"")


def only(lists: pa.ListArray, kept: np.ndarray) -> pa.ListArray:
    """The lists, those not ``kept`` empty."""
    sizes = np.where(kept, np.diff(lists.offsets), 0)
    return pa.ListArray.from_arrays(sums(sizes), lists.filter(pa.array(kept)).flatten())


def index_of_end(sizes: np.ndarray) -> np.ndarray:
    """Dictionary from the end of each token to its number (from 1), as an array over the bytes: 0 where none ends."""
    ends = np.cumsum(sizes)
    index = np.zeros(int(sizes.sum()) + 1, np.int32)
    index[ends] = np.arange(1, len(ends) + 1)
    return index


def counted_within(at: np.ndarray, lists: pa.ListArray) -> pa.ListArray:
    """Numbers (from 1) in the chain of all lists, per list and counted from its start."""
    offsets = np.array(lists.offsets)
    per = np.searchsorted(at, offsets, side="right")
    within = at - np.repeat(offsets[:-1], np.diff(per))
    return pa.ListArray.from_arrays(per.astype(np.int32), within.astype(np.int32))


@lru_cache(maxsize=2)
def encoder(a_path: str, b_path: str) -> Encoder:
    return Encoder(a_path, b_path)


def align(
    docs: DataFrame,
    keep: list[str] | None = None,
    text_col: str = "text",
    a_path: str | None = None,
    b_path: str | None = None,
) -> DataFrame:
    """``keep`` columns of ``docs`` (all, unless named) and, behind them, ``a_ids``, ``b_ids``, where their groups end, ``a_cuts`` and
    ``b_cuts`` (tokens so far), and ``groups_sha256``, the hash of the groups in order as text (empty without tokens); under other
    names where ``docs`` has these. Each text is encoded with a blank before it."""
    keep = docs.columns if keep is None else keep
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    names = fresh(docs.select(*[quoted(c) for c in keep]), "a_ids", "b_ids", "a_cuts", "b_cuts", "groups_sha256")

    def start():
        known = encoder(a_path, b_path)

        def work(texts: pa.Array):
            out: list[list] = [[], [], [], [], []]
            some, held = [], 0

            def flush():
                a, b = known.ids(some)
                cuts = known.cuts(a, b)
                groups = known.groups_text(a, b, *cuts).cast(pa.binary()).to_pylist()
                shown = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())
                for column, value in zip(out, (a, b, *cuts, shown), strict=True):
                    column.append(value)

            for value in texts:
                some.append(value.as_py() or "")
                held += len(some[-1])
                if held >= PIECE_CHARS:
                    flush()
                    some, held = [], 0
            flush()
            return [pa.concat_arrays(column) for column in out]

        return work

    results = T.StructType([*(T.StructField(n, IDS) for n in names[:4]), T.StructField(names[4], T.StringType())])
    return arrow_columns(docs, keep, [quoted(text_col)], results, start)


def links() -> Column:
    """Array of the links of a row of ``align``: the tokens (a, b) that end each group."""
    return F.transform(
        F.arrays_zip("a_cuts", "b_cuts"),
        lambda g: F.struct(F.element_at("a_ids", g["a_cuts"]).alias("a"), F.element_at("b_ids", g["b_cuts"]).alias("b")),
    )


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, n, best) of a column ``links``: how many links hold the pair, and whether no partner of b has more. One row per
    pair: bounded by the vocabularies, counted before the shuffle."""
    counted = linked.select(F.inline("links").alias("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def digest(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Per row of ``aligned`` (doc_id, n_a, n_b, n_groups, links, groups_sha256) how its links stand in the corpus. ``counts``
    is bounded by the vocabularies, so it is broadcast; links are added up in their task, one row a document leaves it."""
    row = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    numbered = aligned.withColumn("row", F.monotonically_increasing_id())
    long = numbered.select(*row, F.inline_outer("links").alias("a", "b"))
    known = F.broadcast(counts.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "n", "best"))
    found = long.join(known, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left")
    added = found.groupBy(*row).agg(
        F.count("a").alias("n_links"), F.count_if("best").alias("n_best"), F.coalesce(F.sum("n"), F.lit(0)).alias("count_sum")
    )
    return added.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def align_documents(docs: DataFrame) -> DataFrame:
    """The query: per document its numbers of tokens, groups and links, and how its links stand in the corpus."""
    aligned = align(docs.select("doc_id", "text"), ["doc_id"])
    narrow = aligned.select(
        "doc_id",
        F.size("a_ids").cast("long").alias("n_a"),
        F.size("b_ids").cast("long").alias("n_b"),
        F.size("a_cuts").cast("long").alias("n_groups"),
        links().alias("links"),
        F.col("groups_sha256").alias("groups_sha256"),
    )
    written = stage(narrow, "aligned")
    return digest(written, stage(pair_counts(written), "pair-counts"))
