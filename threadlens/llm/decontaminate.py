"""Operator 4: benchmark decontamination by a prefix-filtered set join.

Words are runs of digits, lower-cased A-Z and characters beyond ASCII. A window is ``WINDOW_WORDS``
consecutive words of an item (the whole item if it has fewer, but some). Documents are searched for exact
occurrences of windows:

1. order shingles by rarity: the documents that hold each shingle of ``SHINGLE_WORDS`` benchmark words are
   counted over all documents (one pass, counts combined in each task);
2. necessary prefix: an occurrence holds all shingles of its window, so its rarest one is enough to find it
   (for a containment of 1 the prefix has length 1); a window of fewer words is its own shingle;
3. length and positional bounds: the window must fit between the shingle's place and both ends of the text;
4. verification: all words of the window are compared in place.

The benchmark is cut into shards of about ``SHARD_BYTES``, by hash of the item. A shard is the only thing that
comes to the driver and to all tasks; a larger benchmark takes more passes over the documents, each with the
findings of those before, and gives the same rows. Documents are never shuffled.

Defined results: a null text has no words; without benchmark rows nothing is hit; items of equal id count
once, an item without id marks words but is not listed; rows that repeat a doc_id have one row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import arrow_columns, fresh, quoted
from threadlens.session import stage

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
SHARD_BYTES = 8_000_000
# Factor of the shingle keys, which are whole numbers modulo 2^64 whatever the size of the vocabulary. Shingles may share a
# key: it only chooses which windows are compared, word by word.
KEY_FACTOR = 0x9E3779B97F4A7C15

# Every byte outside a word becomes a blank; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _signed(x: int) -> int:
    """``x`` modulo 2^64, as a signed number of 64 bits."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


@dataclass
class Shard:
    """The windows of some items, by number of words. Words have ids from 1 in ``vocabulary``."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], set[str]] = field(default_factory=dict)  # word ids -> item ids
    shingles: dict[int, dict[int, int]] = field(default_factory=dict)  # width -> key -> number

    @classmethod
    def of(cls, items: list[tuple[str | None, bytes | None]]) -> Shard:
        shard = cls()
        for item, text in items:
            ids = [shard.vocabulary.setdefault(w, len(shard.vocabulary) + 1) for w in words(text)]
            n = min(len(ids), WINDOW_WORDS)
            for at in range(len(ids) - n + 1 if n else 0):
                owners = shard.windows.setdefault(tuple(ids[at : at + n]), set())
                if item is not None:
                    owners.add(item)
        number = 0
        for window in shard.windows:
            for _, key, width in shard.keys(window):
                known = shard.shingles.setdefault(width, {})
                if key not in known:
                    known[key] = number
                    number += 1
        return shard

    def keys(self, window: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """(offset, key, width) of the shingles of a window."""
        width = min(len(window), SHINGLE_WORDS)
        out = []
        for at in range(len(window) - width + 1):
            key = 0
            for w in window[at : at + width]:
                key = _signed(key * KEY_FACTOR + w)
            out.append((at, key, width))
        return out

    def ids(self, text: bytes | None) -> np.ndarray:
        """Word ids of a text, 0 for words that no item has."""
        found, get = words(text), self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def places(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``width`` known words follow each other, and their keys."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        whole = known[:n].copy()
        for k in range(1, width):
            whole &= known[k : n + k]
        at = np.flatnonzero(whole)
        key = ids[at]
        for k in range(1, width):
            key = key * np.int64(_signed(KEY_FACTOR)) + ids[at + k]  # arrays wrap around
        return at, key


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` are among ``sorted_keys``, and where."""
    if not len(sorted_keys) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == keys)
    return hit, at[hit]


def document_frequency(docs: DataFrame, text_col: str, shard: Shard) -> dict[int, int]:
    """Documents that hold each shingle of the shard, over all documents. One row a shingle and task is
    shuffled; the sums are at most the shard's shingles."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(shard)

    def run(batches):
        shard = sent.value
        tables = []
        for width, known in shard.shingles.items():
            keys = np.array(sorted(known), np.int64)
            tables.append((width, keys, np.array([known[k] for k in keys.tolist()], np.int64)))
        counts = np.zeros(sum(map(len, shard.shingles.values())), np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = shard.ids(text.as_py())
                for width, keys, numbers in tables:
                    _, at = _found(keys, shard.places(ids, width)[1])
                    counts[numbers[np.unique(at)]] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["k", "n"])

    counted = docs.select(quoted(text_col).cast("binary").alias("t")).mapInArrow(run, "k long, n long")
    return {r.k: r.n for r in counted.groupBy("k").agg(F.sum("n").alias("n")).collect()}


@dataclass
class Index:
    """For each width of shingles the sorted prefix keys, and for each key its (window, offset) pairs."""

    shard: Shard
    items: list[list[str]]
    by_width: dict[int, tuple[np.ndarray, list[list[tuple[int, np.ndarray]]]]]

    @classmethod
    def of(cls, shard: Shard, frequency: dict[int, int]) -> Index:
        chosen: dict[int, dict[int, list[tuple[int, int, np.ndarray]]]] = {}
        items = []
        for w, (window, owners) in enumerate(shard.windows.items()):
            items.append(sorted(owners))
            offset, key, width = min(
                shard.keys(window), key=lambda x: (frequency.get(shard.shingles[x[2]][x[1]], 0), x[0])
            )
            chosen.setdefault(width, {}).setdefault(key, []).append((w, offset, np.array(window, np.int64)))
        by_width = {}
        for width, keys in chosen.items():
            order = sorted(keys)
            by_width[width] = (np.array(order, np.int64), [keys[k] for k in order])
        return cls(shard, items, by_width)

    def search(self, text: bytes | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, mask of the words hit, items with occurring windows."""
        ids = self.shard.ids(text)
        hit, found = np.zeros(len(ids), np.bool_), set()
        for width, (keys, entries) in self.by_width.items():
            at, key = self.shard.places(ids, width)
            which, slot = _found(keys, key)
            for place, k in zip(at[which].tolist(), slot.tolist(), strict=True):
                for w, offset, window in entries[k]:
                    first = place - offset
                    if first < 0 or first + len(window) > len(ids):
                        continue
                    if (ids[first : first + len(window)] == window).all():
                        hit[first : first + len(window)] = True
                        found.update(self.items[w])
        return len(ids), hit, found


def _shards(benchmark: DataFrame, item_col: str, text_col: str) -> list[Callable[[], Shard]]:
    rows = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    count = max(1, math.ceil(total / SHARD_BYTES))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))

    def load(i: int) -> Callable[[], Shard]:
        def shard() -> Shard:
            found = rows.where(part == i).distinct().collect()
            return Shard.of(sorted(((r.item, bytes(r.text or b"")) for r in found), key=lambda r: (r[0] or "", r[1])))

        return shard

    return [load(i) for i in range(count)]


RESULTS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _spans(hit: np.ndarray) -> list[int]:
    """first, last + 1, first, last + 1, … of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
) -> DataFrame:
    """``keep`` columns of ``docs`` and behind them ``names``: number of words; the hit words as runs (first,
    last + 1, …); the items with occurring windows, sorted as strings."""
    loads = _shards(benchmark, item_col, item_text_col)
    context, out = docs.sparkSession.sparkContext, docs
    earlier: list[str] = []
    for number, load in enumerate(loads):
        shard = load()
        index = context.broadcast(Index.of(shard, document_frequency(docs, text_col, shard)))

        def start(index=index):
            def work(texts, *before):
                counts, spans, items = [], [], []
                past = [c.to_pylist() for c in before]
                for i, text in enumerate(texts.to_pylist()):
                    n, hit, found = index.value.search(text)
                    if past:
                        old = past[0][i]
                        for first, stop in zip(old[::2], old[1::2], strict=True):
                            hit[first:stop] = True
                        found |= set(past[1][i])
                    counts.append(n)
                    spans.append(_spans(hit))
                    items.append(sorted(found))
                return [counts, spans, items]

            return work

        last = number == len(loads) - 1
        held = list(keep) if last else list(docs.columns)
        inputs = [quoted(text_col).cast("binary"), *[quoted(c) for c in earlier]]
        earlier = list(names) if last else fresh(docs, "n_words", "spans", "items")
        out = arrow_columns(out, held, inputs, _named(earlier), start)
        if not last:
            out, earlier = stage(out, "contamination"), earlier[1:]
    return out


def _named(names) -> T.StructType:
    return T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, RESULTS.fields, strict=True)])


def digest(found: DataFrame) -> DataFrame:
    """The counts and the item digest of ``find_contamination``'s rows."""
    sizes = F.transform(F.col("spans"), lambda p, i: F.when(i % 2 == 1, p).otherwise(-p))
    n_hit = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    return found.withColumn("n_hit", n_hit).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    names = tuple(fresh(docs, "n_words", "spans", "items"))
    found = find_contamination(docs, benchmark, list(docs.columns), text_col, names=names)
    return found.where(F.size(names[1]) == 0).drop(*names)


SQL = f"""
with pieces as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents
), items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark
), windows as (
  select distinct item, n, array_to_string(ws[pos:pos + n - 1], ' ') as w
  from (select item, ws, least(len(ws), {WINDOW_WORDS}) as n, unnest(range(1, len(ws) - least(len(ws), {WINDOW_WORDS}) + 2)) as pos from items where len(ws) > 0)
), sizes as (
  select distinct n from windows
), grams as (
  select doc_id, n, pos, array_to_string(ws[pos:pos + n - 1], ' ') as w
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as pos from pieces, sizes where len(ws) >= n)
), hits as (
  select g.doc_id, g.pos, g.n, x.item from grams g join windows x on g.n = x.n and g.w = x.w
), marked as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as p from hits) group by doc_id
), listed as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id
)
select p.doc_id, coalesce(len(p.ws), 0) as n_words, coalesce(m.n_hit, 0) as n_hit, coalesce(l.n_items, 0) as n_items,
  sha256(coalesce(l.names, '')) as items_sha256, coalesce(m.n_hit, 0) > 0 as contaminated
from pieces p left join marked m on p.doc_id = m.doc_id left join listed l on p.doc_id = l.doc_id
"""
