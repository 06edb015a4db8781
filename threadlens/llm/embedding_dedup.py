"""Operator 2: embedding near-dedup with randomised-rotation binary codes.

Each vector is scaled to length 1 and turned by a random rotation. The signs of the turned vector are its binary
code; beside it stands the correction factor <code / sqrt(d), turned vector> (Gao and Long, 2024). For a code of x
and a turned vector y, <code / sqrt(d), y> / factor is an unbiased estimate of <x, y>. Its error is
s * <q, y>, where s = sqrt(1 - factor^2) / factor and q is a direction at right angles to x: one standard deviation is
s / sqrt(d - 1), and for a pair at the threshold c or closer it is at most s * sqrt(1 - c^2). Only pairs whose estimate
plus the smaller of this bound and ``SIGMAS`` deviations reaches the threshold are computed exactly, in double
precision, and only these results make links.

Which pairs are looked at: up to ``EXACT`` vectors all pairs. Above, pairs that share a cell in one of some tables and
in it one of ``FINE`` finer cells. A cell is told by which of some random directions a vector lies closest to (cross
polytopes; Andoni and others, 2015), several of them where there are many vectors: ``bits`` bits for a cell and a
finer cell, up to ``FACTOR`` a polytope. The number of tables follows from the chance that a pair exactly at the threshold
shares both, so that it is looked at with probability ``RECALL`` or more (closer pairs nearly always); ``bits`` is where
copies and comparisons cost least. Each table and finer cell together are a band; ``tables`` counts bands.

Tables are gone through in rounds. A round sends each vector to its cells of a few tables, one copy a table, and its
shuffle files are removed when it ends, so disk holds the vectors and one round, however many tables there are.
There is no cap: a cell of more than ``BLOCK`` vectors (or ``CELL`` bytes) is cut into blocks, and each two blocks of
it meet in a task of their own, in rounds no larger than the others.

Equal vectors are one class with a weight. A pair that shares several bands counts in the first only. A task
returns for each vector the weight linked to it and one link to the smallest vector it hangs together with, not the
pairs, so a group of n near copies gives n rows a task.

Defined results: a vector that is null, of length 0, or has null or non-finite components links with nothing,
and so do vectors of different dimensions; a null vec_id has no links and a null component_id; rows of equal
vec_id and vector link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import components, quoted
from threadlens.session import freed_shuffles, fresh_path, remove, stage

THRESHOLD = 0.9
RECALL = 1 - 1e-6
SIGMAS = 4.5
EXACT = 1 << 17
FACTOR = 7
FINE = 4
BLOCK = 1 << 18
CELL = 48 << 20
HELD = 16 << 20
ROUND = 128 << 20
TILE = 512
PACK = 512
SLACK = 1e-4  # more than single precision errs
SEED = 7
# Which side of a pair of blocks a copy stands on, and the columns of packed rows before vectors and cells.
LOW, HIGH, BOTH = 1, 2, 3
PLACED = (("cid", "<i8"), ("weight", "<i8"))
SENT = (("unit", "<i4"), ("side", "u1"), *PLACED)


def factors_of(bits: int) -> list[int]:
    """Bits of each cross polytope of a table, as equal as can be."""
    n = -(-bits // FACTOR)
    return [bits // n + (k < bits % n) for k in range(n)]


@lru_cache(maxsize=64)
def meeting(bits: int, threshold: float) -> float:
    """Chance, less four standard errors, that a pair at the threshold is closest to the same of 2^bits directions."""
    rng, n, m = np.random.default_rng(SEED), 200_000, 1 << (bits - 1)
    same = 0
    for _ in range(8):
        x = rng.standard_normal((n // 8, m), np.float32)
        y = np.float32(threshold) * x + np.float32(math.sqrt(1 - threshold**2)) * rng.standard_normal((n // 8, m), np.float32)
        same += int((_closest(x) == _closest(y)).sum())
    p = same / n
    return p - 4 * math.sqrt(p * (1 - p) / n)


def _closest(turned: np.ndarray) -> np.ndarray:
    top = np.abs(turned).argmax(axis=1)
    return 2 * top + (turned[np.arange(len(top)), top] > 0)


def split(bits: int) -> tuple[int, int]:
    """Bits of a cell and of a finer cell."""
    return bits - min(FACTOR, bits // 2), min(FACTOR, bits // 2)


def agreement(bits: int, threshold: float) -> float:
    """Chance that a pair at the threshold shares a table's cell and one of its finer cells."""
    coarse, fine = (math.prod(meeting(b, threshold) for b in factors_of(x)) for x in split(bits))
    return coarse * (1 - (1 - fine) ** FINE)


def layout(vectors: int, threshold: float = THRESHOLD, width: int = 256) -> tuple[int, int]:
    """(bits, number of bands) for so many vectors of so many bytes."""
    if vectors <= EXACT or not 0 < threshold < 1:
        return 0, 1
    best = None
    for bits in range(8, 64):
        tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agreement(bits, threshold)))
        # microseconds a vector: moved, sorted, and compared
        cost = tables * (8 + FINE * (0.4 + vectors / 2**bits / 600))
        if best and cost > 2 * best[1]:
            break
        if vectors / 2 ** split(bits)[0] * width <= CELL * 2 // 3:
            found = (np.dtype(cell_kind(bits)).itemsize, cost, bits, tables)  # small cells first, as they lie on disk
            best = min(best or found, found)
    return best[2], best[3] * FINE


def rotation(dim: int, bits: int = 0, tables: int = 1) -> np.ndarray:
    """(dim, dim): the random rotation of the codes, the same for every layout."""
    return _turn(dim)


@lru_cache(maxsize=16)
def _turn(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


@lru_cache(maxsize=1024)
def directions(dim: int, bits: int, table: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """Directions of a table's polytopes side by side, and (bits, first, last) of the polytopes of its cell and finer
    cells. Directions of one polytope are at right angles."""
    rng = np.random.default_rng([SEED, dim, bits, table])
    coarse, fine = split(bits)
    made, places, at = [], [], 0
    for b in [coarse] + [fine] * FINE:
        widths = [min(dim, 1 << (f - 1)) for f in factors_of(b)]
        if sum(widths) <= dim:
            made.append(np.linalg.qr(rng.standard_normal((dim, sum(widths))))[0])
        else:
            made += [np.linalg.qr(rng.standard_normal((dim, m)))[0] for m in widths]
        places.append([])
        for f, m in zip(factors_of(b), widths, strict=True):
            places[-1].append((f, at, at + m))
            at += m
    return np.concatenate(made, axis=1), places


def cells(rows: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Cell and finer cells of each vector, table by table: they are made once for each vector, as a second time sums
    might round otherwise."""
    if not bits:
        return np.zeros((len(rows), 2), cell_kind(bits))
    out = np.zeros((len(rows), tables // FINE, 1 + FINE), cell_kind(bits))
    dim = rows.shape[1]
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    for t in range(tables // FINE):
        made, places = directions(dim, bits, t)
        turned = rows @ made
        for k, polytopes in enumerate(places):
            value = np.zeros(len(rows), np.int64)
            for b, first, last in polytopes:
                value = (value << b) | _closest(turned[:, first:last])
            out[:, t, k] = value
    return out.reshape(len(rows), -1)


def cell_kind(bits: int) -> str:
    most = max(split(bits))
    return "<u1" if most <= 8 else "<u2" if most <= 16 else "<u4"


def fines(bits: int) -> int:
    return FINE if bits else 1


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first so that squares stay finite."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def encode(rows: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes, each with its cells behind it, and the correction factor."""
    dim = rows.shape[1]
    turned = unit(rows) @ _turn(dim)
    factors = np.abs(turned).sum(axis=1, keepdims=True) / math.sqrt(dim)
    own = np.ascontiguousarray(cells(rows, bits, tables)).view(np.uint8).reshape(len(rows), -1)
    return np.concatenate([np.packbits(turned > 0, axis=1), own], axis=1), factors.astype(np.float32)


def bands(codes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bands of packed codes: cell and finer cell."""
    kind, fine = cell_kind(bits), fines(bits)
    each = tables // fine * (1 + fine)
    own = np.ascontiguousarray(codes[:, -each * np.dtype(kind).itemsize :]).view(kind).astype(np.int64)
    own = own.reshape(len(codes), -1, 1 + fine)
    return ((own[:, :, :1] << split(bits)[1]) | own[:, :, 1:]).reshape(len(codes), tables)


def _vectors(batch: pa.Array, kind: str) -> pa.Array:
    """Vectors as bytes of numbers of ``kind``; null for those that link with nothing."""
    values = batch.flatten()
    lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = values.cast(pa.float32() if kind == "<f4" else pa.float64()).fill_null(math.nan)
    numbers = numbers.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # no negative zeros
    if len(lengths) and lengths[0] and (lengths == lengths[0]).all():
        rows = numbers.reshape(len(lengths), -1)
        good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
    else:
        stops = np.concatenate([[0], np.cumsum(lengths)])
        sum_of = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[stops])
        good = (sum_of(~np.isfinite(numbers)) == 0) & (sum_of(numbers != 0) > 0) & (lengths > 0)
    if not good.all():
        numbers = numbers[np.repeat(good, lengths)]
    offsets = np.concatenate([[0], np.cumsum(np.where(good, lengths, 0) * np.dtype(kind).itemsize)]).astype(np.int64)
    made = pa.Array.from_buffers(
        pa.large_binary(), len(batch), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))]
    )
    return pc.if_else(pa.array(good), made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _rows(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32)
    first, last = int(at[column.offset]), int(at[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(np.dtype(kind)).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, name: str):
    """(bytes, rows) for the lengths that a batch's vectors have."""
    lengths = pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        own = lengths == length
        yield length, batch if own.all() else batch.filter(pa.array(own))


def turned_codes(rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(turned vectors, whose signs are the codes, and least product of a code and a turned vector for a link) in single
    precision."""
    dim = rows.shape[1]
    with np.errstate(over="ignore"):
        square = np.einsum("ij,ij->i", rows, rows)
    if square.dtype == np.float32 and (square > 1e-30).all() and (square < 1e30).all():
        small = rows / np.sqrt(square)[:, None]
    else:
        small = unit(rows).astype(np.float32)
    turned = small @ _turn(dim).astype(np.float32)
    f = np.maximum(np.abs(turned).sum(axis=1).astype(np.float64) / math.sqrt(dim), 1e-30)
    s = np.sqrt(np.maximum(1 - f * f, 0)) / f
    worst = math.sqrt(max(1 - threshold**2, 0)) if threshold > 0 else math.inf
    least = threshold - SLACK - s * min(worst, SIGMAS / math.sqrt(max(dim - 1, 1)))
    return turned, (least * math.sqrt(dim) * f).astype(np.float32)


def leading(dim: int, threshold: float) -> int:
    """How many coordinates tell most unrelated pairs of random directions apart (see ``candidates``)."""
    enough = (r for r in range(1, dim) if r / dim - (1 - threshold) >= 3.6 * math.sqrt(r) / dim)
    return next(enough, dim)


def candidates(turned: np.ndarray, least: np.ndarray, threshold: float):
    """Function from rows ``of`` and places ``low`` and ``high`` among them (slices) to pieces (i, j) of the pairs of rows
    between the two (within ``low`` without ``high``), each pair once, that can be links.

    The distance over the leading coordinates is no longer than the whole, so a pair at the threshold c or closer has
    <x', y'> >= (|x'|^2 + |y'|^2) / 2 - (1 - c) there, and a product of the leading coordinates, with two more for the
    lengths, drops nearly all others. The estimate from the code of one and the other's turned vector decides on the rest; where
    they are many, as among vectors that lie close to each other, it is made for the tile at once, followed by the product in
    single precision."""
    first = leading(turned.shape[1], threshold)
    reach = np.float32(threshold - 1 - SLACK)
    code = lambda rows: np.copysign(np.float32(1), turned[rows])

    head = turned[:, :first]
    half = np.einsum("ij,ij->i", head, head)[:, None] / -2
    one = np.ones_like(half)
    lefts, rights = np.concatenate([head, half, one], axis=1), np.concatenate([head, one, half], axis=1)

    def prepare(of: np.ndarray):
        left, right = lefts.take(of, axis=0), rights.take(of, axis=0)

        def pieces(low: slice, high: slice | None = None):
            same, high = high is None, high or low
            for a in range(low.start, low.stop, TILE):
                p = slice(a, min(a + TILE, low.stop))
                for b in range(a if same else high.start, high.stop, TILE):
                    q = slice(b, min(b + TILE, high.stop))
                    near = left[p] @ right[q].T >= reach
                    if same and a == b:
                        np.fill_diagonal(near, False)
                    at = _true(near)
                    many = len(at) > max(near.size // 50, 1000)
                    if many:
                        near &= code(of[p]) @ turned[of[q]].T >= least[of[p], None]
                        near &= turned[of[p]] @ turned[of[q]].T >= np.float32(threshold - SLACK)
                        at = _true(near)
                    if not len(at):
                        continue
                    i, j = np.divmod(at, q.stop - q.start)
                    if same and a == b:
                        i, j = i[i < j], j[i < j]
                    i, j = of[i + a], of[j + b]
                    if not many and len(i):
                        some = np.einsum("ij,ij->i", code(i), turned[j]) >= least[i]
                        i, j = i[some], j[some]
                    if len(i):
                        yield i, j

        return pieces

    return prepare


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the true ones among flat flags. A search for bytes finds a few among very many soonest."""
    data = flags.tobytes()
    out, at = [], data.find(1)
    while at >= 0:
        if len(out) == 100:
            return np.flatnonzero(flags)
        out.append(at)
        at = data.find(1, at + 1)
    return np.array(out, np.int64)


def linked(
    rows: np.ndarray, i: np.ndarray, j: np.ndarray, known: np.ndarray, table: int, fine: int, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs, which share a band, that are links and share no earlier one. ``known``: (rows, tables, cells)."""
    if fine:
        new = ~(known[i, table, 1 : 1 + fine] == known[j, table, 1 : 1 + fine]).any(axis=1)
        i, j = i[new], j[new]
    for t in range(table):
        if not len(i):
            return i, j
        own = known[:, t]
        new = own[i, 0] != own[j, 0]
        same = np.flatnonzero(~new)
        new[same] = (own[i[same], 1:] != own[j[same], 1:]).all(axis=1)
        i, j = i[new], j[new]
    used = np.zeros(len(rows), np.bool_)
    used[i] = used[j] = True
    place = np.cumsum(used) - 1
    exact = unit(rows[used]) if len(i) else rows
    hit = np.empty(len(i), np.bool_)
    for at in range(0, len(i), 65_536):
        p, q = place[i[at : at + 65_536]], place[j[at : at + 65_536]]
        hit[at : at + 65_536] = np.einsum("ij,ij->i", exact[p], exact[q]) >= threshold
    return i[hit], j[hit]


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the links i-j lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(group: dict[str, np.ndarray], table_of: Callable[[int], int], bits: int, threshold: float) -> pa.RecordBatch:
    """For each vector of a task with links the weight linked to it and the smallest vector that it hangs together
    with there. ``group`` holds vectors of one length: some cells, or pairs of blocks."""
    numbers, slot = np.unique(group["unit"], return_inverse=True)
    side, cid, weight, rows = (group[c] for c in ("side", "cid", "weight", "v"))
    n, fine = len(cid), fines(bits)
    known = group["cells"].reshape(n, -1, 1 + fine)
    prepare = candidates(*turned_codes(rows, threshold), threshold)
    count, label, every = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def settle():
        nonlocal label, waiting
        for (table, k), found in held.items():
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            i, j = linked(rows, i, j, known, table, k, threshold)
            if len(i):
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                label = _smallest(n, np.concatenate([i, every]), np.concatenate([j, label]))
        held.clear()
        waiting = 0

    order = np.argsort(slot.astype(np.uint16) if len(numbers) < 65536 else slot, kind="stable")
    starts = np.searchsorted(slot[order], np.arange(len(numbers) + 1)).tolist()
    for number, first, stop in zip(numbers.tolist(), starts[:-1], starts[1:], strict=True):
        table, of = table_of(number), order[first:stop]
        if side[of[0]] != BOTH:
            of = of[np.argsort(side[of], kind="stable")]
        for k in range(fine):
            own = known[of, table, 1 + k]
            by = np.argsort(own, kind="stable")  # and by side
            by, own = of[by], own[by]
            pieces = prepare(by)
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if side[by[a]] == BOTH:
                    found = pieces(slice(a, b))
                else:
                    middle = a + int((side[by[a:b]] == LOW).sum())
                    found = pieces(slice(a, middle), slice(middle, b))
                for i, j in found:
                    held.setdefault((table, k), []).append((i, j))
                    waiting += len(i)
                    if waiting > 1 << 20:
                        settle()
    settle()
    some = np.flatnonzero(count)
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label[some], cid[some])
    return pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (cid[some], count[some], smallest[label[some]])], names=["cid", "links", "root"]
    )


def _pack(group: dict[str, np.ndarray]) -> bytes:
    return b"".join(x if x.flags.c_contiguous else np.ascontiguousarray(x) for x in group.values())


def _unpack(row: dict, fields: tuple, kind: str, cell: str) -> dict[str, np.ndarray]:
    """Columns ``fields``, the vectors and their cells of a row that packs some vectors of one length."""
    n, length, data, at, out = row["n"].as_py(), row["length"].as_py(), row["data"].as_buffer(), 0, {}
    for name, dtype in fields:
        out[name] = np.frombuffer(data, dtype, n, at)
        at += n * out[name].itemsize
    data = np.frombuffer(data, np.uint8)
    out["v"] = data[at : at + n * length].view(kind).reshape(n, -1)
    own = data[at + n * length :].view(cell)
    out["cells"] = own.reshape(n, len(own) // n)
    return out


def _packs(batch: pa.RecordBatch):
    return (dict(zip(batch.schema.names, row, strict=True)) for row in zip(*batch.columns, strict=True))


def _blocks_of(cid: np.ndarray, blocks: int) -> np.ndarray:
    mixed = cid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % blocks


def _route(tables: list[int], crowded: dict[int, np.ndarray], units: list[tuple], bits: int):
    """Function from (cid, cells) to the copies of a round: (row, unit, side).

    A round has either all cells of some tables but the crowded ones, or ``units``: pairs of blocks of crowded cells."""
    wide, each = 1 << split(bits)[0], 1 + fines(bits)

    def plain(cid, own):
        for g, t in enumerate(tables):
            value = own[:, t * each].astype(np.int64)
            some = np.flatnonzero(~np.isin(value, crowded[t])) if t in crowded else np.arange(len(value))
            yield some, g * wide + value[some], np.full(len(some), BOTH, np.uint8)

    by_cell: dict[tuple, dict[int, list]] = {}
    for u, (t, cell, blocks, lo, hi) in enumerate(units):
        to = by_cell.setdefault((t, cell, blocks), {})
        for b, side in [(lo, BOTH)] if lo == hi else [(lo, LOW), (hi, HIGH)]:
            to.setdefault(b, []).append((u, side))

    def paired(cid, own):
        for (t, cell, blocks), to in by_cell.items():
            rows = np.flatnonzero(own[:, t * each] == cell)
            block = _blocks_of(cid[rows], blocks)
            for b, aims in to.items():
                some = rows[block == b]
                for u, side in aims:
                    yield some, np.full(len(some), u), np.full(len(some), side, np.uint8)

    return paired if units else plain


def _send(route, most: int, parts: int, kind: str, cell: str):
    """Task that packs a round's copies by the task they go to, each with its first ``most`` cells."""

    def flush(held):
        for length, groups in held.items():
            unit_, side, cid, weight = (np.concatenate([g[k] for g in groups]) for k in range(4))
            part = unit_ % parts
            order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
            rows, own = (np.concatenate([g[k] for g in groups])[order] for k in (4, 5))
            unit_, side, cid, weight = (x[order] for x in (unit_, side, cid, weight))
            starts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist()
            out = [slice(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            columns = {"unit": unit_, "side": side, "cid": cid, "weight": weight, "v": rows, "cells": own}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(unit_[o.start]) % parts for o in out], pa.int32()),
                    pa.array([o.stop - o.start for o in out], pa.int32()),
                    pa.array([length] * len(out), pa.int32()),
                    pa.array([_pack({c: x[o] for c, x in columns.items()}) for o in out], pa.binary()),
                ],
                names=["part", "n", "length", "data"],
            )
        held.clear()

    def run(batches):
        held: dict[int, list[tuple]] = {}
        size = 0
        for batch in batches:
            for row in _packs(batch):
                group = _unpack(row, PLACED, kind, cell)
                for at, unit_, side in route(group["cid"], group["cells"]):
                    if not len(at):
                        continue
                    copy = (group["cid"], group["weight"], group["v"], group["cells"][:, :most])
                    if len(at) < len(group["cid"]):
                        copy = tuple(x[at] for x in copy)
                    held.setdefault(row["length"].as_py(), []).append((unit_.astype(np.int32), side, *copy))
                    size += len(at) * (row["length"].as_py() + 32)
                if size > HELD:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return run


def _receive(table_of, bits: int, kind: str, cell: str, threshold: float):
    def run(batches):
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in _packs(batch):
                held.setdefault(row["length"].as_py(), []).append(_unpack(row, SENT, kind, cell))
        for length in list(held):
            groups = held.pop(length)
            whole = {c: np.concatenate([g.pop(c) for g in groups]) for c in list(groups[0])}
            yield _meet(whole, table_of, bits, threshold)

    return run


def _place(classes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """``classes`` with the cells of each vector, many in a row."""

    def run(batches):
        for batch in batches:
            for length, some in _by_length(batch, "v"):
                for at in range(0, some.num_rows, PACK):
                    part = some.slice(at, PACK)
                    rows = _rows(part.column("v"), kind)
                    own = cells(rows, bits, tables)
                    data = _pack({c: part.column(c).to_numpy() for c in ("cid", "weight")} | {"v": rows, "cells": own})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.num_rows], pa.int32()), pa.array([length], pa.int32()), pa.array([data], pa.binary())],
                        names=["n", "length", "data"],
                    )

    return classes.select("cid", "weight", "v").mapInArrow(run, "n int, length int, data binary")


def _crowded(placed: DataFrame, bits: int, tables: int, limit: int, kind: str) -> list[tuple[int, int, int]]:
    """(table, cell, vectors) of the cells above the limit. Each task sends one histogram a table."""
    cell, each, wide = cell_kind(bits), 1 + fines(bits), 1 << split(bits)[0]

    def count(batches):
        found: list[dict[int, int]] = [{} for _ in range(tables)]
        sums = np.zeros((tables, wide), np.int64) if wide <= 1 << 16 else None
        for own in (_unpack(row, PLACED, kind, cell)["cells"][:, ::each] for batch in batches for row in _packs(batch)):
            for t in range(tables):
                if sums is not None:
                    sums[t] += np.bincount(own[:, t], minlength=wide)
                else:
                    for value, n in zip(*(x.tolist() for x in np.unique(own[:, t], return_counts=True)), strict=True):
                        found[t][value] = found[t].get(value, 0) + n
        for t in range(tables):
            own = np.flatnonzero(sums[t]) if sums is not None else np.array(sorted(found[t]), np.int64)
            n = sums[t][own] if sums is not None else np.array([found[t][c] for c in own.tolist()], np.int64)
            yield pa.RecordBatch.from_pydict({"table": [t], "cell": [own.astype("<i8").tobytes()], "n": [n.astype("<i8").tobytes()]})

    def fold(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for t, cell, n in zip(*(batch.column(c).to_pylist() for c in ("table", "cell", "n")), strict=True):
                both = sums.setdefault(t, [])
                both.append((np.frombuffer(cell, "<i8"), np.frombuffer(n, "<i8")))
                if len(both) > 8:
                    sums[t] = [_folded(both)]
        for t, both in sums.items():
            cell, n = _folded(both)
            some = n > limit
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(int(some.sum()), t), pa.int64()), pa.array(cell[some]), pa.array(n[some])], names=["table", "cell", "n"]
            )

    counted = placed.mapInArrow(count, "table long, cell binary, n binary").repartition("table")
    return sorted(tuple(r) for r in counted.mapInArrow(fold, "table long, cell long, n long").collect())


def _folded(both: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    cell, at = np.unique(np.concatenate([c for c, _ in both]), return_inverse=True)
    n = np.zeros(len(cell), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in both]))
    return cell, n


def _rounds(tables: int, crowded: list[tuple[int, int, int]], vectors: int, limit: int, many: int):
    """(tables, units, copies) of each round. No round sends more than ``many`` copies of the table, or a pair of blocks."""
    hot: dict[int, list[int]] = {}
    for t, cell, n in crowded:
        hot.setdefault(t, []).append(n)
    whole = [t for t in range(tables) if sum(hot.get(t, [])) < vectors]
    for at in range(0, len(whole), many):
        yield whole[at : at + many], [], sum(vectors - sum(hot.get(t, [])) for t in whole[at : at + many])
    units, copies = [], 0
    for t, cell, n in crowded:
        blocks = -(-n // limit)
        for off in range(blocks // 2 + 1):
            for lo in range(blocks if 2 * off != blocks else blocks // 2):
                own = -(-n // blocks) * (2 if off else 1)
                if units and copies + own > many * vectors:
                    yield [], units, copies
                    units, copies = [], 0
                units.append((t, cell, blocks, lo, (lo + off) % blocks))
                copies += own
    if units:
        yield [], units, copies


def near_links(classes: DataFrame, threshold: float = THRESHOLD, kind: str = "<f8", path: str | None = None) -> DataFrame:
    """(cid, links, root) of the tasks over ``classes`` (cid, weight, v: bytes of numbers of ``kind``). Where the vectors
    are staged with their cells, ``path``, under which ``classes`` lie, is removed."""
    spark = classes.sparkSession
    vectors, width = classes.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(1))).collect()[0]
    bits, count = layout(vectors, threshold, width)
    tables, each = count // fines(bits), 1 + fines(bits)
    cell, cores = cell_kind(bits), spark.sparkContext.defaultParallelism
    placed = _place(classes, bits, count, kind)
    limit = max(2, min(BLOCK, CELL // width))
    own = None
    if bits:
        own = fresh_path(spark, "placed")
        placed.write.option("compression", "uncompressed").parquet(own)  # random digits
        placed = spark.read.schema(placed.schema).parquet(own)
        if path:
            remove(spark, path)
        crowded = _crowded(placed, bits, tables, limit, kind)
    else:
        limit = min(limit, max(2048, 2 * -(-vectors // max(2, math.isqrt(6 * cores)))))
        crowded = [(0, 0, vectors)] if vectors > limit // 2 else []
    hot = {t: np.array([c for u, c, _ in crowded if u == t]) for t in {t for t, _, _ in crowded}}
    many = min(8, max(1, ROUND // max(1, vectors * width)))
    found, shape = fresh_path(spark, "near-links"), "cid long, links long, root long"
    spark.createDataFrame([], shape).write.parquet(found)
    for of, units, copies in _rounds(tables, crowded, vectors, limit // 2, many):
        most = (1 + max(of or [t for t, *_ in units])) * each
        least = max(1, copies * (width + 32 + most * np.dtype(cell).itemsize) // HELD, min(2 * cores, copies // 4096))
        wide = len(of) << split(bits)[0]
        parts = len(units) or -(-wide // max(1, wide // least))  # as many cells in each
        table_of = _table_of(of, units, bits)
        route = _route(of, {t: hot[t] for t in of if t in hot}, units, bits)
        sent = placed.mapInArrow(_send(route, most, parts, kind, cell), "part int, n int, length int, data binary")
        met = sent.repartitionById(parts, F.col("part")).mapInArrow(_receive(table_of, bits, kind, cell, threshold), shape)
        met.write.mode("append").parquet(found)
    if own:
        remove(spark, own)
    return spark.read.schema(shape).parquet(found)


def _table_of(of: list[int], units: list[tuple], bits: int) -> Callable[[int], int]:
    return (lambda unit_: units[unit_][0]) if units else (lambda unit_: of[unit_ >> split(bits)[0]])


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _vectors(batch.column(1), kind)], names=["vec_id", "v"])

    ids = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("e"))
    paths = [fresh_path(spark, name) for name in ("vectors", "vector-classes")]
    key = F.unhex(F.sha2("v", 256)).alias("key")  # tells vectors apart where they need not travel
    with freed_shuffles(spark):
        known = ids.mapInArrow(read, "vec_id long, v binary")
        known.write.parquet(paths[0])
        known = spark.read.schema(known.schema).parquet(paths[0])
        usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        classes = known.where(usable).groupBy("v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("weight"))
        classes.write.parquet(paths[1])
        classes = spark.read.schema(classes.schema).parquet(paths[1])
        rows = stage(known.select("vec_id", F.when(usable, key).alias("key")), "vector-keys")
        remove(spark, paths[0])
        slim = stage(classes.select("cid", "weight", key), "class-keys")
        found = near_links(classes, threshold, kind, paths[1])
        counts = stage(found.groupBy("cid").agg(F.sum("links").alias("links")), "link-counts")
        joined = stage(components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "link-components")
        remove(spark, paths[1])
    told = (
        slim.join(counts, "cid", "left")
        .join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .select(
            "key",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "cid").alias("component_id"),
        )
    )
    members = rows.where(F.col("key").isNotNull()).join(told, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
