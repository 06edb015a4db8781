import random
from collections import Counter

from pyspark.sql import functions as F

from threadlens.llm import packing
from threadlens.llm.packing import cost, downsized, opening, pack, plan


def one_by_one(histogram, sizes):
    """Best-fit decreasing, a piece at a time. Returns how many sequences there are of each size and fill (which
    of several sequences with equal room takes a piece is open)."""
    lengths = sorted(histogram.items())
    bins = []
    for k in range(len(lengths) - 1, -1, -1):
        length, count = lengths[k]
        size = None
        for n in range(count):
            fits = [b for b in bins if b[0] - sum(b[1]) >= length]
            if fits:
                min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(length)
                continue
            if size is None:
                size = opening(length, count - n, lengths[:k], sizes, cost)
            bins.append((size, [length]))
    return Counter((downsized(sum(c), sizes), sum(c)) for _, c in bins)


def contents(rows):
    """Sequences by size and fill from packed rows, with checks that pieces lie one behind the other."""
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_start, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    out = Counter()
    for (_, size), held in bins.items():
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at <= size
        out[size, at] += 1
    return out


def lengths(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, n long")


def test_plan_is_best_fit(spark):
    rnd = random.Random(4)
    for sizes in ((16, 32, 64), (64,), (8, 64)):
        values = [rnd.randrange(1, 65) for _ in range(300)] + [20] * 100
        rows = pack(lengths(spark, values), length=F.col("n"), sizes=sizes).collect()
        assert contents(rows) == one_by_one(Counter(values), sizes)
        assert sorted(r.doc_id for r in rows) == list(range(400))


def test_sizes_are_chosen_jointly():
    sizes = (64, 128)
    # alone, 34 tokens fill the large size better; with 30 tokens to come, the small one
    _, bins = plan({34: 9}, sizes)
    assert {(b.used, downsized(b.used, sizes)) for b in bins} == {(102, 128)}
    _, bins = plan({30: 10, 34: 10}, sizes)
    assert {(b.used, downsized(b.used, sizes)) for b in bins} == {(64, 64)}
    # at the end a sequence is cut down to what it holds
    _, bins = plan({33: 1}, sizes)
    assert [downsized(b.used, sizes) for b in bins] == [64]


def test_never_dearer_than_one_size():
    rnd = random.Random(9)
    histogram = Counter(min(512, int(rnd.paretovariate(0.7) * 10)) for _ in range(5000))
    sizes = (64, 128, 256, 512)
    price = lambda bins: sum(b.count * cost(downsized(b.used, sizes)) for b in bins)
    assert price(plan(histogram, sizes)[1]) <= 1.02 * price(plan(histogram, (512,))[1])


def test_pieces_and_edges(make):
    words = lambda n: " ".join(["w"] * n)
    top = max(packing.SIZES)
    rows = [(1, None, None), (2, "", None), (3, " \n", None), (4, words(2 * top + 5), None), (5, "a b", None), (5, "a b", None), (None, "a", None)]
    got = pack(make(rows, strange=True)).collect()
    assert {(r.doc_id, r.length, r.bin_id) for r in got if not r.length} == {(1, 0, None), (2, 0, None), (3, 0, None)}
    assert sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4) == [(0, 0, top), (1, top, top), (2, 2 * top, 5)]
    assert Counter(r.doc_id for r in got)[5] == 2
    assert sum(r.doc_id is None for r in got) == 1
    contents([r for r in got if r.length])
    assert pack(make([])).count() == 0


def test_one_length_is_spread_over_tasks(spark):
    """A third of all pieces with one length: the same sequences as piece by piece."""
    values = [7] * 2000 + [1 + i % 60 for i in range(4000)]
    got = pack(lengths(spark, values), length=F.col("n"), sizes=(64, 128)).collect()
    assert contents(got) == one_by_one(Counter(values), (64, 128))
