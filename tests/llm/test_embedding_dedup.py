import numpy as np
import pytest

from threadlens.llm import embedding_dedup as e


def brute(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and len(v)}
    ok = {i: v for i, v in ok.items() if np.isfinite(v).all() and v.any()}
    links = {i: set() for i, _ in vectors}
    for i, x in ok.items():
        for j, y in ok.items():
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i].add(j)
    component = {}
    for i in sorted(links):
        todo, seen = [i], set()
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += links[k]
        component[i] = min(seen)
    return {(i, len(links[i]), component[i], component[i] == i) for i in links}


def clustered(rng, groups, each, dim, noise):
    centres = rng.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    return np.repeat(centres, each, axis=0) + noise * rng.standard_normal((groups * each, dim)) / np.sqrt(dim)


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], f"vec_id long, embedding array<{kind}>")


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)  # crowded bands are cut into blocks
    rng = np.random.default_rng(1)
    rows = clustered(rng, 40, 8, 32, 0.25).astype(np.float32)
    rows[7] = rows[3]
    vectors = list(enumerate(rows))
    got = {tuple(r) for r in e.embedding_dedup(frame(spark, vectors)).collect()}
    assert got == brute(vectors)
    assert any(n for _, n, _, _ in got)


def test_links_at_the_threshold(spark):
    """Pairs just above 0.9 are found with the documented recall, pairs just below make no link."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(600):
        x = rng.standard_normal(64)
        y = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cos = 0.901 if k % 2 else 0.899
        rows += [x, cos * x + np.sqrt(1 - cos * cos) * y]
    found = {r.vec_id: r.n_links for r in e.embedding_dedup(frame(spark, list(enumerate(rows)), "double")).collect()}
    above = [found[4 * k + 2] for k in range(300)]
    below = [found[4 * k] for k in range(300)]
    assert sum(above) >= 0.99 * len(above) and not any(below)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    rows = clustered(rng, 30, 10, 64, 0.5)
    bits, tables = e.layout(100_000)
    codes, factors = e.encode(rows, bits, tables)
    exact = e.unit(rows)
    turned = exact @ e.rotation(64, bits, tables)
    turns = factors.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, : turns * 64].astype(float) * 2 - 1
    estimate = (signs * np.repeat(1 / (turns * 8 * factors), 64, axis=1)) @ turned.T
    error = estimate - exact @ exact.T
    spread = np.sqrt(((1 - factors**2) / factors**2).sum(axis=1) / 63) / turns
    off = ~np.eye(len(rows), dtype=bool)
    assert abs(error[off].mean()) < 0.005
    assert (np.abs(error) <= e.SIGMAS * spread[:, None])[off].mean() > 0.9999


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]),
        (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e30, 0.0]),
    ]
    got = {tuple(r) for r in e.embedding_dedup(frame(spark, vectors)).collect()}
    assert got == brute(vectors)
    assert (6, 3, 6, True) in got
    nulls = e.embedding_dedup(frame(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0])])).collect()
    assert {tuple(r) for r in nulls} == {(None, 0, None, True), (1, 0, 1, True)}
    assert e.embedding_dedup(frame(spark, [])).count() == 0
    twice = e.embedding_dedup(frame(spark, [(3, [1.0, 0.0]), (3, [1.0, 0.0])])).collect()
    assert [tuple(r) for r in twice] == [(3, 1, 3, True)] * 2


def test_other_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.1])]).withColumns({c: F.lit(c) for c in ("v", "cid", "weight", "label")})
    assert {r.n_links for r in e.embedding_dedup(df).collect()} == {1}


def pairs_at(rng, n, dim, cos):
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    return x, cos * x + np.sqrt(1 - cos * cos) * y


def missed(vectors, n, dim, seed=11):
    """Of ``n`` pairs at 0.9001, those that share no band."""
    rng, bad = np.random.default_rng(seed), 0
    layout = e.layout(vectors)
    for at in range(0, n, 10_000):
        x, y = pairs_at(rng, min(10_000, n - at), dim, 0.9001)
        a, b = (e.bands(e.encode(rows, *layout)[0], *layout) for rows in (x, y))
        bad += int((a != b).all(axis=1).sum())
    return bad


@pytest.mark.parametrize(("vectors", "dim"), [(2_000, 64), (51_000, 64), (51_000, 8), (51_000, 2)])
def test_hardly_a_pair_at_the_threshold_shares_no_band(vectors, dim):
    assert missed(vectors, 20_000, dim) <= 1


def by_cells(monkeypatch, **other):
    """Vectors meet in cells, as large tables do, and the first tables' cells are told from later ones'."""
    for name, value in {"EXACT": 64, "ROUND": 1, **other}.items():
        monkeypatch.setattr(e, name, value)


@pytest.mark.parametrize("other", [{}, {"BLOCK": 40}, {"ROUND": 1 << 20, "TILE": 16, "PACK": 10, "HELD": 20_000}])
def test_cells_against_brute_force(spark, monkeypatch, other):
    by_cells(monkeypatch, **other)
    rng = np.random.default_rng(3)
    near = clustered(rng, 10, 40, 24, 0.3)  # crowded with BLOCK = 40
    rows = np.concatenate([near, 3 * rng.standard_normal((200, 24)), near[:20]])
    vectors = [*enumerate(rows), (900, None), *enumerate(clustered(rng, 5, 8, 3, 0.3), 1000), (1100, 1e300 * rows[0])]
    assert e.layout(len(vectors))[1] > 10
    got = e.embedding_dedup(frame(spark, vectors, "double")).collect()
    assert {tuple(r) for r in got} == brute([(i, v if i != 1100 else rows[0]) for i, v in vectors])
    assert len(got) == len(vectors) and sum(r.n_links for r in got) > 1000


def test_disk_holds_the_vectors_and_one_round(spark, monkeypatch):
    """Not a copy of each vector for each table: these would be more than twenty times the input."""
    import threading
    from pathlib import Path

    from threadlens.session import run_dir

    by_cells(monkeypatch)
    rows = np.random.default_rng(4).standard_normal((20_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<float>")
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    roots = [str(x) for x in disk.localDirs()] + [run_dir(spark).removeprefix("file://")]

    def used():
        out = 0
        for root in roots:
            for f in Path(root).rglob("*"):
                try:
                    out += f.stat().st_size if f.is_file() else 0
                except OSError:
                    pass
        return out

    spark._jvm.System.gc()
    floor, peak, done = used(), 0, threading.Event()

    def watch():
        nonlocal peak
        while not done.wait(0.05):
            peak = max(peak, used() - floor)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        result = e.embedding_dedup(df)
    finally:
        done.set()
        watcher.join()
    assert peak < 6 * rows.nbytes  # at most four at any size, and what small files add
    assert used() - floor < rows.nbytes  # keys and counts stay until the result is read
    assert result.count() == len(rows)


def test_a_round_sends_no_more_than_its_share():
    crowded = [(0, 5, 100), (2, 1, 900), (2, 7, 33)]
    rounds = list(e._rounds(4, crowded, 1000, 30, 1))
    assert [t for of, units, _ in rounds for t in of] == [0, 1, 2, 3]
    assert all(copies <= 1000 for *_, copies in rounds)
    met = [u for _, units, _ in rounds for u in units]
    pairs = {(t, cell): sorted(tuple(sorted(x[3:])) for x in met if x[:2] == (t, cell)) for t, cell, _ in crowded}
    for (t, cell, n), found in zip(crowded, pairs.values(), strict=True):
        blocks = -(-n // 30)
        assert found == [(a, b) for a in range(blocks) for b in range(a, blocks)]


def test_candidates_lose_no_link():
    rng = np.random.default_rng(6)
    for dim in (1, 2, 5, 64, 200):
        for rows in (rng.standard_normal((700, dim)), clustered(rng, 7, 100, dim, 0.45), clustered(rng, 70, 10, dim, 0.45)):
            for kind in (np.float32, np.float64):
                own = rows.astype(kind)
                pieces = e.candidates(*e.turned_codes(own, 0.9), 0.9)(np.arange(700))
                true = {(i, j) for i, j in zip(*np.nonzero(np.triu(e.unit(own) @ e.unit(own).T >= 0.9, 1)), strict=True)}
                for slices in ([(slice(0, 700),)], [(slice(0, 300),), (slice(300, 700),), (slice(0, 300), slice(300, 700))]):
                    found = [x for s in slices for i, j in pieces(*s) for x in zip(i, j, strict=True)]
                    assert len(found) == len(set(found))
                    assert true <= {(min(x), max(x)) for x in found}


@pytest.mark.parametrize(("vectors", "dim"), [(200_000, 64), (22_000_000, 64), (15_000_000, 64), (15_000_000, 8), (15_000_000, 2), (15_000_000, 300)])
def test_hardly_a_pair_at_the_threshold_shares_no_cell(vectors, dim):
    assert missed(vectors, 20_000, dim) <= 1


def test_pairs_share_cells_as_often_as_said():
    rng = np.random.default_rng(8)
    for dim in (2, 8, 64):
        x, y = pairs_at(rng, 20_000, dim, 0.9)
        for bits in (8, 10, 14, 15):
            a, b = (e.bands(e.encode(rows, bits, 12)[0], bits, 12).reshape(len(rows), 3, e.FINE) for rows in (x, y))
            assert (a == b).any(axis=2).mean() > e.agreement(bits, 0.9) - 0.01


def test_vectors_cells_and_a_round_take_less_than_four_times_the_input():
    """Bytes on disk at once for a vector of 64 numbers: its table, a copy sent in the last round, and keys."""
    for vectors in (140_000, 1_000_000, 15_000_000, 22_000_000, 33_000_000):
        bits, count = e.layout(vectors)
        own = count // e.fines(bits) * (1 + e.fines(bits)) * np.dtype(e.cell_kind(bits)).itemsize
        assert 2 * (256 + 21 + own) + 96 < 4 * 256
