"""Reach over small graphs against a plain search."""

import pytest

from threadlens.operators import skew
from threadlens.operators.closure import chain, closure, extend_closure


def search(seeds, edges, gate):
    depth = {s: 0 for s in seeds if s in gate}
    layer = list(depth)
    while layer:
        nxt = [d for s in layer for x, d in edges if x == s and d in gate and d not in depth]
        layer = list(dict.fromkeys(nxt))
        depth.update({n: max(depth.values()) + 1 for n in layer})
    return depth


def frames(spark, seeds, edges, gate):
    return (
        spark.createDataFrame([(s,) for s in seeds], "node long"),
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame([(g,) for g in gate], "node long"),
    )


GRAPHS = [
    ([0], [(0, 1), (1, 2), (2, 0), (2, 3), (3, 9), (9, 4)], [0, 1, 2, 3, 4]),
    ([5], [(0, 1)], [0, 1]),
    ([0, 6, 7], [(i, (i * 3 + 1) % 40) for i in range(40)] + [(i, i + 1) for i in range(0, 40, 2)], [i for i in range(40) if i % 7]),
]


@pytest.mark.parametrize("seeds,edges,gate", GRAPHS)
def test_closure(spark, seeds, edges, gate):
    got = {r.node: r.depth for r in closure(*frames(spark, seeds, edges, gate)).collect()}
    assert got == search(seeds, edges, set(gate))


@pytest.mark.parametrize("seeds,edges,gate", GRAPHS)
def test_closure_with_hub_pages(spark, monkeypatch, seeds, edges, gate):
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    edges = edges + [(0, d) for d in range(1, 30)]
    got = {r.node: r.depth for r in closure(*frames(spark, seeds, edges, gate)).collect()}
    assert got == search(seeds, edges, set(gate))


@pytest.mark.parametrize("limit", [1, 1 << 60])
def test_extended_closure_is_the_closure_of_all(spark, monkeypatch, limit):
    """Shortcuts lower the depth of pages found before; some pages are new, one new edge leaves a page out of reach."""
    monkeypatch.setattr(skew, "HOT_ROWS", limit)
    early = [(i, i + 1) for i in range(20)] + [(0, d) for d in (50, 51, 52)]
    late = [(0, 8), (8, 16), (3, 4), (30, 31), (16, 30), (40, 41), (0, 99)]
    gate = [g for g in range(60) if g != 12]
    seeds, edges, pages = frames(spark, [0], early, gate)
    more, new, _ = frames(spark, [18, 12], late, gate)
    known = closure(seeds, edges, pages)
    got = extend_closure(known, edges, new, pages, more)
    assert {r.node: r.depth for r in got.collect()} == search([0, 18], early + late, set(gate))
    same = extend_closure(known, edges, new.limit(0), pages)
    assert sorted(same.collect()) == sorted(known.collect())
    near = extend_closure(known, edges, new, pages, more, max_depth=3).where("depth <= 3")
    assert {r.node: r.depth for r in near.collect()} == {n: d for n, d in search([0, 18], early + late, set(gate)).items() if d <= 3}


def test_depth_limit(spark):
    edges = [(i, i + 1) for i in range(20)]
    got = closure(*frames(spark, [0], edges, range(21)), max_depth=12).collect()
    assert sorted(r.node for r in got) == list(range(13))


CHAINS = [
    ([0], [(i, i + 1) for i in range(60)], [i for i in range(61) if i != 45]),
    ([3, 10, 30], [(i, i + 1) for i in range(60)], range(61)),
    ([0, 2], [(0, 1), (1, 2), (2, 3), (3, 1)], range(4)),
    ([0, 1, 2, 3], [(i, 9) for i in range(9)] + [(9, 10)], range(11)),
    ([8], [(0, 1)], range(9)),
]


@pytest.mark.parametrize("seeds,edges,gate", CHAINS)
def test_chain(spark, seeds, edges, gate):
    got = {r.node: r.depth for r in chain(*frames(spark, seeds, edges, gate)).collect()}
    assert got == search(seeds, edges, set(gate))
