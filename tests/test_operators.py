"""Components, shortest paths, clipping, hulls and ordered joins against brute force."""

import random

import numpy as np
import pytest

from aerolith.operators import clip, components
from aerolith.operators import joins as J


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(0, 299), r.randint(0, 299)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(120)]
    parent = list(range(600))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {x.id: x.component for x in components.connected(spark.range(600), spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: root(i) for i in range(600)}


def test_components_without_links(spark):
    got = components.connected(spark.range(3), spark.createDataFrame([], "a bigint, b bigint")).collect()
    assert sorted((x.id, x.component) for x in got) == [(0, 0), (1, 1), (2, 2)]


def test_shortest(spark):
    import heapq

    r = random.Random(4)
    edges = [(r.randint(0, 60), r.randint(0, 60), float(r.randint(1, 20))) for _ in range(200)]
    best, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        t, n = heapq.heappop(heap)
        if t > best[n]:
            continue
        for a, b, w in edges:
            if a == n and t + w < best.get(b, 1e9):
                best[b] = t + w
                heapq.heappush(heap, (t + w, b))
    got = {x.node: x.t for x in components.shortest(spark.createDataFrame(edges, "tail bigint, head bigint, len double"), 0).collect()}
    assert got == best


def area(r):
    return abs((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 if len(r) else 0.0


def test_clip_against_sampling():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = clip.convex_hull(rng.uniform(0, 10, (8, 2)))
        b = clip.convex_hull(rng.uniform(0, 10, (8, 2)))
        got = area(clip.clip_ring(a, b))
        p = rng.uniform(0, 10, (40000, 2))

        def inside(ring, p=p):
            e = np.diff(ring, axis=0)
            return np.all([e[k, 0] * (p[:, 1] - ring[k, 1]) - e[k, 1] * (p[:, 0] - ring[k, 0]) >= 0 for k in range(len(e))], axis=0)

        assert got == pytest.approx((inside(a) & inside(b)).mean() * 100, abs=1.2)


def test_hull_of_hulls(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.normal(0, 5, (800, 2)), 3)
    got = clip.hulls(spark.createDataFrame([(1, float(x), float(y)) for x, y in p] + [(2, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 1.0)], "k int, x double, y double"), "k").collect()
    rings = {r.k: np.array([(q.x, q.y) for q in r.hull]) for r in got}
    assert area(rings[1]) == pytest.approx(area(clip.convex_hull(p))) and set(rings) == {1, 2}


def test_nearest_any(spark):
    r = random.Random(6)
    a = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(60)]
    b = [(i, r.uniform(0, 400), r.uniform(0, 400)) for i in range(25)] + [(100, 5.0, 5.0), (101, 5.0, 5.0)]
    got = {x.id: x.near_id for x in J.nearest_any(spark.createDataFrame(a, "id bigint, x double, y double"), spark.createDataFrame(b, "id bigint, x double, y double"), 10.0).collect()}
    want = {i: min(b, key=lambda q: (round(((q[1] - x) ** 2 + (q[2] - y) ** 2) ** 0.5, 9), q[0]))[0] for i, x, y in a}
    assert got == want


def test_ranked(spark):
    keys = random.Random(7).sample(range(10**6), 500)
    got = {x.k: x.rank for x in J.ranked(spark.createDataFrame([(k,) for k in keys], "k bigint"), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_crowns_on_a_wide_raster(spark):
    """Two crowns that meet, in a raster wider than a thousand columns; the last column is no neighbour of the next row's first."""
    from aerolith.plans.rasters import _ROW, crowns

    rows = [(0 * _ROW + c, h) for c, h in ((1500, 3.0), (1501, 5.0), (1502, 4.0), (1503, 6.0), (1504, 2.0))] + [(1 * _ROW + 0, 9.0), (1 * _ROW + 1500, 3.0)]
    got = {r.id: r.component for r in crowns(spark.createDataFrame(rows, "id bigint, chm double")).collect()}
    groups = {}
    for i, k in got.items():
        groups.setdefault(k, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted([[1500, 1501, _ROW + 1500], [1502, 1503, 1504], [_ROW]])


def test_patches_have_outlines_and_holes(spark):
    from aerolith.plans.rasters import _patches

    ring = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(10, 2000), (10, 2001)]
    got = sorted((r.area, r.outlines) for r in _patches(spark.createDataFrame(ring, "r bigint, c bigint")).collect())
    assert got == [(2.0, 1), (8.0, 2)]
