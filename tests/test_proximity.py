import math
import random

import numpy as np
import pytest

from aerolith.operators.proximity import EARTH, contained, located, near_pairs, rings_of_wkt


def sphere(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("centre", [(2.0, 48.0), (179.99995, 10.0), (-180.0, -60.0), (30.0, 89.9999), (0.0, -89.99995), (10.0, 75.0)])
def test_near(spark, centre):
    r = random.Random(5)
    pts = []
    for i in range(400):
        lat = max(-90.0, min(90.0, centre[1] + r.uniform(-1, 1) * 0.0009))
        lon = centre[0] + r.uniform(-1, 1) * 0.0009 / max(math.cos(math.radians(centre[1])), 1e-5)
        pts.append((i, (lon + 180) % 360 - 180 if i % 17 else 180.0, lat))
    got = [(x.a_id, x.b_id) for x in near_pairs(spark.createDataFrame(pts, "id bigint, lon double, lat double"), 15.0).collect()]
    want = {(a[0], b[0]) for i, a in enumerate(pts) for b in pts[i + 1 :] if sphere(a[1:], b[1:]) <= 15}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_spot(spark):
    n = 700
    pts = spark.range(n).selectExpr("id", "CAST(2 AS DOUBLE) AS lon", "CAST(48 AS DOUBLE) AS lat")
    assert near_pairs(pts, 15.0).distinct().count() == n * (n - 1) // 2


def test_located(spark):
    data = [(1, 0.0, 0.0), (2, None, 1.0), (3, 181.0, 1.0), (4, 5.0, -90.5), (5, 1.0, 2.0), (5, 1.0, 2.0), (6, float("nan"), 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "p bigint, lon double, lat double")
    assert [tuple(r) for r in located(df, "p", "lon", "lat").collect()] == [(5, 1.0, 2.0)]
    assert near_pairs(located(df, "p", "lon", "lat"), 15.0).count() == 0
    assert near_pairs(located(df.limit(0), "p", "lon", "lat"), 15.0).count() == 0


def test_inside(spark):
    wkt = "MULTIPOLYGON (((0 0, 3 0, 3 3, 0 3, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1)), ((5 5, 6 5, 5.5 6, 5 5)))"
    zones = spark.createDataFrame([(10, wkt), (11, None), (12, "POINT (1 1)"), (10, wkt)], "z bigint, g string")
    r = np.random.default_rng(2)
    xy = np.round(r.uniform(-1, 7, (2000, 2)), 6)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id bigint, lon double, lat double")
    got = {(x.id, x.region) for x in contained(pts, zones, "z", "g").collect()}
    want = set()
    for i, (x, y) in enumerate(xy):
        hit = 0
        for ring in rings_of_wkt(wkt):
            for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
                hit += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        if hit % 2:
            want.add((i, 10))
    assert got == want


def test_tree_discards_accepts_and_refines(spark):
    """100 000 points in one crowded quarter but apart: few pairs of leaves are left; 2 000 on one spot: accepted without a distance."""
    from aerolith.operators.proximity import FAN, LEAF, near_leaves, point_tree

    r = np.random.default_rng(9)
    n = 100_000
    side = 320  # about 10 m apart, every point has few neighbours
    k = np.arange(n)
    lon, lat = 2 + (k % side) * 1.35e-4 + r.uniform(0, 1e-5, n), 48 + (k // side) * 9e-5 + r.uniform(0, 1e-5, n)
    pts = spark.createDataFrame([(int(i), float(x), float(y)) for i, x, y in zip(k, lon, lat, strict=True)] + [(int(n + i), 7.0, -30.0) for i in range(2000)], "id bigint, lon double, lat double")
    tree = point_tree(pts)
    leaves = tree.leaves.count()
    assert leaves <= (n + 2000) / LEAF + 64 and tree.height >= 2 and FAN == 64
    left = near_leaves(tree, 15.0)
    certain, open_ = left.where("certain").count(), left.where("not certain").count()
    assert 60 * 61 // 2 <= certain <= 70 * 71 // 2  # the spot's leaves, all pairs of them
    assert leaves <= open_ < 16 * leaves  # of 5 million pairs
    assert near_pairs(tree, 15.0).where("a_id >= 100000").count() == 2000 * 1999 // 2


def test_inside_ragged(spark):
    """A long ragged region over many cells, against the rule applied to all edges."""
    r = np.random.default_rng(3)
    top = [(i / 50, 1 + 0.3 * math.sin(i) + r.uniform(0, 0.4)) for i in range(200)]
    ring = [*top, (4.0, -0.5), (0.0, -0.5), top[0]]
    wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "))"
    xy = r.uniform((-0.2, -0.7), (4.2, 2.0), (4000, 2))
    got = {x.id for x in contained(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id bigint, lon double, lat double"), spark.createDataFrame([("r", wkt)], "z string, g string"), "z", "g").collect()}
    (ring,) = rings_of_wkt(wkt)
    want = {i for i, (x, y) in enumerate(xy) if sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True)) % 2}
    assert got == want
