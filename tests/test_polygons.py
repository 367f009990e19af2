"""Overlays of concave, overlapping and crossing shapes against point membership."""

import math

import numpy as np
import pytest

from aerolith.operators import polygons as P


def star(r, n, cx=0.0, cy=0.0, size=10.0):
    t = np.sort(r.uniform(0, 2 * math.pi, n))
    d = r.uniform(0.3, 1, n) * size
    ring = np.stack([cx + d * np.cos(t), cy + d * np.sin(t)], axis=1)
    return np.vstack([ring, ring[:1]])


def box(a, b, c, d):
    return np.array([(a, b), (c, b), (c, d), (a, d), (a, b)], float)


@pytest.mark.parametrize("seed", range(12))
def test_random_shapes(seed):
    r = np.random.default_rng(seed)
    a = [star(r, int(r.integers(3, 25)))]
    b = [star(r, int(r.integers(3, 25)), *r.uniform(-6, 6, 2)), star(r, 6, *r.uniform(-6, 6, 2), 3.0)]
    if seed % 3 == 0:  # coordinates that coincide
        a, b = [np.round(x) for x in a], [np.round(x) for x in b]
    out = {h: P.overlay(a, b, h) for h in P.OPERATIONS}
    for x, y in r.uniform(-14, 14, (600, 2)):
        u, v = P.holds(a, x, y), P.holds(b, x, y)
        for h, want in (("and", u and v), ("or", u or v), ("minus", u and not v), ("xor", u != v)):
            assert P.holds(out[h], x, y) == want, (h, x, y)
    assert P.area(out["or"]) == pytest.approx(P.area(out["and"]) + P.area(out["xor"]), abs=1e-4)
    assert P.area(P.overlay(a, [], "or")) == pytest.approx(P.area(out["and"]) + P.area(out["minus"]), abs=1e-4)
    for region in out.values():  # rings of the result are simple: making them valid changes nothing
        assert P.area(P.valid(region)) == pytest.approx(P.area(region), abs=1e-4)
        assert sum(P.area(p) for p in P.polygons(region)) == pytest.approx(P.area(region), abs=1e-6)


def test_known_cases():
    a, b = [box(0, 0, 4, 4)], [box(2, 2, 6, 6)]
    assert P.area(P.overlay(a, b, "and")) == 4 and P.area(P.overlay(a, b, "or")) == 28 and P.area(P.overlay(a, b, "minus")) == 12
    hole = P.overlay([box(0, 0, 9, 9)], [box(3, 3, 6, 6)], "minus")
    assert len(hole) == 2 and P.area(hole) == 72 and len(P.polygons(hole)) == 1
    assert len(P.polygons(P.overlay([box(0, 0, 9, 3)], [box(3, -1, 6, 4)], "minus"))) == 2
    assert P.overlay(a, a, "minus") == [] and P.area(P.overlay(a, a, "or")) == 16
    side = P.overlay(a, [box(4, 0, 8, 4)], "or")  # a common side dissolves
    assert len(side) == 1 and len(side[0]) == 5 and P.area(side) == 32
    bow = [np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)]
    assert P.area(P.valid(bow)) == 2 and len(P.polygons(P.valid(bow))) == 2
    assert P.meets(a, [box(4, 4, 5, 5)]) and not P.meets(a, [box(4.5, 4.5, 5, 5)]) and P.meets(a, [box(1, 1, 2, 2)])
    assert P.covers(a, [box(0, 0, 2, 4)]) and not P.covers(a, b)
    assert P.overlay([], a, "and") == [] and P.overlay([], [], "or") == [] and P.union([]) == []


def layer(spark, shapes):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in g] if g is not None else None) for i, g in shapes], f"id bigint, rings {P.RINGS}")


def test_layers(spark):
    r = np.random.default_rng(4)
    a = [(i, [star(r, 9, *r.uniform(0, 60, 2))]) for i in range(25)] + [(90, None), (91, [])]
    b = [(100 + i, [star(r, 9, *r.uniform(0, 60, 2))]) for i in range(25)]
    A, B = layer(spark, a), layer(spark, b)
    got = P.union_of_layers(A, B, 15.0).select("a_id", "b_id", P.area_of("rings").alias("s")).collect()
    every = P.union([g for _, g in b])
    for i, g in a:
        if g:
            own = [x for x in got if x.a_id == i]
            assert sum(x.s for x in own if x.b_id is None) == pytest.approx(P.area(P.overlay(g, every, "minus")), abs=1e-3)
            for j, h in b:
                assert sum(x.s for x in own if x.b_id == j) == pytest.approx(P.area(P.overlay(g, h, "and")), abs=1e-3)
    assert {x.b_id for x in got if x.a_id is None} <= {j for j, _ in b}
    whole = P.dissolve(A.selectExpr("1 AS k", "rings"), "k", 15.0).select(P.area_of("rings").alias("s")).first().s
    assert whole == pytest.approx(P.area(P.union([g for _, g in a if g])), abs=1e-3)
    assert P.union_of_layers(A.limit(0), B.limit(0), 15.0).count() == 0
