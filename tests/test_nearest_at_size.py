"""The nearest of many points that crowd at few places."""

import time

import numpy as np

from aerolith.operators import joins as J


def test_crowds_at_few_places(spark):
    """30 000 points at 360 places against 6 000 at 600: 180 million pairs within the radius, were each to be looked at."""
    a = spark.range(30_000).selectExpr("id", "(id % 24) * 0.5D AS x", "(id % 15) * 0.6D AS y")
    b = spark.range(6_000).selectExpr("id + 10 AS id", "(id * 7 % 30) * 0.4D AS x", "(id * 11 % 20) * 0.45D AS y")
    J.nearest_any(a.limit(9), b.limit(9), 50.0).collect()
    began = time.perf_counter()
    got = J.nearest_any(a, b, 50.0).toPandas().set_index("id").sort_index()
    assert time.perf_counter() - began < 20
    p, q = a.toPandas(), b.toPandas()
    assert len(got) == len(p)
    for i in range(0, 30_000, 97):
        d = np.round(np.hypot(q.x - p.x[i], q.y - p.y[i]), 9)
        assert got.near_id[i] == q.id[d == d.min()].min()
        assert abs(got.dist[i] - d.min()) < 1e-8


def test_apart_at_one_place_and_none(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, x double, y double")
    a = frame([(1, 0.0, 0.0), (2, -0.0, 0.0), (3, 1000.0, 0.0), (4, None, 0.0), (5, float("nan"), 0.0)])
    rows = lambda b: sorted((r.id, r.near_id, r.dist) for r in J.nearest_any(a, frame(b), 1.0).collect())
    assert rows([(8, 3.0, 4.0), (7, 3.0, 4.0)]) == [(1, 7, 5.0), (2, 7, 5.0), (3, 7, float(np.hypot(997, 4)))]
    assert rows([(8, 0.0, 0.0), (9, 1000.0, 0.0), (6, 1000.0, 5.0)]) == [(1, 8, 0.0), (2, 8, 0.0), (3, 9, 0.0)]
    assert rows([]) == []
