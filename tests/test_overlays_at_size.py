"""Overlays of many small shapes: whole batches at once, in several tasks."""

import time

import numpy as np
import pytest

from aerolith.operators import polygons as P
from aerolith.plans import registry


@pytest.mark.parametrize("name", ["st_overlaps", "st_union", "st_makevalid"])
def test_one_file_is_cut_by_several_tasks(spark, folder, name):
    assert registry.queries()[name](spark, folder).rdd.getNumPartitions() >= 4


def star(r, n, cx, cy):
    t = np.sort(r.uniform(0, 2 * np.pi, n))
    ring = np.stack([cx + r.uniform(1, 9, n) * np.cos(t), cy + r.uniform(1, 9, n) * np.sin(t)], axis=1)
    return np.round(np.vstack([ring, ring[:1]]), int(r.integers(0, 3)))


def test_a_batch_is_as_its_rows():
    r = np.random.default_rng(1)
    a = [[star(r, int(r.integers(3, 12)), 0, 0) for _ in range(int(r.integers(0, 3)))] for _ in range(60)]
    b = [[star(r, int(r.integers(3, 12)), *r.uniform(-5, 5, 2))] for _ in range(60)]
    both = P._two(P.as_column(a), P.as_column(b))
    for how in P.OPERATIONS:
        got = P._nested(*both.regions(P._taken(how)))
        for x, y, z in zip(a, b, got, strict=True):
            want = P.overlay(x, y, how)
            assert len(want) == len(z) and all((u == v).all() for u, v in zip(want, z, strict=True))


def test_overlaps(spark):
    box = lambda x, y, w: [[{"x": float(u), "y": float(v)} for u, v in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]]
    cases = [(box(0, 0, 4), box(2, 2, 4), True), (box(0, 0, 4), box(1, 1, 2), False), (box(1, 1, 2), box(0, 0, 4), False), (box(0, 0, 4), box(4, 0, 4), False), (box(0, 0, 4), box(0, 0, 4), False), (box(0, 0, 4), box(9, 9, 1), False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"id int, a {P.RINGS}, b {P.RINGS}")
    assert [x.o for x in df.select("id", P.overlaps("a", "b").alias("o")).orderBy("id").collect()] == [w for *_, w in cases]


def boxes(n, pitch, width):
    return [[np.array([(x, y), (x + width, y), (x + width, y + width), (x, y + width), (x, y)], float)] for x in np.arange(n) * pitch for y in np.arange(n) * pitch]


def test_many_outlines_unite_at_once():
    began = time.perf_counter()
    whole, apart = P.union(boxes(70, 25.0, 30.0)), P.union(boxes(70, 25.0, 20.0))
    assert time.perf_counter() - began < 10
    assert len(whole) == 1 and len(whole[0]) == 5 and P.area(whole) == (69 * 25 + 30) ** 2
    assert len(apart) == 4900 and P.area(apart) == 4900 * 400
    frame = P.overlay([boxes(1, 1.0, 100.0)[0][0]], [boxes(1, 1.0, 60.0)[0][0] + 20], "minus")
    assert P.area(P.union([frame, boxes(1, 1.0, 30.0)[0]])) == 6400 + 100 and P.area(P.union([frame, frame])) == 6400


def test_groups_lose_all_their_others():
    r = np.random.default_rng(3)
    a = [[star(r, 8, 0, 0)] for _ in range(9)]
    sizes = [0, 1, 30, 2, 0, 5, 55, 1, 3]
    others = [[star(r, 5, *r.uniform(-9, 9, 2))] for _ in range(sum(sizes))]
    got = P.regions_of(P.minus_groups(P.as_column(a), P.as_column(others), np.repeat(np.arange(9), sizes)))
    for k, (x, z) in enumerate(zip(a, got, strict=True)):
        own = others[sum(sizes[:k]) : sum(sizes[: k + 1])]
        assert abs(P.area(z) - P.area(P.minus_all(P.valid(x), own))) < 1e-3 or not sizes[k]


def test_groups_go_on_in_the_next_batch(spark):
    ring = lambda x, y, w: [[{"x": float(u), "y": float(v)} for u, v in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))]]
    a = spark.createDataFrame([(i, ring(10 * i, 0, 8)) for i in range(12)], f"id int, rings {P.RINGS}")
    b = spark.createDataFrame([(100 * i + k, ring(10 * i + k, 0, 1)) for i in range(11) for k in range(7)], f"id int, rings {P.RINGS}")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {x.id: x.s for x in P.difference(a, b, 8.0).select("id", P.area_of("rings").alias("s")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 57.0 for i in range(11)} | {11: 64.0}
