import random

import pytest

from aerolith.operators.gridding import regular_grid


def brute(readings, step, limit):
    r = sorted((t, v) for t, v in readings if t is not None and v is not None)
    if not r:
        return {}
    out = {}
    for k in range(r[0][0] // step, r[-1][0] // step + 1):
        g, inside = k * step, [x for x in r if x[0] // step == k]
        left = [x for x in r if x[0] <= g]
        right = [x for x in r if x[0] >= g]
        value = None
        if inside and (not left or left[-1][0] == g or right[0][0] - left[-1][0] > limit):
            value = inside[0][1]
        elif left and right and right[0][0] - left[-1][0] <= limit:
            a, b = left[-1], right[0]
            value = a[1] if a[0] == b[0] else a[1] + (b[1] - a[1]) * (g - a[0]) / (b[0] - a[0])
        state = "read" if inside else "filled" if right[0][0] - left[-1][0] <= limit else "marked"
        out[g] = (value, len(inside), state)
    return out


@pytest.mark.parametrize("seed, step", [(1, 60), (2, 180), (3, 60)])
def test_against_brute_force(spark, seed, step):
    r = random.Random(seed)
    times = sorted(r.sample(range(0, 60000), 180))
    data = [(7, t, r.choice([round(r.uniform(-5, 25), 1)] * 9 + [None])) for t in times]
    got = regular_grid(spark.createDataFrame(data, "s bigint, t bigint, v double"), spark.createDataFrame([(7, step)], "s bigint, p int"), "s", "t", "v", "p").collect()
    want = brute([(t, v) for _, t, v in data], step, 360)
    assert {g.period for g in got} == set(want)
    for g in got:
        value, n, state = want[g.period]
        assert (g.n_readings, g.state) == (n, state)
        assert (g.value is None) == (value is None) and (value is None or abs(g.value - value) < 1e-9)


def test_across_blocks(spark, monkeypatch):
    from aerolith.operators import gridding

    monkeypatch.setattr(gridding, "BLOCK", 4)
    data = [(1, 60 * k, float(k)) for k in range(40) if k % 7 not in (2, 3)]
    got = regular_grid(spark.createDataFrame(data, "s bigint, t bigint, v double"), spark.createDataFrame([(1, 60)], "s bigint, p int"), "s", "t", "v", "p").collect()
    assert sorted(g.period for g in got) == [60 * k for k in range(40)]
    assert all(abs(g.value - g.period / 60) < 1e-9 for g in got)


def test_edges(spark):
    data = [(1, None, 5.0), (1, 10, None), (None, 10, 1.0), (2, 10, 1.0), (3, 10, float("nan")), (4, 10, 2.0), (4, 10, 2.0)]
    r = spark.createDataFrame(data, "s bigint, t bigint, v double")
    got = regular_grid(r, spark.createDataFrame([(1, 60), (3, 60), (4, 60), (4, 60), (None, 60)], "s bigint, p int"), "s", "t", "v", "p").collect()
    assert [(g.s, g.period, g.value, g.n_readings, g.state) for g in got] == [(4, 0, 2.0, 2, "read")]
    assert regular_grid(r.limit(0), spark.createDataFrame([(1, 60)], "s bigint, p int"), "s", "t", "v", "p").count() == 0
