"""Spikes, stuck stretches, bounds: brute force and edges."""

import math

import numpy as np
import pytest

from aerolith.operators.spikes import GROUND_STATION, Plan, flag_implausible, spike_mask, stuck_mask

SCHEMA = "obs_id bigint, station_id bigint, minute bigint, T double, TD double, U double, FF double"


def course(n, seed=0):
    r = np.random.default_rng(seed)
    h = np.arange(n)
    return np.round(10 + 5 * np.sin(h / 24 * 2 * math.pi) + r.normal(0, 0.4, n), 1)


def rows(t, start=0, station=1, **other):
    return [(start + i, station, 60 * i, float(v), None, None, None) for i, v in enumerate(t)]


def found(spark, data):
    return {(r.obs_id, r.field, r.reason) for r in flag_implausible(spark.createDataFrame(data, SCHEMA), "obs_id", "station_id", "minute").collect()}


@pytest.mark.parametrize("size", [1, 2, 3])
def test_spike(spark, size):
    t = course(200)
    t[100 : 100 + size] += 25
    assert found(spark, rows(t)) == {(100 + i, "T", "spike") for i in range(size)}


def test_many_layers_of_spikes():
    """Spikes of growing height, some beside each other: rounds go on until none is left."""
    q = GROUND_STATION[0]
    v = np.full(3000, 10.0) + np.tile([0.0, 0.3], 1500)
    at = np.concatenate([np.arange(20, 2980, 40), np.arange(25, 2980, 160), np.arange(29, 2980, 320)])
    for i, k in enumerate(at):
        v[k] += 20 + 3 * i
    want = np.zeros(3000, bool)
    want[at] = True
    assert (spike_mask(np.arange(3000.0) * 60, v, q, 3, 8) == want).all()


def test_four_in_a_row_is_weather(spark):
    t = course(200)
    t[100:106] += 12
    assert not [f for f in found(spark, rows(t)) if f[2] == "spike" and f[0] not in range(99, 107)]


def test_stuck_and_two_tenths(spark):
    t = course(300)
    t[50:60] = 7.3
    t[150:160] = [7.3, 7.4] * 5
    got = {f[0] for f in found(spark, rows(t)) if f[2] == "stuck"}
    assert set(range(50, 60)) <= got and set(range(150, 160)) <= got


def test_nine_is_not_stuck():
    q = GROUND_STATION[2]
    assert not stuck_mask(np.array([50.0] * 9 + [60.0]), q, 10).any()
    assert stuck_mask(np.array([50.0] * 10), q, 10).all()


def test_free_values(spark):
    data = [(i, 1, 60 * i, None, None, 100.0, 0.0) for i in range(40)]
    assert found(spark, data) == set()


def test_bounds_and_dew_point(spark):
    data = [(1, 1, 0, 10.0, 12.0, 101.0, -1.0), (2, 1, 60, 85.0, 12.0, 50.0, 3.0), (3, None, None, 10.0, 12.0, 101.0, 999.0), (4, 1, None, 99.0, 100.0, None, None), (5, 1, 120, float("nan"), None, None, None)]
    assert found(spark, data) == {(1, "TD", "above"), (1, "U", "bound"), (1, "FF", "bound"), (2, "T", "bound"), (3, "TD", "above"), (3, "U", "bound"), (3, "FF", "bound"), (4, "T", "bound"), (4, "TD", "bound")}


def test_deliveries_count_once_and_are_all_listed(spark):
    t = course(200)
    t[100] += 25
    again = [(1000 + i, *r[1:]) for i, r in enumerate(rows(t))]
    assert found(spark, rows(t) + again) == {(100, "T", "spike"), (1100, "T", "spike")}


def test_block_edge(spark):
    t = course(400)
    t[200] += 25
    p = Plan(block_minutes=200 * 60, margin_minutes=48 * 60)
    got = flag_implausible(spark.createDataFrame(rows(t), SCHEMA), "obs_id", "station_id", "minute", p).collect()
    assert [(r.obs_id, r.reason) for r in got] == [(200, "spike")]


def test_empty(spark):
    assert found(spark, []) == set()


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(course(50)), SCHEMA).withColumns({"r_id": F.lit(1), "field": F.lit("x"), "reason": F.lit("y")})
    assert flag_implausible(df, "obs_id", "station_id", "minute").columns == ["obs_id", "field", "reason"]


def test_too_short_for_a_judgement():
    assert not spike_mask(np.arange(5.0), np.array([0, 0, 50, 0, 0.0]), GROUND_STATION[0], 3, 8).any()
