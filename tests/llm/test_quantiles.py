import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerolith.llm.quantiles import Universe, compress, digests, digests_of_latest, merge, percentiles, ranks

SHARES = (0.05, 0.25, 0.5, 0.75, 0.99)


def worst(values, leaves, shares):
    """How far the rank of each answer is from the share's, in places."""
    v = np.sort(values)
    out = 0
    for leaf, s in zip(leaves, shares, strict=True):
        need = max(1, int(np.ceil(s * len(v))))
        lo, hi = np.searchsorted(v, leaf, "left") + 1, np.searchsorted(v, leaf, "right")
        out = max(out, need - hi, lo - need)
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1023), min_size=1, max_size=2000), st.integers(10, 200))
def test_rank_error(values, k):
    nodes, counts = compress(np.array(values) + 1024, np.ones(len(values)), 10, k)
    assert counts.sum() == len(values) and len(nodes) <= 3 * k + 1
    assert worst(values, ranks(nodes, counts, 10, list(SHARES)), SHARES) <= 10 * (len(values) // k)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1023), min_size=1, max_size=400), min_size=1, max_size=8), st.integers(20, 100))
def test_merged_rank_error(parts, k):
    d = [compress(np.array(p) + 1024, np.ones(len(p)), 10, k) for p in parts]
    nodes, counts = compress(np.concatenate([x[0] for x in d]), np.concatenate([x[1] for x in d]), 10, k)
    every = [v for p in parts for v in p]
    assert worst(every, ranks(nodes, counts, 10, list(SHARES)), SHARES) <= 10 * (len(every) // k)


def near(a, b):
    return a == b or abs(a - b) <= max(abs(b), 1) / 4096


def test_groups_and_edges(spark):
    rows = [("a", float(x)) for x in range(100)] + [("b", None), ("b", float("nan")), ("c", 5.0), ("c", 5.0), (None, 1e9), (None, -1e9), ("i", float("inf")), ("i", float("-inf")), ("i", 0.0), ("h", 1e300), ("h", -1e300)]
    d = digests(spark.createDataFrame(rows, "k string, v double").withColumnRenamed("k", "nodes"), ["nodes"], ("v",))
    d = d.toDF("k", "field", "n", "nodes", "counts", "least", "most")
    got = {r.k: r for r in percentiles(d, (0.0, 0.5, 1.0)).collect()}
    assert set(got) == {"a", "c", None, "i", "h"} and {r.field for r in got.values()} == {"v"}
    assert got["a"].n == 100 and near(got["a"].percentiles[1], 49) and near(got["a"].percentiles[2], 99)
    assert all(near(x, 5.0) for x in got["c"].percentiles) and near(got[None].percentiles[2], 1e9) and near(got[None].percentiles[0], -1e9)
    assert got["i"].percentiles[0] == float("-inf") and near(got["i"].percentiles[1], 0.0) and got["i"].percentiles[2] == float("inf")
    assert near(got["h"].percentiles[2] / 1e300, 1.0) and near(got["h"].percentiles[0] / 1e300, -1.0)
    whole = percentiles(merge(d, []), (0.5,)).first()
    assert whole.n == 109
    assert digests(spark.createDataFrame([], "k string, v double"), ["k"], ("v",)).count() == 0


def test_leaves_are_ordered_and_narrow(spark):
    import math

    v = sorted([s * 10.0**e * m for s in (-1, 1) for e in range(-8, 300, 3) for m in (1, 2.5, 9.99)] + [0.0])
    u = Universe()
    df = spark.createDataFrame([(x,) for x in v], "v double")
    leaf = [r.leaf for r in df.select("v", u.leaf(df.v).alias("leaf")).orderBy("v").collect()]
    assert leaf == sorted(leaf) and min(leaf) >= u.leaves and max(leaf) < 2 * u.leaves
    for x, m in zip(v, u.value(np.array(leaf) - u.leaves), strict=True):
        assert math.isfinite(m) and near(m / max(abs(x), 1), x / max(abs(x), 1))


def test_half_of_the_values_far_out(spark):
    """No end of the universe takes in what lies beyond it: half the values between 3 000 and 4 000."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(20, 5, 5000), r.uniform(3000, 4000, 5000), r.uniform(-5e6, -4e6, 3000)])
    d = digests(spark.createDataFrame([(float(v),) for v in x], "v double"), [], ("v",))
    got = percentiles(d, SHARES).first()
    s = np.sort(x)
    for share, v in zip(SHARES, got.percentiles, strict=True):
        slack = np.searchsorted(s, v + abs(v) / 2000) - np.searchsorted(s, v - abs(v) / 2000)
        assert abs(np.searchsorted(s, v) - share * len(x)) <= got.rank_bound + slack + 1


def test_days_combine(spark):
    r = np.random.default_rng(3)
    x = r.normal(20, 8, 20000)
    rows = [(i % 7, float(v)) for i, v in enumerate(x)]
    k = 400
    d = digests(spark.createDataFrame(rows, "day int, v double"), ["day"], ("v",), k=k)
    got = percentiles(merge(d, [], k=k), SHARES, k=k).first()
    assert got.n == 20000 and got.rank_bound == Universe().levels * (20000 // k)
    s = np.sort(x)
    for share, v in zip(SHARES, got.percentiles, strict=True):
        assert abs(np.searchsorted(s, v) - share * 20000) <= got.rank_bound + 60


def test_latest_of_repeated_rows(spark):
    """Of the loads of a key the last counts, with its nulls; ties: the greatest values; a hot group over many tasks and batches."""
    rows = [("a", i % 5000, i // 5000, float(i % 5000 if i // 5000 == 2 else -7), None if i % 10 == 0 and i // 5000 == 2 else 1.0) for i in range(15000)]
    rows += [("b", 1, None, 3.0, None), ("b", 1, 4, 8.0, None), ("b", 1, 4, 9.0, None), (None, None, None, 2.0, 2.0), (None, None, None, 2.0, 2.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        d = digests_of_latest(spark.createDataFrame(rows, "k string, id int, at int, u double, w double").repartition(7), ["k"], ("u", "w"), ["id"], "at")
        got = {(r.k, r.field): r for r in percentiles(d, (0.0, 0.5, 1.0)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {("a", "u"), ("a", "w"), ("b", "u"), (None, "u"), (None, "w")}
    assert got["a", "u"].n == 5000 and got["a", "u"].percentiles[0] <= 24 and near(got["a", "u"].percentiles[2], 4999) and abs(got["a", "u"].percentiles[1] - 2500) < 30 and got["a", "w"].n == 4500
    assert got["b", "u"].n == 1 and near(got["b", "u"].percentiles[1], 9.0) and got[None, "u"].n == 1
