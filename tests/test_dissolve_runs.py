"""The first step of a dissolve: all groups of a batch at once, groups that go on in the next batch."""

import numpy as np
import pyarrow as pa
import pytest

from aerolith.operators import polygons as P


@pytest.mark.parametrize("rows", [1, 3, 7, 100])
def test_runs_over_batches(rows):
    r = np.random.default_rng(rows)
    box = lambda x, y, w: np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)], float)
    shapes = [[box(*r.integers(0, 20, 2), r.integers(1, 9)) for _ in range(int(r.integers(1, 3)))] for _ in range(40)]
    group = np.sort(r.integers(0, 6, 40))
    keys = [(None if g < 2 else "ab"[g % 2], int(g) // 2) for g in group]
    t = pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in keys]), "i": pa.array([i for _, i in keys]), "rings": P.as_column(shapes)})
    got = list(P.united_runs(["k", "i"])(iter([t.slice(0, 0)] + [t.slice(n, rows) for n in range(0, 40, rows)])))
    runs = list(dict.fromkeys(keys))
    assert [x for b in got for x in zip(b.column("k").to_pylist(), b.column("i").to_pylist())] == runs
    found = [P.area(x) for b in got for x in P.regions_of(b.column("rings"))]
    want = [P.area(P.union([s for s, k in zip(shapes, keys) if k == run])) for run in runs]
    assert np.allclose(found, want)


def test_cells_are_united_where_they_were_shuffled_to(spark):
    rows = [(n % 2, [[{"x": float(x + 3 * n), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]]) for n in range(60)]
    d = P.dissolve(spark.createDataFrame(rows, f"k bigint, rings {P.RINGS}"), "k", 4.0)
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one for the cells, one for the keys
    assert {r.k: r.a for r in d.select("k", P.area_of("rings").alias("a")).collect()} == {0: 480.0, 1: 480.0}
