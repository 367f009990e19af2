import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import windfield as V


def _field(spark, ni, nj, nk, seed=3):
    r = np.random.default_rng(seed)
    solid = np.zeros((ni, nj, nk), bool)
    for _ in range(ni * nj // 60):
        i, j = r.integers(2, ni - 4), r.integers(2, nj - 4)
        solid[i : i + 3, j : j + 2, : r.integers(1, nk - 2)] = True
    u, v, w = (np.where(solid, 0, r.normal(size=solid.shape) * 0.3 + m) for m in (0, -3, 0))
    at = [x.ravel().tolist() for x in np.indices(solid.shape)]
    rows = list(zip(*at, u.ravel().tolist(), v.ravel().tolist(), w.ravel().tolist(), solid.ravel().tolist()))
    return spark.createDataFrame(rows, "i long, j long, k long, u double, v double, w double, solid boolean").withColumn("case", F.lit(0)), (u, v, w, solid)


def test_pieces_solve_one_problem(spark):
    """wind_sor_solver: a field wider than a piece gets the solution of the whole domain, also at the borders of pieces."""
    shape = (2 * V.PIECE + 9, V.PIECE + 20, 5)
    df, (u, v, w, solid) = _field(spark, *shape)
    want = V.adjust(u, v, w, solid, 5000, 1e-9)
    rows = V.solved(df, "case").collect()
    assert len(rows) == solid.size and 1 < rows[0].rounds <= 500
    got = np.zeros((3, *shape))
    for x in rows:
        got[:, x.i, x.j, x.k] = x.u, x.v, x.w
    moved = np.abs(want[1] - v)[~solid].mean()
    assert max(np.abs(g - a).max() for g, a in zip(got, want[:3])) < 0.01 * moved


def test_no_convergence_is_an_error(spark):
    df, _ = _field(spark, 20, 20, 5)
    with pytest.raises(V.NotConverged):
        V.solved(df, "case", 5)
