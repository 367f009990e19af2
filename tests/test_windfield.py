import numpy as np

from aerolith.functions.utci import polynomial
from aerolith.operators.canyon import Canyon, shape, simulate, tridiagonal
from aerolith.operators.windfield import adjust


def test_solver_removes_divergence():
    solid = np.zeros((12, 12, 8), bool)
    solid[5:8, 5:8, :4] = True
    v = np.where(solid, 0.0, 3.0)
    u = w = np.zeros_like(v)
    a, b, c, n = adjust(u, v, w, solid, 2000, 1e-7)
    before = abs(np.diff(v, axis=1)).max()
    div = np.gradient(a, axis=0) + np.gradient(b, axis=1) + np.gradient(c, axis=2)
    inner = ~solid[2:-2, 2:-2, 2:-2]
    assert n > 1 and abs(div[2:-2, 2:-2, 2:-2][inner]).mean() < 0.25 * before
    assert abs(b[solid]).max() < 3


def test_utci_reference_points():
    for (t, tr, v, e), want in {(25, 25, 1.0, 15.845): 24.6, (25, 27, 1.0, 15.845): 25.2}.items():
        a = [np.array([float(x)]) for x in (t, tr - t, v, e / 10)]
        assert abs(t + polynomial(*a)[0] - want) < 0.06


def test_canyon_is_warmer_at_night():
    h = np.arange(72)
    t = (12 + 6 * np.sin((h - 9) / 24 * 2 * np.pi))[None]
    sun = np.clip(700 * np.sin((h - 6) / 24 * 2 * np.pi), 0, None)[None]
    r = simulate(t, np.full_like(t, 2.0), sun, np.full_like(t, 320.0), Canyon())
    night = (h % 24 < 5) & (h > 24)
    assert np.isfinite(r["canyon"]).all() and (r["canyon"] - t)[0][night].mean() > 0.5
    assert 0 < shape(Canyon()).road_view < 1


def test_tridiagonal():
    r = np.random.default_rng(0)
    low, high, right = r.uniform(-1, 0, (3, 6)), r.uniform(-1, 0, (3, 6)), r.uniform(-1, 1, (3, 6))
    mid = r.uniform(3, 4, (3, 6))
    x = tridiagonal(low, mid, high, right)
    for k in range(3):
        m = np.diag(mid[k]) + np.diag(high[k][:-1], 1) + np.diag(low[k][1:], -1)
        assert np.allclose(m @ x[k], right[k])
