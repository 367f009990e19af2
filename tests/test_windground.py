"""wind_sor_solver, wind_outputs, wind_batch: pieces make their cells from the blocks near them, and give the field of the whole ground."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from aerolith.operators import windfield as V
from aerolith.operators import windground as N
from aerolith.plans import windfield as P
from aerolith.session import shared_folder


def _dense(df, i, j, nk):
    t = df.toPandas()
    out = np.zeros((4, i[1] - i[0] + 1, j[1] - j[0] + 1, nk))
    for n, c in enumerate(("u", "v", "w", "solid")):
        out[n, t.i - i[0], t.j - j[0], t.k] = t[c]
    return len(t), out


@pytest.mark.parametrize("cells", [1, N.CELLS])
def test_pieces_give_the_field_of_the_whole_ground(spark, folder, cells):
    i, j, nk = P._extent(spark, folder)
    n, (u, v, w, solid) = _dense(P._field(spark, folder), i, j, nk)
    *want, _ = V.adjust(u, -v, w, solid.astype(bool), 5000, 1e-9)
    case = P._blocks(spark, folder), P._patches(spark, folder), (i, j, nk)
    pieces = N.Ground.of(i, j, nk, 8, cells)
    assert (pieces.pieces(0) > 1) == (cells == 1)
    m, got = _dense(N.solved({0: case}, 3.0, P._all_cells, "i bigint, j bigint, k bigint, u double, v double, w double, solid boolean", cells=cells), i, j, nk)
    assert n == m == solid.size and (got[3] == solid).all()
    moved = np.abs(want[1] + v)[solid == 0].mean()
    assert max(np.abs(a - b).mean() for a, b in zip(got, want)) < 0.003 * moved
    assert max(np.abs(a - b).max() for a, b in zip(got, want)) < 0.05 * moved


def test_pieces_exchange_until_their_borders_agree(spark, folder, monkeypatch):
    """With an overlap in which a cut's influence does not fade, one pass isn't enough."""
    i, j, nk = P._extent(spark, folder)
    case = P._blocks(spark, folder), P._patches(spark, folder), (i, j, nk)
    schema = "i bigint, j bigint, k bigint, u double, v double, w double, solid boolean"
    _, want = _dense(N.solved({0: case}, 3.0, P._all_cells, schema), i, j, nk)
    monkeypatch.setattr(N, "FADES", 1)
    short = N.solved({0: case}, 3.0, P._all_cells, schema, cells=1)
    assert short.first().rounds > 150
    _, got = _dense(short, i, j, nk)
    assert np.abs(got - want).max() < 0.01
    with pytest.raises(V.NotConverged):
        N.solved({0: case}, 3.0, P._all_cells, schema, rounds=100, cells=1)


@pytest.mark.parametrize("name", ["wind_sor_solver", "wind_outputs", "wind_batch"])
def test_no_table_has_the_cells_of_the_grid(spark, folder, name):
    """A grid has hundreds of cells for each block, which disks and shuffles don't hold at size."""
    (i0, i1), (j0, j1), nk = P._extent(spark, folder)
    at = Path(shared_folder(spark).removeprefix("file://")) / "aerolith"
    before = set(at.iterdir()) if at.exists() else set()
    assert P.QUERIES[name](spark, folder).count() > 0
    rows = [sum(pq.ParquetFile(f).metadata.num_rows for f in p.rglob("*.parquet")) for p in set(at.iterdir()) - before]
    assert rows and max(rows) < (i1 - i0 + 1) * (j1 - j0 + 1) * nk / 8
