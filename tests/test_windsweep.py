import numpy as np
import pytest

from aerolith.plans.windfield import swept

BUILDING = "id long, xmin double, ymin double, xmax double, ymax double, hauteur double"
PATCH = "xmin double, ymin double, xmax double, ymax double, top double"


def test_zones_turn_with_the_wind(spark):
    """wind_batch: each direction has its wake on its own lee side, and speeds come from the table."""
    b = spark.createDataFrame([(1, 100.0, 100.0, 130.0, 130.0, 20.0), (2, 0.0, 0.0, 5.0, 5.0, 3.0), (3, 225.0, 225.0, 230.0, 230.0, 3.0)], BUILDING)
    winds = spark.createDataFrame([(0, 2.0), (0, 4.0), (90, 2.0), (180, 2.0), (270, 2.0)], "direction int, speed double")
    rows = swept(b, spark.createDataFrame([], PATCH), winds).where("k = 0 AND NOT solid").collect()
    for a, (east, north) in {0: (0, -1), 90: (-1, 0), 180: (0, 1), 270: (1, 0)}.items():
        mine = {(x.i, x.j): (x.u, x.v) for x in rows if x.direction == a and x.v_ref == 2}
        turn = -np.radians(a)
        x0, y0 = 115 - 230, 115 - 230  # the middle of the block from the corner about which all turns
        mx, my = 230 + np.cos(-turn) * x0 - np.sin(-turn) * y0, 230 + np.sin(-turn) * x0 + np.cos(-turn) * y0
        at = lambda dy: mine[int(np.floor(mx / 5)), int(np.floor((my + dy) / 5))]
        along = lambda uv: uv[0] * east + uv[1] * north
        assert along(at(-20)) < 0 < along(at(75))
        assert abs(along(at(75)) - 2 * 0.25**0.24) < 0.3
    one, two = ({(x.i, x.j): x.v for x in rows if x.direction == 0 and x.v_ref == n} for n in (2, 4))
    assert len(one) == len(two) and all(two[c] == pytest.approx(2 * one[c]) for c in one)


def test_oblique_rows_are_refused(spark):
    b = spark.createDataFrame([(1, 100.0, 100.0, 130.0, 130.0, 20.0)], BUILDING)
    with pytest.raises(ValueError):
        swept(b, spark.createDataFrame([], PATCH), spark.createDataFrame([(45, 2.0)], "direction int, speed double"))
