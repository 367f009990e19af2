import pytest

from aerolith.operators import windfield as V
from aerolith.plans.windfield import _combined

BLOCK = "id long, xmin double, ymin double, xmax double, ymax double, h double"
PATCH = "xmin double, ymin double, xmax double, ymax double, top double"


def _at(df):
    return {(x.i, x.j, x.k): x for x in df.collect()}


def test_vegetation_weakens_what_lies_in_it(spark):
    """wind_superimpose: zones in vegetation lose speed, and open ground in it keeps the factor alone."""
    blocks = spark.createDataFrame([(1, 0.0, 100.0, 20.0, 120.0, 20.0)], BLOCK)
    none = spark.createDataFrame([], PATCH)
    veg = spark.createDataFrame([(0.0, 60.0, 60.0, 100.0, 12.0)], PATCH)
    bare, green, f = _at(_combined(blocks, none)), _at(_combined(blocks, veg)), _at(V.vegetation(veg))
    cell = (1, 18, 0)
    assert bare[cell].zone == "cavity" and 0 < f[cell].f < 1
    assert green[cell].v == pytest.approx(bare[cell].v * f[cell].f)
    assert (10, 15, 0) not in bare and green[(10, 15, 0)].zone == "vegetation" and green[(10, 15, 0)].v == pytest.approx(f[(10, 15, 0)].f)


def test_flow_turns_back_over_a_low_block_in_a_cavity(spark):
    """wind_superimpose: before the north wall of a low block in a tall block's cavity stands that block's own cavity, mirrored, times the speed above its roof."""
    blocks = spark.createDataFrame([(1, 0.0, 100.0, 60.0, 120.0, 40.0), (2, 0.0, 60.0, 60.0, 80.0, 8.0)], BLOCK)
    x = _at(_combined(blocks, spark.createDataFrame([], PATCH)))
    m = V.measured(blocks)
    [wall] = V.factors(m).where("zone = 'cavity' AND id = 1 AND i = 6 AND j = 16 AND k = 1").collect()
    assert wall.v < 0
    r = {(p.i, p.j): p.r for p in V.downstream_zone(m, "cavity").where("id = 2").collect()}
    near = x[(6, 16, 0)]
    edge = (1 - (2.5 / 8) ** 2) ** 0.5
    assert near.zone == "cavity_backward"
    assert near.v == pytest.approx((1 - r[(6, 11)] / edge) ** 2 * -wall.v)
    assert not [c for c, y in x.items() if y.zone in ("canyon",) and c[0] == 6]
    assert not [c for c, y in x.items() if y.zone == "rooftop" and 12 <= c[1] < 16]
