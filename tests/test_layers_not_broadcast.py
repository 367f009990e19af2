"""Layers turned into shapes on cells are joined by shuffle: their files are small enough to broadcast, the shapes are not."""

import pytest

from aerolith.operators import windfield as V
from aerolith.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["trees_buildings_union", "overlay_union", "landcover_override"])
def test_union_of_layers_is_not_broadcast(spark, folder, name):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10_000_000
    p = plan(registry.queries()[name](spark, folder))
    assert "SortMergeJoin" in p and "Broadcast" not in p


def test_zones_are_not_broadcast(spark, folder):
    p = plan(registry.queries()["wind_superimpose"](spark, folder))
    assert "SortMergeJoin" in p and "Broadcast" not in p


def test_walls_and_cells_are_not_broadcast_to_the_grid(spark):
    cells = spark.range(1).selectExpr("id AS i", "id AS j", "id AS k", "0D AS u", "0.5D AS v", "0D AS w")
    solid = spark.range(1).selectExpr("id + 1 AS i", "id + 1 AS j", "id AS k")
    x = V.full_field(cells, solid, (0, 2), (0, 2), 2, 3.0)
    assert "Broadcast" not in plan(x)
    assert x.count() == 18 and [tuple(r) for r in x.where("solid").select("i", "j", "k").collect()] == [(1, 1, 0)]
