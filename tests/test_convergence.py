import pytest

from aerolith.operators import components, joins


def test_shortest_goes_to_the_end_or_raises(spark):
    """graph_dijkstra, graph_isochrones: no round limit cuts a path."""
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "tail long, head long, len double")
    assert {x.node: x.t for x in components.shortest(edges, 0).collect()} == {i: float(i) for i in range(7)}
    with pytest.raises(components.NotConverged):
        components.shortest(edges, 0, 3)


def test_connected_raises_with_work_left(spark):
    """components: labels that still change are no result."""
    nodes = spark.createDataFrame([(i,) for i in range(9)], "id long")
    links = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    with pytest.raises(components.NotConverged):
        components.connected(nodes, links, 1)
    assert {x.component for x in components.connected(nodes, links).collect()} == {0}


def test_nearest_any_finds_what_is_far(spark):
    """More than 24 doublings; points that cannot find don't keep the rounds going."""
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, float("nan"), 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 1e5, 0.0)], "id long, x double, y double")
    assert [(x.id, x.near_id) for x in joins.nearest_any(a, b, 0.001).collect()] == [(1, 7)]
    assert joins.nearest_any(a, b.limit(0), 1.0).isEmpty()
