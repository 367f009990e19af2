"""Connected components, shortest paths and flooding by rounds of joins: state lives in tables of the shared folder, never on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


class NotConverged(RuntimeError):
    """Work is left after the last round that the caller allows."""


def _counted(most: int | None) -> Iterator[int]:
    """Rounds without end, or ``most`` and then an error."""
    yield from range(most) if most is not None else count()
    raise NotConverged(f"work is left after {most} rounds")


def connected(nodes: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(id, component): the smallest id that each node reaches. ``nodes`` has id; ``links`` a, b. Labels jump to their label's label, so the rounds grow with the logarithm of a component's length."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    for _ in _counted(most):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        step = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("seen", "component")).alias("new"), "component")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("next"))
        after = cut(step.join(jump, "new", "left").select("id", F.least("new", F.coalesce("next", "new")).alias("component"), F.col("component").alias("was")))
        label = after.select("id", "component")
        if after.where("component <> was").isEmpty():
            break
    return label


def shortest(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """(node, t): least total length from ``source`` over directed edges (tail, head, len >= 0). Nodes that it doesn't reach have no row. Only nodes that improved spread in the next round."""
    edges = cut(edges.select("tail", "head", "len"))
    spark = edges.sparkSession
    best = cut(spark.range(source, source + 1).select(F.col("id").alias("node"), F.lit(0.0).alias("t")))
    front = best
    for _ in _counted(most):
        reached = front.join(edges, F.col("node") == F.col("tail")).groupBy(F.col("head").alias("node")).agg(F.min(F.col("t") + F.col("len")).alias("new"))
        merged = cut(best.join(reached, "node", "full").select("node", F.least("t", "new").alias("t"), (F.col("t").isNull() | (F.col("new") < F.col("t"))).alias("better")))
        best = merged.select("node", "t")
        front = merged.where("better").select("node", "t")
        if front.isEmpty():
            break
    return best
