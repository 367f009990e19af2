"""Spatial and ordered joins as equi-joins: both sides go to cells, each pair is kept in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle and merge. Spark takes a file's bytes, less the columns left out, for a side's size, which tells nothing of shapes and cells made from a few columns: millions of them
    would pass for small enough to broadcast, and the driver has to hold what is broadcast."""
    return df.hint("merge")


def on_cells(df: DataFrame, size: float, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """Each box once for every cell that it touches, as ``cx`` and ``cy``."""
    df = df.withColumn("cx", F.explode(_cells(F.col(xmin), F.col(xmax), size)))
    return df.withColumn("cy", F.explode(_cells(F.col(ymin), F.col(ymax), size)))


def boxes_that_meet(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs (aliases ``a`` and ``b``) of boxes that share a point, each once: in the cell of the lower left corner of what they share."""
    x, y = on_cells(a, size).alias("a"), on_cells(b, size).alias("b")
    meet = (F.col("a.xmin") <= F.col("b.xmax")) & (F.col("a.xmax") >= F.col("b.xmin")) & (F.col("a.ymin") <= F.col("b.ymax")) & (F.col("a.ymax") >= F.col("b.ymin"))
    here = (F.floor(F.greatest("a.xmin", "b.xmin") / size) == F.col("a.cx")) & (F.floor(F.greatest("a.ymin", "b.ymin") / size) == F.col("a.cy"))
    return x.join(merged(y), (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))).where(meet & here)


def points_in_cells(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points with the boxes whose cells they lie in and whose bounds hold them; the exact test is the caller's."""
    p = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    return p.join(on_cells(boxes, size), ["cx", "cy"]).where("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").drop("cx", "cy")


def within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (aliases ``a`` and ``b``) of points at most ``radius`` apart: ``b`` goes to the nine cells around it."""
    around = F.array(*[F.struct((F.floor(F.col("x") / radius) + i).alias("cx"), (F.floor(F.col("y") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    y = b.withColumn("cell", F.explode(around)).alias("b")
    x = a.withColumn("cell", F.struct(F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))).alias("a")
    near = F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2) <= radius * radius
    return x.join(y, F.col("a.cell") == F.col("b.cell")).where(near)


def nearest_within(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(id, near_id, dist): for each point of ``a`` (id, x, y) the nearest of ``b`` at most ``radius`` away, ties to the smaller id; none, no row."""
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    best = F.min(F.struct(F.round(d, 9).alias("r"), F.col("b.id").alias("id"), d.alias("d"))).alias("m")
    return within(a, b, radius).groupBy(F.col("a.id").alias("id")).agg(best).select("id", F.col("m.id").alias("near_id"), F.col("m.d").alias("dist"))


def nearest_any(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """As ``nearest_within`` without a limit: what finds nothing is tried again with twice the radius, on ever fewer points, until all have found.
    Each point found keeps its result, so the rounds shrink. Points without finite coordinates find nothing and are not found.

    Points at one place search once, and of ``b`` the least id stands for its place. ``radius`` is the first one at most: it begins smaller where places of ``b`` lie closer, about four to a cell."""
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in "xy")
    a = cut(a.select("id", "x", "y").where(finite))
    b = cut(b.where(finite).groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"))
    n, wide, high = b.agg(F.count("*"), *[(F.max(c) - F.min(c)).cast("double") for c in "xy"]).first()
    if n > 1:  # a distance of 0 needs no radius
        radius = min(radius, 2 * max(((wide / n) * high) ** 0.5, max(wide, high) / n))
    places = a.select(F.struct("x", "y").alias("id"), "x", "y").distinct()
    found, rest, lost = None, cut(places), not n
    while True:
        hit = cut(nearest_within(rest, b, radius))
        found = hit if found is None else found.unionByName(hit)
        rest = rest.join(hit.select("id"), "id", "left_anti")
        if lost or rest.isEmpty():
            break
        rest, radius = cut(rest), radius * 2
    return a.join(found.select("id.x", "id.y", "near_id", "dist"), ["x", "y"]).select("id", "near_id", "dist")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``rank`` (0 ..) in order of ``key``: a sort by range, a count per partition, and an offset; no task holds all rows."""
    parts = cut(df.repartitionByRange(key).withColumn("part_", F.spark_partition_id()))
    sizes = parts.groupBy("part_").count()
    offset = sizes.select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("before_"))
    w = Window.partitionBy("part_").orderBy(key)
    return parts.withColumn("k_", F.row_number().over(w) - 1).join(F.broadcast(offset), "part_").withColumn("rank", F.col("k_") + F.col("before_")).drop("part_", "k_", "before_")
