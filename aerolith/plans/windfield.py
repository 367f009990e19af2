"""The wind pipeline on the building layer, step by step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import wind as W
from ..operators import components
from ..operators import joins as J
from ..operators import windfield as V
from ..operators import windground as N
from ..session import cut
from .base import Book, view
from .formulas import wind_rose

book = Book()
query = book.query
_H = "(SELECT id, xmin, ymin, xmax, ymax, hauteur AS h, xmax - xmin AS w, ymax - ymin AS l FROM f_building WHERE hauteur IS NOT NULL)"
_LR = "(1.8 * w / (pow(l / h, 0.3) * (1 + 0.24 * w / h)))"
_LF = "(1.5 * w / (1 + 0.8 * w / h))"
_LCP = "(0.9 * (0.67 * least(h, w) + 0.33 * greatest(h, w)))"
_I = "(SELECT unnest(generate_series(0, 220)) AS i) gi"
_J = "(SELECT unnest(generate_series(-40, 2800)) AS j) gj"
_ACROSS = "(((i + 0.5) * 5 - (xmin + xmax) / 2) / (w / 2))"


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_building").where("hauteur IS NOT NULL").select("id", "xmin", "ymin", "xmax", "ymax", F.col("hauteur").alias("h"))


def _measured(s: SparkSession, d: str) -> DataFrame:
    return V.measured(_blocks(s, d))


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("wind_load", "SELECT CAST(id AS INTEGER) AS id_build, CAST(ROUND(hauteur) AS INTEGER) AS height_roof FROM f_building WHERE hauteur > 0.5")
def wind_load(s, d):
    return view(s, d, "f_building").where("hauteur > 0.5").select(F.col("id").cast("int").alias("id_build"), F.round("hauteur").cast("int").alias("height_roof"))


@query("wind_cad_25d", "SELECT a.id, a.h AS z_max, COALESCE(b.h, 0) AS z_min FROM (SELECT id, hauteur AS h FROM f_building WHERE hauteur IS NOT NULL) a LEFT JOIN (SELECT id, CAST(nombre_d_etages AS DOUBLE) AS h FROM f_building WHERE nombre_d_etages IS NOT NULL) b ON a.id = b.id")
def wind_cad_25d(s, d):
    """Faces folded to footprints with the heights of their highest and lowest corner."""
    b = view(s, d, "f_building")
    corners = b.where("hauteur IS NOT NULL").select("id", F.explode(F.array("hauteur", F.coalesce(F.col("nombre_d_etages").cast("double"), F.lit(0.0)))).alias("z"))
    top = b.where("hauteur IS NOT NULL").select("id", F.col("hauteur").alias("z_max"))
    return corners.groupBy("id").agg(F.count("*").alias("n")).join(top, "id").join(b.select("id", "nombre_d_etages"), "id").select("id", "z_max", F.coalesce(F.col("nombre_d_etages").cast("double"), F.lit(0.0)).alias("z_min"))


@query("wind_blocks")
def wind_blocks(s, d):
    """Blocks of buildings that come within 10 m, and for each distinct height of a block how many parts stand at least as high."""
    b = _blocks(s, d)
    wide = b.select("id", *[(F.col(c) + k).alias(c) for c, k in (("xmin", -5), ("ymin", -5), ("xmax", 5), ("ymax", 5))])
    links = J.boxes_that_meet(wide, wide, 64.0).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    c = components.connected(b.select("id"), links).join(b.select("id", "h"), "id")
    counts = c.groupBy("component", "h").agg(F.count("*").alias("n"))
    w = Window.partitionBy("component").orderBy(F.desc("h"))
    return counts.select("component", "h", F.sum("n").over(w).alias("parts"))


@query("wind_rotate", "SELECT id, ROUND(cx + (xmin - cx) * cos(0.5) - (ymin - cy) * sin(0.5), 6) AS x, ROUND(cy + (xmin - cx) * sin(0.5) + (ymin - cy) * cos(0.5), 6) AS y FROM f_building, (SELECT MAX(xmax) AS cx, MAX(ymax) AS cy FROM f_building) e")
def wind_rotate(s, d):
    """All rings about the upper right corner of the extent, so that the wind comes from the north."""
    b = G.with_box(view(s, d, "f_building"))
    e = F.broadcast(b.agg(F.max("xmax").alias("cx"), F.max("ymax").alias("cy")))
    x = b.crossJoin(e).select("id", G.rotate(F.col("geom"), 0.5, F.col("cx"), F.col("cy")).alias("g"))
    return x.select("id", r6(F.col("g")[0]["x"], "x"), r6(F.col("g")[0]["y"], "y"))


@query("wind_block_base", "SELECT a.id, COALESCE(MAX(b.h), 0) AS base FROM " + _H + " a LEFT JOIN " + _H + " b ON b.id <> a.id AND b.h < a.h AND b.xmin < a.xmax + 20 AND b.xmax > a.xmin - 20 AND b.ymin < a.ymax + 20 AND b.ymax > a.ymin - 20 GROUP BY a.id")
def wind_block_base(s, d):
    """The height of the highest lower block beside each block."""
    b = _blocks(s, d)
    wide = b.select("id", "h", *[(F.col(c) + k).alias(c) for c, k in (("xmin", -20), ("ymin", -20), ("xmax", 20), ("ymax", 20))])
    strict = (F.col("b.xmin") < F.col("a.xmax")) & (F.col("b.xmax") > F.col("a.xmin")) & (F.col("b.ymin") < F.col("a.ymax")) & (F.col("b.ymax") > F.col("a.ymin"))
    low = J.boxes_that_meet(wide, b, 64.0).where((F.col("a.id") != F.col("b.id")) & (F.col("b.h") < F.col("a.h")) & strict).groupBy(F.col("a.id").alias("id")).agg(F.max("b.h").alias("base"))
    return b.select("id").join(low, "id", "left").select("id", F.coalesce("base", F.lit(0.0)).alias("base"))


@query("wind_upwind_facades", "SELECT id, w AS width, (xmin + xmax) / 2 AS x_mid, ymax AS y_wall, h FROM " + _H + " t")
def wind_upwind_facades(s, d):
    """Sides that face the wind: azimuth from west to east along the north."""
    b = _blocks(s, d)
    ring = G.with_box(b, clockwise=True).select("id", "h", F.explode(G.segments(F.col("geom"))).alias("g"))
    az = G.azimuth(F.col("g.a"), F.col("g.b"))
    f = ring.where((az > 1e-6) & (az < math.pi - 1e-6))
    return f.select("id", (F.col("g.b.x") - F.col("g.a.x")).alias("width"), ((F.col("g.a.x") + F.col("g.b.x")) / 2).alias("x_mid"), F.col("g.a.y").alias("y_wall"), "h")


@query("wind_downwind_facades", "SELECT id, w AS width, (xmin + xmax) / 2 AS x_mid, ymin AS y_wall FROM " + _H + " t")
def wind_downwind_facades(s, d):
    b = _blocks(s, d)
    ring = G.with_box(b, clockwise=True).select("id", F.explode(G.segments(F.col("geom"))).alias("g"))
    f = ring.where(G.azimuth(F.col("g.a"), F.col("g.b")) > math.pi + 1e-6)
    return f.groupBy("id").agg(F.sum(G.distance(F.col("g.a"), F.col("g.b"))).alias("width"), ((F.min(F.least("g.a.x", "g.b.x")) + F.max(F.greatest("g.a.x", "g.b.x"))) / 2).alias("x_mid"), F.min("g.a.y").alias("y_wall"))


@query("wind_upwind_base", "SELECT a.id, MIN(b.h) AS base FROM " + _H + " a JOIN " + _H + " b ON b.ymin <= a.ymax + 20 AND b.ymin >= a.ymax AND b.xmin < a.xmax AND b.xmax > a.xmin AND b.h < a.h GROUP BY a.id")
def wind_upwind_base(s, d):
    """Of blocks just before a facade, the lowest height that is below the facade's."""
    b = _blocks(s, d)
    front = b.select("id", "h", "xmin", F.col("ymax").alias("ymin"), "xmax", (F.col("ymax") + 20).alias("ymax"))
    hit = (F.col("b.ymin") >= F.col("a.ymin")) & (F.col("b.ymin") <= F.col("a.ymax")) & (F.col("b.xmin") < F.col("a.xmax")) & (F.col("b.xmax") > F.col("a.xmin")) & (F.col("b.h") < F.col("a.h"))
    return J.boxes_that_meet(front, b, 64.0).where(hit).groupBy(F.col("a.id").alias("id")).agg(F.min("b.h").alias("base"))


@query("wind_block_azimuths", "SELECT id, ROUND(cos(atan2(ymax - ymin, xmax - xmin)), 6) AS c, ROUND(sin(atan2(ymax - ymin, xmax - xmin)), 6) AS s FROM " + _H + " t")
def wind_block_azimuths(s, d):
    t = F.atan2(F.col("ymax") - F.col("ymin"), F.col("xmax") - F.col("xmin"))
    return _blocks(s, d).select("id", r6(F.cos(t), "c"), r6(F.sin(t), "s"))


def _zone(s, d, which: str) -> DataFrame:
    m = _measured(s, d)
    z = {"displacement": lambda: V.upstream_zone(m, "displacement"), "cavity": lambda: V.downstream_zone(m, "cavity"), "wake": lambda: V.downstream_zone(m, "wake"), "rooftop": lambda: V.roof_zone(m), "canyon": lambda: V.canyon_zone(m)}[which]()
    return z.select("id", "i", "j", r6(F.col("r"), "r"))


@query("zone_displacement", f"SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ROUND(pow({_ACROSS}, 2) + pow(((j + 0.5) * 5 - ymax) / {_LF}, 2), 6) AS r FROM {_H} t JOIN {_I} ON (i + 0.5) * 5 BETWEEN xmin AND xmax JOIN {_J} ON (j + 0.5) * 5 >= ymax AND (j + 0.5) * 5 <= ymax + {_LF} WHERE pow({_ACROSS}, 2) + pow(((j + 0.5) * 5 - ymax) / {_LF}, 2) <= 1")
def zone_displacement(s, d):
    return _zone(s, d, "displacement")


def _down(length: str) -> str:
    reach = f"({length} * sqrt(greatest(1 - pow({_ACROSS}, 2), 0)))"
    return f"SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ROUND((ymin - (j + 0.5) * 5) / {reach}, 6) AS r FROM {_H} t JOIN {_I} ON (i + 0.5) * 5 BETWEEN xmin AND xmax JOIN {_J} ON (j + 0.5) * 5 <= ymin AND (j + 0.5) * 5 >= ymin - {length} WHERE {reach} > 0 AND ymin - (j + 0.5) * 5 <= {reach}"


@query("zone_cavity_wake", _down("(3 * " + _LR + ")"))
def zone_cavity_wake(s, d):
    return _zone(s, d, "wake")


@query("zone_street_canyon", f"SELECT DISTINCT a.id, b.id AS next_id FROM {_H} a JOIN {_H} b ON a.id <> b.id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin - b.ymax > 0 AND a.ymin - b.ymax < 1.8 * a.w / (pow(a.l / a.h, 0.3) * (1 + 0.24 * a.w / a.h)) JOIN {_I} ON (i + 0.5) * 5 BETWEEN greatest(a.xmin, b.xmin) AND least(a.xmax, b.xmax) JOIN {_J} ON (j + 0.5) * 5 BETWEEN b.ymax AND a.ymin")
def zone_street_canyon(s, d):
    return V.canyon_zone(_measured(s, d)).select("id", "next_id").distinct()


@query("zone_rooftop", f"SELECT id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ROUND((ymax - (j + 0.5) * 5) / {_LCP}, 6) AS r FROM {_H} t JOIN {_I} ON (i + 0.5) * 5 BETWEEN xmin AND xmax JOIN {_J} ON (j + 0.5) * 5 BETWEEN greatest(ymin, ymax - {_LCP}) AND ymax")
def zone_rooftop(s, d):
    return _zone(s, d, "rooftop")


_VEG = "(SELECT id, xmin, ymin, xmax, ymax FROM f_landcover WHERE class_id IN (5, 6, 8))"


@query("zone_vegetation", f"SELECT v.id, CASE WHEN COUNT(b.id) > 0 THEN 'built' ELSE 'open' END AS kind FROM {_VEG} v LEFT JOIN {_H} b ON b.xmin < v.xmax AND b.xmax > v.xmin AND b.ymin - 40 < v.ymax AND b.ymax > v.ymin GROUP BY v.id")
def zone_vegetation(s, d):
    """Vegetation that meets the ground behind a building, and the rest."""
    veg = view(s, d, "f_landcover").where("class_id IN (5, 6, 8)").select("id", "xmin", "ymin", "xmax", "ymax")
    behind = _blocks(s, d).withColumn("ymin", F.col("ymin") - 40)
    strict = (F.col("b.xmin") < F.col("a.xmax")) & (F.col("b.xmax") > F.col("a.xmin")) & (F.col("b.ymin") < F.col("a.ymax")) & (F.col("b.ymax") > F.col("a.ymin"))
    built = J.boxes_that_meet(veg, behind, 64.0).where(strict).select(F.col("a.id").alias("id")).distinct().withColumn("kind", F.lit("built"))
    return veg.select("id").join(built, "id", "left").select("id", F.coalesce("kind", F.lit("open")).alias("kind"))


@query("zone_prune_impacting", f"SELECT id FROM {_H} t WHERE xmin < 600 AND xmax > 400 AND ymin - 3 * {_LR} < 700 AND ymax + {_LF} > 500")
def zone_prune_impacting(s, d):
    """Blocks whose zones reach the study area."""
    m = _measured(s, d)
    return m.where((F.col("xmin") < 600) & (F.col("xmax") > 400) & (F.col("ymin") - F.col("wake") < 700) & (F.col("ymax") + F.col("displacement") > 500)).select("id")


_BOUNDS = "(SELECT CAST(floor(MIN(xmin) / 5) AS BIGINT) AS i0, CAST(floor(MAX(xmax) / 5) AS BIGINT) AS i1, CAST(floor(MIN(ymin) / 5) AS BIGINT) AS j0, CAST(floor(MAX(ymax) / 5) AS BIGINT) AS j1 FROM f_building) e"


def _extent(s, d) -> tuple[tuple[int, int], tuple[int, int], int]:
    return _bounds(view(s, d, "f_building"))


def _bounds(b: DataFrame) -> tuple[tuple[int, int], tuple[int, int], int]:
    """Bounds of the grid: one row of five numbers."""
    e = b.agg(F.floor(F.min("xmin") / 5), F.floor(F.max("xmax") / 5), F.floor(F.min("ymin") / 5), F.floor(F.max("ymax") / 5), F.ceil(F.max("hauteur") / 5)).first()
    return (e[0] - 2, e[1] + 2), (e[2] - 2, e[3] + 2), int(e[4]) + 4


@query("wind_grid", f"SELECT i AS i, j AS j, CAST((i + 0.5) * 5 AS DOUBLE) AS x, CAST((j + 0.5) * 5 AS DOUBLE) AS y FROM (SELECT unnest(generate_series(i0 - 2, i1 + 2))::BIGINT AS i FROM {_BOUNDS}) a CROSS JOIN (SELECT unnest(generate_series(j0 - 2, j1 + 2))::BIGINT AS j FROM {_BOUNDS}) b")
def wind_grid(s, d):
    (i0, i1), (j0, j1), _ = _extent(s, d)
    n = i1 - i0 + 1
    g = s.range(n * (j1 - j0 + 1)).select((F.col("id") % n + i0).alias("i"), (F.floor(F.col("id") / n) + j0).alias("j"))
    return g.withColumns({"x": (F.col("i") + 0.5) * 5, "y": (F.col("j") + 0.5) * 5})


@query("wind_point_zone", _down(_LR))
def wind_point_zone(s, d):
    return _zone(s, d, "cavity")


@query("wind_point_veg", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, MAX(6.0 + v.id % 10)::DOUBLE AS canopy FROM {_VEG} v JOIN {_I} ON (i + 0.5) * 5 BETWEEN xmin AND xmax JOIN {_J} ON (j + 0.5) * 5 BETWEEN ymin AND ymax GROUP BY i, j")
def wind_point_veg(s, d):
    veg = view(s, d, "f_landcover").where("class_id IN (5, 6, 8)")
    g = V._generated(veg, F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax"))
    return g.groupBy("i", "j").agg(F.max(6.0 + F.col("id") % 10).alias("canopy"))


@query("wind_remove_overlap", f"WITH c AS ({_down(_LR)}) SELECT i, j, MIN(id) AS id FROM c JOIN (SELECT i AS i2, j AS j2, MAX(ymin) AS y FROM c JOIN f_building b USING (id) GROUP BY i, j) m ON m.i2 = c.i AND m.j2 = c.j JOIN f_building b USING (id) WHERE b.ymin = m.y GROUP BY i, j")
def wind_remove_overlap(s, d):
    """Where cavities overlap the most upstream wall keeps the point."""
    z = V.downstream_zone(_measured(s, d), "cavity")
    return z.groupBy("i", "j").agg(F.max(F.struct("y_wall", (-F.col("id")).alias("n"))).alias("m")).select("i", "j", (-F.col("m.n")).alias("id"))


@query("wind_backward", f"SELECT DISTINCT b.id FROM {_H} a JOIN {_H} b ON a.id <> b.id AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin - b.ymax > 0 AND a.ymin - b.ymax < 1.8 * a.w / (pow(a.l / a.h, 0.3) * (1 + 0.24 * a.w / a.h)) AND b.h > a.h")
def wind_backward(s, d):
    """Blocks that stand higher than the one in whose cavity they begin: the flow turns back before them."""
    m = _measured(s, d)
    front = m.select("id", "h", "xmin", (F.col("ymin") - F.col("cavity")).alias("ymin"), "xmax", F.col("ymin").alias("ymax"), "cavity")
    wall = m.select("id", "h", "xmin", F.col("ymax").alias("ymin"), "xmax", "ymax")
    gap = F.col("a.ymax") - F.col("b.ymax")
    hit = (F.col("a.id") != F.col("b.id")) & (gap > 0) & (gap < F.col("a.cavity")) & (F.col("b.h") > F.col("a.h")) & (F.col("a.xmin") < F.col("b.xmax")) & (F.col("b.xmin") < F.col("a.xmax"))
    return J.boxes_that_meet(front, wall, 64.0).where(hit).select(F.col("b.id").alias("id")).distinct()


@query("wind_factor_3d")
def wind_factor_3d(s, d):
    """Cells and mean factor of each zone's kind."""
    f = V.factors(_measured(s, d))
    return f.groupBy("zone").agg(F.count("*").alias("cells"), r6(F.avg("v"), "v"), r6(F.avg("w"), "w"))


@query("wind_veg_factor", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, ROUND(MIN(least(greatest(exp(0.5 * ((k * 5 + 2.5) / (6.0 + v.id % 10) - 1)), 0), 1)), 6) AS f FROM {_VEG} v JOIN {_I} ON (i + 0.5) * 5 BETWEEN xmin AND xmax JOIN {_J} ON (j + 0.5) * 5 BETWEEN ymin AND ymax JOIN (SELECT unnest(generate_series(0, 3)) AS k) gk ON k * 5 + 2.5 < 6.0 + v.id % 10 GROUP BY i, j, k")
def wind_veg_factor(s, d):
    """What vegetation leaves of the speed below its top, the least of overlapping patches."""
    return V.vegetation(_patches(s, d)).select("i", "j", "k", r6(F.col("f"), "f"))


def _patches(s, d) -> DataFrame:
    return view(s, d, "f_landcover").where("class_id IN (5, 6, 8)").select("xmin", "ymin", "xmax", "ymax", (6.0 + F.col("id") % 10).alias("top"))


def _combined(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """All zones at their cells: the most upstream ones weakened by wakes, then backward zones in their place, then vegetation."""
    m = cut(V.measured(blocks))
    facades = cut(V.backward_facades(m))
    x = cut(V.superimposed(V.without_turned(V.factors(m), facades), V.wake_factors(m)))
    return V.weakened(V.replaced(x, V.backward(m, facades, x)), V.vegetation(patches))


def _cells(s, d) -> DataFrame:
    return _combined(_blocks(s, d), _patches(s, d))


@query("wind_superimpose")
def wind_superimpose(s, d):
    return _cells(s, d).groupBy("zone").agg(F.count("*").alias("cells"), r6(F.avg("v"), "v"))


@query("wind_building_voxels", f"SELECT DISTINCT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k FROM {_H} t JOIN {_I} ON (i + 0.5) * 5 BETWEEN xmin AND xmax JOIN {_J} ON (j + 0.5) * 5 BETWEEN ymin AND ymax JOIN (SELECT unnest(generate_series(0, 10)) AS k) gk ON k * 5 + 2.5 < h")
def wind_building_voxels(s, d):
    return V.voxels(_blocks(s, d))


def _field(s, d) -> DataFrame:
    """The initial field of a wind of 3 m/s at 10 m."""
    (i, j, k) = _extent(s, d)
    return cut(V.full_field(_cells(s, d), V.voxels(_blocks(s, d)), i, j, k, 3.0))


@query("wind_init_field")
def wind_init_field(s, d):
    return _field(s, d).groupBy("k").agg(F.count("*").alias("cells"), F.count_if("solid").alias("solid"), r6(F.avg("v"), "v"))


@query("wind_staggered")
def wind_staggered(s, d):
    """Speeds on the faces between cells: the mean of both sides, nothing at walls."""
    x = _field(s, d)
    w = Window.partitionBy("i", "k").orderBy("j")
    face = F.when(F.col("solid") | F.lag("solid").over(w), 0.0).otherwise((F.col("v") + F.lag("v").over(w)) / 2)
    return x.withColumn("face", face).groupBy("k").agg(r6(F.avg("face"), "v_face"))


def _solved(s, d, summary, schema: str) -> DataFrame:
    """What ``summary`` keeps of the corrected field of the whole ground, one case, in a wind of 3 m/s at 10 m; ``v`` runs north here and in the solver, south in the zones' frame."""
    return N.solved({0: (_blocks(s, d), _patches(s, d), _extent(s, d))}, 3.0, summary, schema)


def _by_level(first, u, v, w, solid) -> dict:
    nk = solid.shape[2]
    return {"k": np.arange(nk), "cells": np.full(nk, solid[:, :, 0].size), "v": v.sum((0, 1)), "w": np.abs(w).sum((0, 1))}


@query("wind_sor_solver")
def wind_sor_solver(s, d):
    """The field made free of divergence, and the rounds that it took; ``v`` runs south."""
    x = _solved(s, d, _by_level, "k bigint, cells bigint, v double, w double")
    return x.groupBy("k").agg(F.sum("cells").alias("cells"), r6(-F.sum("v") / F.sum("cells"), "v"), r6(F.sum("w") / F.sum("cells"), "w"), F.max("rounds").alias("rounds"))


@query("wind_recentre_rotate", "SELECT ts_h, ROUND(ws * sin(radians(wd + 180)), 6) AS u, ROUND(ws * cos(radians(wd + 180)), 6) AS v FROM f_weather")
def wind_recentre_rotate(s, d):
    """Vectors of the wind's frame, in which it blows to the south, turned back into the map's frame by each hour's direction."""
    turn = -F.radians(F.col("wd").cast("double"))
    u, v = F.lit(0.0), -F.col("ws")
    return view(s, d, "f_weather").select("ts_h", r6(u * F.cos(turn) - v * F.sin(turn), "u"), r6(u * F.sin(turn) + v * F.cos(turn), "v"))


def _at_12_m(first, u, v, w, solid) -> dict:
    i, j = np.nonzero(~solid[:, :, 1] & ~solid[:, :, 2])
    t = (12.0 - 7.5) / 5
    return {"i": i + first[0], "j": j + first[1]} | {c: a[i, j, 1] + t * (a[i, j, 2] - a[i, j, 1]) for c, a in zip("uvw", (u, v, w))}


@query("wind_outputs")
def wind_outputs(s, d):
    """Speed and direction of the corrected field at 12 m, between levels: ``u`` to the east, ``v`` to the north, ``w`` up; direction as ``direction_of`` has it, clockwise degrees."""
    y = _solved(s, d, _at_12_m, "i bigint, j bigint, u double, v double, w double").select("i", "j", *[r6(F.col(c), c) for c in "uvw"])
    return y.withColumns({"speed": F.round(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 6), "direction": F.round(W.to_degrees(W.direction_of(F.col("u"), F.col("v"))), 6)})


def _turned(layer: DataFrame, degrees: int, x: float, y: float) -> DataFrame:
    """Boxes turned about (x, y) counter-clockwise by quarter turns, so that wind from ``degrees`` comes from the north."""
    if degrees % 90:
        raise ValueError(f"wind from {degrees} degrees: blocks are boxes, which only quarter turns keep")
    c, s = ((1, 0), (0, 1), (-1, 0), (0, -1))[degrees // 90 % 4]
    px = [x + c * (F.col(a) - x) - s * (F.col(b) - y) for a, b in (("xmin", "ymin"), ("xmax", "ymax"))]
    py = [y + s * (F.col(a) - x) + c * (F.col(b) - y) for a, b in (("xmin", "ymin"), ("xmax", "ymax"))]
    return layer.withColumns({"xmin": F.least(*px), "ymin": F.least(*py), "xmax": F.greatest(*px), "ymax": F.greatest(*py)})


def _swept(buildings: DataFrame, patches: DataFrame, winds: DataFrame, summary, schema: str) -> DataFrame:
    """(direction, rounds, and what ``summary`` keeps): the corrected field of a wind of 1 m/s from each direction of ``winds``, in a grid turned with the wind. Blocks and vegetation are turned
    about the upper right corner, and zones and field made anew, for each direction; all are cases of one solver."""
    directions = [r[0] for r in winds.select("direction").distinct().orderBy("direction").collect()]  # at most 360
    x, y = buildings.agg(F.max("xmax"), F.max("ymax")).first()
    cases = {}
    for a in directions:
        b = _turned(buildings, a, x, y)
        blocks = b.where("hauteur IS NOT NULL").select("id", "xmin", "ymin", "xmax", "ymax", F.col("hauteur").alias("h"))
        cases[int(a)] = blocks, _turned(patches, a, x, y), _bounds(b)
    kind = winds.schema["direction"].dataType
    return N.solved(cases, 1.0, summary, schema).withColumn("direction", F.col("case").cast(kind)).drop("case")


def _all_cells(first, u, v, w, solid) -> dict:
    i, j, k = (n.ravel() for n in np.indices(solid.shape))
    return {"i": i + first[0], "j": j + first[1], "k": k, "u": u.ravel(), "v": v.ravel(), "w": w.ravel(), "solid": solid.ravel()}


def swept(buildings: DataFrame, patches: DataFrame, winds: DataFrame) -> DataFrame:
    """(direction, v_ref, i, j, k, u, v, w, solid, rounds): the corrected field for each row of ``winds`` (direction, speed), vectors turned back into the map's frame.
    All steps are linear in the speed, so rows of one direction share the field of 1 m/s."""
    z = _swept(buildings, patches, winds, _all_cells, "i bigint, j bigint, k bigint, u double, v double, w double, solid boolean")
    t = -F.radians("direction")
    u, v = F.col("u") * F.cos(t) - F.col("v") * F.sin(t), F.col("u") * F.sin(t) + F.col("v") * F.cos(t)
    z = z.join(F.broadcast(winds.select("direction", F.col("speed").alias("v_ref"))), "direction")
    return z.select("direction", "v_ref", "i", "j", "k", (u * F.col("v_ref")).alias("u"), (v * F.col("v_ref")).alias("v"), (F.col("w") * F.col("v_ref")).alias("w"), "solid", "rounds")


def _speeds(first, u, v, w, solid) -> dict:
    return {"cells": [solid.size], "total": [float(np.hypot(u, v).sum())]}


@query("wind_batch")
def wind_batch(s, d):
    """A sweep over (direction, speed): the rows of ``wind_rose`` at the quarter turns. Oblique rows are not run, see README."""
    winds = cut(wind_rose(s, d).where("direction % 90 = 0"))
    x = _swept(view(s, d, "f_building"), _patches(s, d), winds, _speeds, "cells bigint, total double")
    x = x.join(F.broadcast(winds.select("direction", F.col("speed").alias("v_ref"))), "direction")
    speed = F.sum(F.col("total") * F.abs("v_ref")) / F.sum("cells")
    return x.groupBy("direction", F.col("v_ref")).agg(F.sum("cells").alias("cells"), r6(speed, "speed"), F.max("rounds").alias("rounds"))


QUERIES, ORACLES = book.queries, book.oracles
