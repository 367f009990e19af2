"""Rasters as pixel tables (r, c, v), point clouds, vector overlays and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.lookups import POINT_CLASSES, case, lookup
from ..operators import clip, components, polygons
from ..operators import joins as J
from .base import Book, view

book = Book()
query = book.query
P, B, L = "f_pixel", "f_building", "f_landcover"


def _p(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, P)


def _grid(s: SparkSession, rows: int, cols: int) -> DataFrame:
    return s.range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))


# Rasters ------------------------------------------------------------------------------------------------------------------------------------


@query("scan_raster", "SELECT r, c, v FROM f_pixel")
def scan_raster(s, d):
    return _p(s, d).select("r", "c", "v")


@query("raster_resample_resolution", "SELECT r // 2 AS r, c // 2 AS c, ROUND(AVG(v), 6) AS v FROM f_pixel GROUP BY r // 2, c // 2")
def raster_resample_resolution(s, d):
    return _p(s, d).groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(F.round(F.avg("v"), 6).alias("v"))


_SIZE = "SELECT i AS r, j AS c, p.v FROM (SELECT unnest(generate_series(0, 39))::BIGINT AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 39))::BIGINT AS j) b JOIN f_pixel p ON p.r = CAST(floor((i + 0.5) * 64 / 40) AS BIGINT) AND p.c = CAST(floor((j + 0.5) * 64 / 40) AS BIGINT)"


def _resized(s, d):
    """Nearest pixel of a 64 x 64 raster for each of 40 x 40."""
    g = _grid(s, 40, 40).withColumns({"pr": F.floor((F.col("r") + 0.5) * 64 / 40), "pc": F.floor((F.col("c") + 0.5) * 64 / 40)})
    p = _p(s, d).select(F.col("r").alias("pr"), F.col("c").alias("pc"), "v")
    return g.join(p, ["pr", "pc"]).select("r", "c", "v")


@query("raster_resample_size", _SIZE)
def raster_resample_size(s, d):
    return _resized(s, d)


@query("raster_interp_nearest", _SIZE)
def raster_interp_nearest(s, d):
    return _resized(s, d)


@query("raster_reproject", "SELECT r, c, CAST(700000 + c * 5.0 - 3 * r AS DOUBLE) AS x, CAST(6600000 - r * 5.0 + 2 * c AS DOUBLE) AS y, v FROM f_pixel")
def raster_reproject(s, d):
    """Pixel centres by an affine transform with shear."""
    return _p(s, d).select("r", "c", F.round(700000 + F.col("c") * 5.0 - 3 * F.col("r"), 6).alias("x"), F.round(6600000 - F.col("r") * 5.0 + 2 * F.col("c"), 6).alias("y"), "v")


@query("raster_projection", "SELECT sid, ROUND(radians(lon) * 6378137.0, 3) AS x, ROUND(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM f_station")
def raster_projection(s, d):
    m = view(s, d, "f_station").select("sid", G.to_mercator(F.col("lon"), F.col("lat")).alias("m"))
    return m.select("sid", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


@query("proj_convert_crs", "SELECT sid, ROUND(radians(lon) * 6378137.0, 3) AS x, ROUND(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 3) AS y FROM f_station")
def proj_convert_crs(s, d):
    return raster_projection(s, d)


@query("raster_crop_like", "SELECT r - 10 AS r, c - 20 AS c, v FROM f_pixel WHERE r BETWEEN 10 AND 39 AND c BETWEEN 20 AND 49")
def raster_crop_like(s, d):
    return _p(s, d).where("r BETWEEN 10 AND 39 AND c BETWEEN 20 AND 49").select((F.col("r") - 10).alias("r"), (F.col("c") - 20).alias("c"), "v")


@query("raster_crop_valid", "WITH b AS (SELECT MIN(r) AS r0, MAX(r) AS r1, MIN(c) AS c0, MAX(c) AS c1 FROM f_pixel WHERE v > 49) SELECT r - r0 AS r, c - c0 AS c, v FROM f_pixel, b WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def raster_crop_valid(s, d):
    p = _p(s, d)
    b = F.broadcast(p.where("v > 49").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")))
    return p.crossJoin(b).where("r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1").select((F.col("r") - F.col("r0")).alias("r"), (F.col("c") - F.col("c0")).alias("c"), "v")


@query("raster_clip_mask", "SELECT p.r, p.c, p.v FROM f_pixel p JOIN f_pixel m ON m.r = p.c AND m.c = p.r AND m.v > 40")
def raster_clip_mask(s, d):
    m = _p(s, d).where("v > 40").select(F.col("c").alias("r"), F.col("r").alias("c"))
    return _p(s, d).select("r", "c", "v").join(m, ["r", "c"], "left_semi")


@query("raster_align_like", "SELECT i AS r, j AS c, COALESCE(p.v, 1.0) AS v FROM (SELECT unnest(generate_series(0, 69))::BIGINT AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 69))::BIGINT AS j) b LEFT JOIN f_pixel p ON p.r = i AND p.c = j")
def raster_align_like(s, d):
    return _grid(s, 70, 70).join(_p(s, d).select("r", "c", "v"), ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(1.0)).alias("v"))


@query("raster_pad", "SELECT i AS r, j AS c, COALESCE(p.v, 0.0) AS v FROM (SELECT unnest(generate_series(0, 71))::BIGINT AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 71))::BIGINT AS j) b LEFT JOIN f_pixel p ON p.r = i - 4 AND p.c = j - 4")
def raster_pad(s, d):
    p = _p(s, d).select((F.col("r") + 4).alias("r"), (F.col("c") + 4).alias("c"), "v")
    return _grid(s, 72, 72).join(p, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


@query("raster_mask_where", "SELECT r, c, CASE WHEN n > 1 THEN v END AS v FROM f_pixel")
def raster_mask_where(s, d):
    return _p(s, d).select("r", "c", F.when(F.col("n") > 1, F.col("v")).alias("v"))


@query("raster_quantise_i16", "SELECT r, c, CAST(ROUND(v / 7, 3) * 1000 AS SMALLINT) AS q FROM f_pixel")
def raster_quantise_i16(s, d):
    return _p(s, d).select("r", "c", F.round(F.round(F.col("v") / 7, 3) * 1000).cast("smallint").alias("q"))


@query("raster_rescale_u8", "SELECT r, c, CAST(floor(v / (SELECT MAX(v) FROM f_pixel) * 255) AS SMALLINT) AS q FROM f_pixel")
def raster_rescale_u8(s, d):
    top = F.broadcast(_p(s, d).agg(F.max("v").alias("top")))
    return _p(s, d).crossJoin(top).select("r", "c", F.floor(F.col("v") / F.col("top") * 255).cast("smallint").alias("q"))


_BURN = "SELECT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c, MAX(b.hauteur) AS v FROM f_building b JOIN (SELECT unnest(generate_series(0, 2700)) AS i) y ON i * 5 + 2.5 >= b.ymin AND i * 5 + 2.5 < b.ymax JOIN (SELECT unnest(generate_series(0, 250)) AS j) x ON j * 5 + 2.5 >= b.xmin AND j * 5 + 2.5 < b.xmax WHERE b.hauteur IS NOT NULL GROUP BY i, j"


def _burnt(s, d, cell: float = 5.0):
    """Heights on a grid, the highest on top: each polygon generates the cell centres in its bounds, then the exact test."""
    b = G.with_box(view(s, d, B).where("hauteur IS NOT NULL"))
    span = lambda lo, hi: F.sequence(F.ceil(F.col(lo) / cell - 0.5), F.floor(F.col(hi) / cell - 0.5))
    some = b.where((F.ceil(F.col("xmin") / cell - 0.5) <= F.floor(F.col("xmax") / cell - 0.5)) & (F.ceil(F.col("ymin") / cell - 0.5) <= F.floor(F.col("ymax") / cell - 0.5)))
    cells = some.select("geom", "hauteur", F.explode(span("ymin", "ymax")).alias("r"), "xmin", "xmax").select("geom", "hauteur", "r", F.explode(span("xmin", "xmax")).alias("c"))
    hit = cells.where(G.contains(F.col("geom"), (F.col("c") + 0.5) * cell, (F.col("r") + 0.5) * cell))
    return hit.groupBy("r", "c").agg(F.max("hauteur").alias("v"))


@query("raster_from_polygons", _BURN)
def raster_from_polygons(s, d):
    return _burnt(s, d)


@query("raster_burn_mask", _BURN.replace("MAX(b.hauteur) AS v", "1 AS v"))
def raster_burn_mask(s, d):
    return _burnt(s, d).select("r", "c", F.lit(1).alias("v"))


@query("raster_rasterize_touched", "SELECT DISTINCT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c FROM f_building b JOIN (SELECT unnest(generate_series(0, 1400)) AS i) y ON i * 10 <= b.ymax AND i * 10 + 10 > b.ymin JOIN (SELECT unnest(generate_series(0, 120)) AS j) x ON j * 10 <= b.xmax AND j * 10 + 10 > b.xmin")
def raster_rasterize_touched(s, d):
    b = J.on_cells(view(s, d, B), 10.0)
    return b.select(F.col("cy").alias("r"), F.col("cx").alias("c")).distinct()


_ZONAL = "SELECT b.id, ROUND(AVG(p.v), 6) AS dem FROM f_building b JOIN f_pixel p ON p.c * 15 + 7.5 >= b.xmin - 10 AND p.c * 15 + 7.5 < b.xmax + 10 AND p.r * 15 + 7.5 >= b.ymin - 10 AND p.r * 15 + 7.5 < b.ymax + 10 GROUP BY b.id"


def _zonal(s, d):
    px = _p(s, d).select((F.col("c") * 15 + 7.5).alias("x"), (F.col("r") * 15 + 7.5).alias("y"), "v")
    b = view(s, d, B).select("id", "hauteur", *[(F.col(c) + k).alias(c) for c, k in (("xmin", -10), ("ymin", -10), ("xmax", 10), ("ymax", 10))])
    return J.points_in_cells(px, b, 64.0).where("x < xmax AND y < ymax").groupBy("id").agg(F.avg("v").alias("dem"), F.max("hauteur").alias("h"))


@query("agg_zonal_mean", _ZONAL)
def agg_zonal_mean(s, d):
    """Mean of the pixels under each footprint, widened by 10 m."""
    return _zonal(s, d).select("id", F.round("dem", 6).alias("dem"))


@query("raster_dsm_compose", f"SELECT z.id, ROUND(z.dem + COALESCE(b.hauteur, 0), 6) AS height_asl FROM ({_ZONAL}) z JOIN f_building b ON b.id = z.id")
def raster_dsm_compose(s, d):
    """Ground under each building plus its height."""
    return _zonal(s, d).select("id", F.round(F.round("dem", 6) + F.coalesce("h", F.lit(0.0)), 6).alias("height_asl"))


@query("raster_merge_tiles", "SELECT r, c, CASE WHEN r < 40 THEN v ELSE v2 END AS v FROM (SELECT r, c, v, v + 100 AS v2 FROM f_pixel WHERE r < 40 OR r >= 30) t")
def raster_merge_tiles(s, d):
    """A mosaic: where tiles overlap the first one shows."""
    a = _p(s, d).where("r < 40").select("r", "c", "v", F.lit(0).alias("tile"))
    b = _p(s, d).where("r >= 30").select("r", "c", (F.col("v") + 100).alias("v"), F.lit(1).alias("tile"))
    return a.unionByName(b).groupBy("r", "c").agg(F.min_by("v", "tile").alias("v"))


@query("raster_stack_time", "SELECT site_id, time, y, x, utci, wind FROM comfort_cells WHERE obs_ok".replace("obs_ok", "shadow IS NOT NULL AND utci IS NOT NULL AND NOT isnan(utci)"))
def raster_stack_time(s, d):
    return view(s, d, "comfort_cells").where("shadow IS NOT NULL AND utci IS NOT NULL AND NOT isnan(utci)").select("site_id", "time", "y", "x", "utci", "wind")


@query("raster_scale_by_speed", "SELECT w.ts_h, p.r, p.c, ROUND(p.v / 50 * w.ws, 6) AS speed FROM f_pixel p JOIN f_weather w ON hour(w.ts_h) = p.r % 24")
def raster_scale_by_speed(s, d):
    w = view(s, d, "f_weather").withColumn("h", F.hour("ts_h").cast("long"))
    return _p(s, d).withColumn("h", F.col("r") % 24).join(w, "h").select("ts_h", "r", "c", F.round(F.col("v") / 50 * F.col("ws"), 6).alias("speed"))


def _mask(name: str, when: str):
    sql = f"SELECT site_id, time, y, x, CASE WHEN {when} THEN utci END AS utci FROM comfort_cells WHERE utci IS NOT NULL AND NOT isnan(utci) AND shadow IS NOT NULL AND NOT isnan(shadow)"

    @query(name, sql)
    def masked(s, d):
        c = view(s, d, "comfort_cells").where("utci IS NOT NULL AND NOT isnan(utci) AND shadow IS NOT NULL AND NOT isnan(shadow)")
        return c.select("site_id", "time", "y", "x", F.when(F.expr(when), F.col("utci")).alias("utci"))


_mask("raster_sun_mask", "shadow > 0.5")
_mask("raster_shadow_mask", "shadow < 0.5")
_mask("raster_partial_shade", "shadow > 0 AND shadow < 1")


@query("raster_griddata_linear", "SELECT a.r, a.c, ROUND((a.v + b.v + e.v + f.v) / 4, 6) AS v FROM f_pixel a JOIN f_pixel b ON b.r = a.r AND b.c = a.c + 1 JOIN f_pixel e ON e.r = a.r + 1 AND e.c = a.c JOIN f_pixel f ON f.r = a.r + 1 AND f.c = a.c + 1")
def raster_griddata_linear(s, d):
    """Bilinear values at the corners between four pixels: each pixel goes to the four corners that it touches, one aggregation, no joins."""
    p = _p(s, d)
    corner = F.explode(F.array(*[F.struct((F.col("r") - i).alias("r"), (F.col("c") - j).alias("c")) for i in (0, 1) for j in (0, 1)]))
    g = p.select(corner.alias("k"), "v").groupBy("k.r", "k.c").agg(F.count("*").alias("n"), F.sum("v").alias("t"))
    return g.where("n = 4").select("r", "c", F.round(F.col("t") / 4, 6).alias("v"))


@query("raster_dem_fetch", "SELECT r, c, v FROM f_pixel WHERE abs(r - 31.5) <= 32 * 0.85 AND abs(c - 31.5) <= 32 * 0.85")
def raster_dem_fetch(s, d):
    return _p(s, d).where("abs(r - 31.5) <= 32 * 0.85 AND abs(c - 31.5) <= 32 * 0.85").select("r", "c", "v")


@query("raster_sample_points", "SELECT t.oid, t.lno, p.v FROM f_point t LEFT JOIN f_pixel p ON p.r = CAST(floor(t.y / 3.2) AS BIGINT) AND p.c = CAST(floor(t.x / 3.2) AS BIGINT)")
def raster_sample_points(s, d):
    t = view(s, d, "f_point").select("oid", "lno", F.floor(F.col("y") / 3.2).alias("r"), F.floor(F.col("x") / 3.2).alias("c"))
    return t.join(_p(s, d).select("r", "c", "v"), ["r", "c"], "left").select("oid", "lno", "v")


@query("raster_ndvi_polygons")
def raster_ndvi_polygons(s, d):
    """Vegetation patches as polygons: pixels above the threshold, joined where they touch by a side; patches of one pixel are dropped."""
    i = F.try_divide(F.col("v") - 25, F.col("v") + 25)
    return _patches(_p(s, d).where(i >= 0.2).select("r", "c")).where("area > 1")


#: From one row of cells to the next in the numbering of cells; no raster is as wide.
_ROW = 1 << 32


def _cell_id():
    return F.col("r").cast("long") * _ROW + F.col("c")


def _patches(px: DataFrame) -> DataFrame:
    """(component, area, outlines, rings) of 4-connected pixels: their squares dissolved, holes included."""
    n = px.select(_cell_id().alias("id"), "r", "c")
    links = n.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + _ROW)).alias("b")).join(n.select(F.col("id").alias("b")), "b", "left_semi")
    square = F.array(G.box_ring(F.col("c").cast("double"), F.col("r").cast("double"), F.col("c") + 1.0, F.col("r") + 1.0))
    cells = components.connected(n.select("id"), links).join(n, "id").select("component", square.alias("rings"))
    return polygons.dissolve(cells, "component", 2.0).select("component", polygons.area_of("rings").alias("area"), F.size("rings").alias("outlines"), "rings")


@query("raster_to_polygons")
def raster_to_polygons(s, d):
    """Zones of pixels of one class, 4-connected, as polygons."""
    return _patches(_p(s, d).where("v >= 45").select("r", "c"))


_HEX = G.hexagon_sql("(SELECT r AS row_, c AS col_, v FROM f_pixel)", "col_", "row_", 4.0, "row_, col_, v")


@query("agg_hex_last", f"SELECT q, r, v FROM (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY row_ DESC, col_ DESC) AS k FROM ({_HEX}) h) t WHERE k = 1")
def agg_hex_last(s, d):
    """The last pixel of each hexagon (planar hexagons, not the public system of the sphere)."""
    k = F.max(F.struct("r", "c", "v")).alias("m")
    return _p(s, d).groupBy(G.hexagon(F.col("c").cast("double"), F.col("r").cast("double"), 4.0).alias("h")).agg(k).select("h.q", "h.r", "m.v")


# Point clouds -------------------------------------------------------------------------------------------------------------------------------


@query("pc_classify_names", f"SELECT cls, {case('cls', POINT_CLASSES)} AS name, CAST(COUNT(*) AS BIGINT) AS n FROM f_point GROUP BY cls")
def pc_classify_names(s, d):
    return view(s, d, "f_point").groupBy("cls").agg(F.count("*").alias("n")).select("cls", lookup(F.col("cls"), POINT_CLASSES).alias("name"), "n")


_DSM = "SELECT CAST(floor(x / 5) AS BIGINT) AS c, CAST(floor(y / 5) AS BIGINT) AS r, MAX(CASE WHEN cls IN (3,4,5) THEN z END) AS dsm, MIN(CASE WHEN cls = 2 THEN z END) AS dtm FROM f_point GROUP BY 1, 2"


def _dsm(s, d):
    return view(s, d, "f_point").groupBy(F.floor(F.col("x") / 5).alias("c"), F.floor(F.col("y") / 5).alias("r")).agg(F.max(F.when(F.col("cls").isin(3, 4, 5), F.col("z"))).alias("dsm"), F.min(F.when(F.col("cls") == 2, F.col("z"))).alias("dtm"))


@query("pc_dsm_dtm_chm", f"SELECT r, c, dsm, dtm, greatest(dsm - dtm, 0) AS chm FROM ({_DSM}) t WHERE dsm IS NOT NULL AND dtm IS NOT NULL")
def pc_dsm_dtm_chm(s, d):
    return _dsm(s, d).where("dsm IS NOT NULL AND dtm IS NOT NULL").select("r", "c", "dsm", "dtm", F.greatest(F.col("dsm") - F.col("dtm"), F.lit(0.0)).alias("chm"))


@query("pc_orient", f"SELECT 40 - r AS r, c, dsm FROM ({_DSM}) t")
def pc_orient(s, d):
    return _dsm(s, d).select((40 - F.col("r")).alias("r"), "c", "dsm")


_GAUSS = "SELECT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(w * z) / SUM(w), 5) AS v, ROUND(SUM(w), 5) AS weight, ROUND(AVG(z), 5) AS mean FROM (SELECT i, j, z, exp(-(pow(x - (j * 4 + 2), 2) + pow(y - (i * 4 + 2), 2)) / (2 * 2.0 * 2.0)) AS w FROM f_point JOIN (SELECT unnest(generate_series(0, 50)) AS i) a ON abs(y - (i * 4 + 2)) < 6 JOIN (SELECT unnest(generate_series(0, 50)) AS j) b ON abs(x - (j * 4 + 2)) < 6 WHERE cls = 2 AND sqrt(pow(x - (j * 4 + 2), 2) + pow(y - (i * 4 + 2), 2)) < 6) t GROUP BY i, j"


def _gauss(s, d):
    """Gaussian means of ground heights in discs around cell centres: each point goes to the cells whose disc holds it, one combined aggregation."""
    p = view(s, d, "f_point").where("cls = 2").select("x", "y", "z")
    near = F.sequence(F.lit(-2), F.lit(2))
    e = p.withColumn("i", F.explode(F.transform(near, lambda k: F.floor(F.col("y") / 4) + k))).withColumn("j", F.explode(F.transform(near, lambda k: F.floor(F.col("x") / 4) + k))).where("i BETWEEN 0 AND 50 AND j BETWEEN 0 AND 50")
    d2 = F.pow(F.col("x") - (F.col("j") * 4 + 2), 2) + F.pow(F.col("y") - (F.col("i") * 4 + 2), 2)
    e = e.withColumn("d2", d2).where("sqrt(d2) < 6").withColumn("w", F.exp(-F.col("d2") / 8.0))
    return e.groupBy(F.col("i").alias("r"), F.col("j").alias("c")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("z")) / F.sum("w"), 5).alias("v"), F.round(F.sum("w"), 5).alias("weight"), F.round(F.avg("z"), 5).alias("mean"))


@query("agg_gauss_disc", _GAUSS)
def agg_gauss_disc(s, d):
    return _gauss(s, d)


@query("pc_gauss_raster", _GAUSS)
def pc_gauss_raster(s, d):
    return _gauss(s, d)


@query("pc_to_tif", f"SELECT r, c, v, CASE WHEN v > 25 THEN 5 ELSE 2 END AS cls FROM ({_GAUSS}) t")
def pc_to_tif(s, d):
    return _gauss(s, d).select("r", "c", "v", F.when(F.col("v") > 25, 5).otherwise(2).alias("cls"))


@query("pc_las_bbox", "SELECT MIN(x) AS x0, MIN(y) AS y0, MIN(z) AS z0, MAX(x) AS x1, MAX(y) AS y1, MAX(z) AS z1 FROM f_point")
def pc_las_bbox(s, d):
    return view(s, d, "f_point").agg(*[f(c).alias(f"{c}{k}") for f, k in ((F.min, 0), (F.max, 1)) for c in "xyz"])


_TOPS = "SELECT a.r, a.c, a.chm FROM ch a LEFT JOIN ch b ON abs(a.r - b.r) <= 5 AND abs(a.c - b.c) <= 5 AND (b.chm > a.chm OR (b.chm = a.chm AND (b.r, b.c) < (a.r, a.c))) WHERE a.chm >= 2 AND b.r IS NULL"


@query("pc_tree_tops", f"WITH ch AS (SELECT r, c, greatest(dsm - dtm, 0) AS chm FROM ({_DSM}) t WHERE dsm IS NOT NULL AND dtm IS NOT NULL) {_TOPS}")
def pc_tree_tops(s, d):
    """Cells that no other within five cells tops (ties to the first): cells meet in blocks of 16 with a margin, and each block is judged by itself."""
    ch = _dsm(s, d).where("dsm IS NOT NULL AND dtm IS NOT NULL").select("r", "c", F.greatest(F.col("dsm") - F.col("dtm"), F.lit(0.0)).alias("chm"))
    blocks = lambda k: F.sequence(F.floor((F.col(k) - 5) / 16), F.floor((F.col(k) + 5) / 16))
    spread = ch.withColumn("bi", F.explode(blocks("r"))).withColumn("bj", F.explode(blocks("c")))
    a, b = ch.withColumns({"bi": F.floor(F.col("r") / 16), "bj": F.floor(F.col("c") / 16)}).where("chm >= 2").alias("a"), spread.alias("b")
    beats = (F.col("b.chm") > F.col("a.chm")) | ((F.col("b.chm") == F.col("a.chm")) & (F.struct("b.r", "b.c") < F.struct("a.r", "a.c")))
    near = (F.abs(F.col("a.r") - F.col("b.r")) <= 5) & (F.abs(F.col("a.c") - F.col("b.c")) <= 5)
    return a.join(b, (F.col("a.bi") == F.col("b.bi")) & (F.col("a.bj") == F.col("b.bj")) & near & beats, "left_anti").select("a.r", "a.c", "a.chm")


_CANOPY = "SELECT CAST(floor(y / 4) AS BIGINT) AS r, CAST(floor(x / 4) AS BIGINT) AS c, MAX(z) - MIN(z) AS chm FROM f_point GROUP BY 1, 2"


@query(
    "pc_watershed",
    f"WITH RECURSIVE ch AS (SELECT r * 4294967296 + c AS id, chm FROM ({_CANOPY}) t WHERE chm >= 2), up AS (SELECT a.id, arg_max(b.id, struct_pack(h := b.chm, i := b.id)) AS top FROM ch a JOIN ch b ON b.id IN (a.id, a.id + 1, a.id - 1, a.id + 4294967296, a.id + 4294967297, a.id + 4294967295, a.id - 4294967296, a.id - 4294967297, a.id - 4294967295) GROUP BY a.id), "
    "walk(id, spot) AS (SELECT id, top FROM up UNION SELECT w.id, u.top FROM walk w JOIN up u ON u.id = w.spot) "
    "SELECT k.cells, ch.chm AS height, CAST(COUNT(*) AS BIGINT) AS crowns FROM (SELECT w.spot AS top, CAST(COUNT(DISTINCT w.id) AS BIGINT) AS cells FROM walk w JOIN up u ON u.id = w.spot AND u.top = w.spot GROUP BY w.spot) k JOIN ch ON ch.id = k.top GROUP BY k.cells, ch.chm",
)
def pc_watershed(s, d):
    """Crowns: every cell of the canopy belongs to the top that it reaches by always stepping to its highest neighbour. Told by how many crowns have a size and height."""
    ch = view(s, d, "f_point").groupBy(F.floor(F.col("y") / 4).alias("r"), F.floor(F.col("x") / 4).alias("c")).agg((F.max("z") - F.min("z")).alias("chm")).where("chm >= 2").select(_cell_id().alias("id"), "chm")
    crown = crowns(ch)
    return crown.join(ch, "id").groupBy("component").agg(F.count("*").alias("cells"), F.max("chm").alias("height")).groupBy("cells", "height").agg(F.count("*").alias("crowns"))


def crowns(ch: DataFrame) -> DataFrame:
    """(id, component) of cells (id, chm): steps to the highest neighbour (ties to the greater id) as links, then components."""
    around = F.explode(F.array(*[F.col("id") + _ROW * i + j for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("to")
    up = ch.select(F.col("id").alias("from"), around).join(ch.select(F.col("id").alias("to"), "chm"), "to").groupBy("from").agg(F.max_by("to", F.struct("chm", "to")).alias("to"))
    return components.connected(ch.select("id"), up.select(F.col("from").alias("a"), F.col("to").alias("b")).where("a <> b"))


@query("pc_polygonize_class", "SELECT CAST(floor(x/20) AS BIGINT) AS i, CAST(floor(y/20) AS BIGINT) AS j, cls, CAST(COUNT(*) AS BIGINT) AS n, MAX(z) AS top FROM f_point GROUP BY 1, 2, 3")
def pc_polygonize_class(s, d):
    return view(s, d, "f_point").groupBy(F.floor(F.col("x") / 20).alias("i"), F.floor(F.col("y") / 20).alias("j"), "cls").agg(F.count("*").alias("n"), F.max("z").alias("top"))


@query("pc_kdtree_chunks", "SELECT CAST(floor(x/50)*10 + floor(y/50) AS BIGINT) AS chunk, CAST(COUNT(*) AS BIGINT) AS n FROM f_point GROUP BY 1")
def pc_kdtree_chunks(s, d):
    return view(s, d, "f_point").groupBy((F.floor(F.col("x") / 50) * 10 + F.floor(F.col("y") / 50)).alias("chunk")).agg(F.count("*").alias("n"))


@query("pc_reclass_ground", "SELECT v.oid, v.lno, CASE WHEN MAX(CASE WHEN g.z >= v.z THEN 1 ELSE 0 END) = 1 THEN 2 ELSE 5 END AS cls FROM f_point v LEFT JOIN f_point g ON g.cls = 2 AND pow(v.x - g.x, 2) + pow(v.y - g.y, 2) <= 1 WHERE v.cls = 5 GROUP BY v.oid, v.lno")
def pc_reclass_ground(s, d):
    """High vegetation with ground as high within a metre is ground."""
    p = view(s, d, "f_point")
    veg = p.where("cls = 5").select("oid", "lno", "x", "y", "z")
    low = J.within(veg, p.where("cls = 2").select("x", "y", "z"), 1.0).where("b.z >= a.z").select(F.col("a.oid").alias("oid"), F.col("a.lno").alias("lno")).distinct().withColumn("hit", F.lit(2))
    return veg.select("oid", "lno").distinct().join(low, ["oid", "lno"], "left").select("oid", "lno", F.coalesce("hit", F.lit(5)).alias("cls"))


@query("tree_points_hex", "SELECT id, CAST(k AS INTEGER) AS k, ROUND(xmin + 17 + 5 * cos(k * pi() / 3), 6) AS x, ROUND(ymin + 17 + 5 * sin(k * pi() / 3), 6) AS y, 6.0::DOUBLE AS height FROM f_landcover CROSS JOIN (SELECT unnest(generate_series(0, 5)) AS k) g WHERE class_id IN (5, 6)")
def tree_points_hex(s, d):
    c = view(s, d, L).where("class_id IN (5, 6)")
    ring = G.circle(F.col("xmin") + 17, F.col("ymin") + 17, 5.0, 6)
    return c.select("id", F.posexplode(F.slice(ring, 1, 6)).alias("k", "p")).select("id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.lit(6.0).alias("height"))


@query("urock_veg_hex", "SELECT oid, lno, ROUND(3 * sqrt(3) / 2 * 4, 6) AS area, COALESCE(z, 6) AS max_height, 0.25 * COALESCE(z, 6) AS min_height, 1.0::DOUBLE AS attenuatio FROM f_point WHERE cls = 4")
def urock_veg_hex(s, d):
    p = view(s, d, "f_point").where("cls = 4").withColumn("hex", G.circle(F.col("x"), F.col("y"), 2.0, 6))
    h = F.coalesce("z", F.lit(6.0))
    return p.select("oid", "lno", F.round(G.area(F.col("hex")), 6).alias("area"), h.alias("max_height"), (0.25 * h).alias("min_height"), F.lit(1.0).alias("attenuatio"))


# Shapes -----------------------------------------------------------------------------------------------------------------------------------


@query("agg_connected_blocks")
def agg_connected_blocks(s, d):
    """Blocks: buildings that come within 10 m of each other, by components."""
    b = view(s, d, B)
    wide = b.select("id", *[(F.col(c) + k).alias(c) for c, k in (("xmin", -5), ("ymin", -5), ("xmax", 5), ("ymax", 5))])
    links = J.boxes_that_meet(wide, wide, 64.0).where("a.id < b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return components.connected(b.select("id"), links)


@query("agg_make_line_poly", "SELECT r, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(step), 6) AS len FROM (SELECT r, COALESCE(sqrt(pow(c - lag(c) OVER w, 2) + pow(v - lag(v) OVER w, 2)), 0) AS step FROM f_pixel WINDOW w AS (PARTITION BY r ORDER BY c)) t GROUP BY r")
def agg_make_line_poly(s, d):
    """A line per row of pixels through its points in order, and its length."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda p: G.point(p["c"], p["v"]))
    return _p(s, d).groupBy("r").agg(line.alias("line")).select("r", F.size("line").cast("long").alias("n"), F.round(G.length(F.col("line")), 6).alias("len"))


@query("agg_convex_hull", "SELECT cls, MIN(x) AS xmin, MAX(x) AS xmax, MIN(y) AS ymin, MAX(y) AS ymax FROM f_point GROUP BY cls")
def agg_convex_hull(s, d):
    """The hull of each class, told by its bounds."""
    h = clip.hulls(view(s, d, "f_point").select("cls", "x", "y"), "cls").select("cls", G.bounds(F.col("hull")).alias("b"))
    return h.select("cls", "b.xmin", "b.xmax", "b.ymin", "b.ymax")


@query("agg_concave_hull", "SELECT cls, ROUND(COUNT(*) * 25.0, 4) AS area FROM (SELECT DISTINCT cls, floor(x / 5), floor(y / 5) FROM f_point) t GROUP BY cls")
def agg_concave_hull(s, d):
    """The outline of each class's points, not finer than 5 m: the squares of a grid that hold points, dissolved. Hollows and gaps wider than that stay open."""
    i, j = F.floor(F.col("x") / 5), F.floor(F.col("y") / 5)
    return outline(view(s, d, "f_point").select("cls", i.alias("i"), j.alias("j")), "cls", 5.0).select("cls", F.round(polygons.area_of("rings"), 4).alias("area"))


def outline(cells: DataFrame, key: str, size: float) -> DataFrame:
    """(``key``, rings) of grid squares ``i``, ``j`` of side ``size``, dissolved."""
    x, y = F.col("i") * size, F.col("j") * size
    return polygons.dissolve(cells.distinct().select(key, F.array(G.box_ring(x, y, x + size, y + size)).alias("rings")), key, 2 * size)


# Graphs -------------------------------------------------------------------------------------------------------------------------------------

_CLEAN = "SELECT tail, head, MIN(len) AS len FROM (SELECT tail, head, len FROM f_edge UNION ALL SELECT head, tail, len FROM f_edge) t WHERE tail <> head GROUP BY tail, head"


def _clean(s, d):
    e = view(s, d, "f_edge")
    return e.unionByName(e.select(F.col("head").alias("tail"), F.col("tail").alias("head"), "len")).where("tail <> head").groupBy("tail", "head").agg(F.min("len").alias("len"))


@query("graph_clean_edges", _CLEAN)
def graph_clean_edges(s, d):
    return _clean(s, d)


@query("graph_reindex", "SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS rank FROM (SELECT tail AS node FROM f_edge UNION SELECT head FROM f_edge) t")
def graph_reindex(s, d):
    e = view(s, d, "f_edge")
    return J.ranked(e.select(F.col("tail").alias("node")).union(e.select("head")).distinct(), "node").select("node", "rank")


@query("graph_connectors", "SELECT 'poi' AS a, CAST(sid AS VARCHAR) AS b, ROUND(3.6 * sqrt(pow(lat - 46.5, 2) + pow(lon - 2.5, 2)) * 1000 / 5, 6) AS seconds FROM (SELECT * FROM f_station ORDER BY pow(lat - 46.5, 2) + pow(lon - 2.5, 2), sid LIMIT 5) t UNION ALL SELECT CAST(sid AS VARCHAR), 'poi', ROUND(3.6 * sqrt(pow(lat - 46.5, 2) + pow(lon - 2.5, 2)) * 1000 / 5, 6) FROM (SELECT * FROM f_station ORDER BY pow(lat - 46.5, 2) + pow(lon - 2.5, 2), sid LIMIT 5) t")
def graph_connectors(s, d):
    """A point of interest linked, both ways, to its five nearest nodes at walking speed."""
    dist2 = F.pow(F.col("lat") - 46.5, 2) + F.pow(F.col("lon") - 2.5, 2)
    k = view(s, d, "f_station").orderBy(dist2, "sid").limit(5).select(F.lit("poi").alias("a"), F.col("sid").cast("string").alias("b"), F.round(3.6 * F.sqrt(dist2) * 1000 / 5, 6).alias("seconds"))
    return k.unionByName(k.select(F.col("b").alias("a"), F.col("a").alias("b"), "seconds"))


_PATHS = "WITH RECURSIVE e AS (SELECT tail, head, len FROM f_edge), walk(node, t, k) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE), 0 UNION ALL SELECT node, MIN(t), MIN(k) FROM (SELECT e.head AS node, w.t + e.len AS t, w.k + 1 AS k FROM walk w JOIN e ON e.tail = w.node WHERE w.k < 7) x GROUP BY node) SELECT node, MIN(t) AS t FROM walk GROUP BY node"


@query("graph_dijkstra", _PATHS)
def graph_dijkstra(s, d):
    """Least travel time from node 1."""
    return components.shortest(view(s, d, "f_edge"), 1)


@query("graph_isochrones", f"SELECT CAST(m AS INTEGER) AS minutes, CAST(COUNT(*) AS BIGINT) AS n, ROUND(COUNT(DISTINCT node) * 10000.0, 4) AS area FROM ({_PATHS}) t JOIN (SELECT unnest([20, 40, 60]) AS m) g ON t.t <= m GROUP BY m")
def graph_isochrones(s, d):
    """What is reached within 20, 40 and 60 minutes, and the outline of it: nodes stand on a grid of 100 m, and their squares are dissolved."""
    t = components.shortest(view(s, d, "f_edge"), 1)
    within = t.select("node", F.explode(F.filter(F.array(F.lit(20), F.lit(40), F.lit(60)), lambda m: F.col("t") <= m)).alias("minutes"))
    hull = outline(within.select("minutes", F.floor(F.col("node") / 10).alias("i"), (F.col("node") % 10).alias("j")), "minutes", 100.0)
    return within.groupBy("minutes").agg(F.count("*").alias("n")).join(hull, "minutes").select("minutes", "n", F.round(polygons.area_of("rings"), 4).alias("area"))


@query("urban_types")
def urban_types(s, d):
    """Building types: shape measures, z-scores, k-means with a fixed seed. Labels are arbitrary; sizes and means tell the types."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    b = G.with_box(view(s, d, B).where("hauteur IS NOT NULL"))
    area, w, h = G.area(F.col("geom")), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    m = b.select("id", area.alias("area"), (F.least(w, h) / F.greatest(w, h)).alias("elongation"), F.col("hauteur").alias("height"))
    v = VectorAssembler(inputCols=["area", "elongation", "height"], outputCol="v").transform(m)
    z = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(v).transform(v)
    c = KMeans(k=4, seed=42, featuresCol="z", predictionCol="type").fit(z).transform(z)
    return c.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("area"), 3).alias("area"), F.round(F.avg("height"), 3).alias("height"))


_PI = 3.141592653589793
_RAYS, _REACH = 16, 60.0
_DIRECTION = "SELECT k, sin(2 * pi() * (k + 0.3) / 16) AS dx, cos(2 * pi() * (k + 0.3) / 16) AS dy FROM (SELECT unnest(generate_series(0, 15)) AS k) g"
_SLAB = "greatest(least((b.xmin - p.x) / dx, (b.xmax - p.x) / dx), least((b.ymin - p.y) / dy, (b.ymax - p.y) / dy))"
_FAR = "least(greatest((b.xmin - p.x) / dx, (b.xmax - p.x) / dx), greatest((b.ymin - p.y) / dy, (b.ymax - p.y) / dy))"


@query(
    "svf_vector",
    f"WITH p AS (SELECT id, xmin - 2 AS x, ymin - 2 AS y FROM f_building), near AS (SELECT p.id, p.x, p.y, b.xmin, b.ymin, b.xmax, b.ymax, COALESCE(b.hauteur, 3) AS h FROM p JOIN f_building b ON b.xmin <= p.x + 60 AND b.xmax >= p.x - 60 AND b.ymin <= p.y + 60 AND b.ymax >= p.y - 60), "
    f"hit AS (SELECT p.id, k, h, {_SLAB.replace('b.', 'p.')} AS t0, {_FAR.replace('b.', 'p.')} AS t1 FROM near p, ({_DIRECTION}) g), top AS (SELECT id, k, MAX(h / t0) AS slope FROM hit WHERE t0 <= t1 AND t0 > 0 AND t0 <= 60 GROUP BY id, k) "
    "SELECT p.id, ROUND(1 - COALESCE(SUM(slope * slope / (1 + slope * slope)), 0) / 16, 6) AS svf FROM p LEFT JOIN top ON top.id = p.id GROUP BY p.id",
)
def svf_vector(s, d):
    """Sky seen from the ground 2 m off a building's corner: 16 rays of 60 m, the horizon of each by the building on it that stands highest above the view, mean of the squared cosine."""
    b = view(s, d, B)
    x, y = F.col("xmin") - 2, F.col("ymin") - 2
    eyes = b.select("id", (x - _REACH).alias("xmin"), (y - _REACH).alias("ymin"), (x + _REACH).alias("xmax"), (y + _REACH).alias("ymax"), x.alias("x"), y.alias("y"))
    met = J.boxes_that_meet(eyes, b, 64.0).select("a.id", "a.x", "a.y", *[F.col(f"b.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.coalesce("b.hauteur", F.lit(3.0)).alias("h"))
    r = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(_RAYS - 1))))
    turn = 2 * _PI * (F.col("k") + 0.3) / _RAYS
    dx, dy = F.sin(turn), F.cos(turn)
    ends = [((F.col(f"{c}min") - F.col(c)) / v, (F.col(f"{c}max") - F.col(c)) / v) for c, v in (("x", dx), ("y", dy))]
    t0, t1 = F.greatest(*[F.least(*e) for e in ends]), F.least(*[F.greatest(*e) for e in ends])
    top = r.select("id", "k", "h", t0.alias("t0"), t1.alias("t1")).where(f"t0 <= t1 AND t0 > 0 AND t0 <= {_REACH}").groupBy("id", "k").agg(F.max(F.col("h") / F.col("t0")).alias("slope"))
    hidden = top.groupBy("id").agg(F.sum(F.col("slope") * F.col("slope") / (1 + F.col("slope") * F.col("slope"))).alias("hidden"))
    return b.select("id").join(hidden, "id", "left").select("id", F.round(1 - F.coalesce("hidden", F.lit(0.0)) / _RAYS, 6).alias("svf"))


QUERIES, ORACLES = book.queries, book.oracles
