"""Sources and sinks: layers written in a format and read back, held against the tables they came from; and readers over text made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.lookups import CLIMATE_ZONES, case, lookup
from ..operators import clip
from ..operators import joins as J
from ..session import cut, shared_folder
from ..sources import formats as X
from .base import Book, view

book = Book()
query = book.query
B, W = "f_building", "f_weather"


def _place(s: SparkSession) -> str:
    return f"{shared_folder(s).rstrip('/')}/aerolith/{uuid.uuid4().hex}"


def _rings(s, d) -> DataFrame:
    return G.with_box(view(s, d, B)).select("id", "hauteur", F.array("geom").alias("rings"))


_AREA = "SELECT id, hauteur, (xmax - xmin) * (ymax - ymin) AS area FROM f_building"


def _geojson(s, d) -> DataFrame:
    place = _place(s)
    X.write_geojson(_rings(s, d), place)
    return X.read_geojson(s, place, "id bigint, hauteur double")


@query("scan_geojson", _AREA)
def scan_geojson(s, d):
    return _geojson(s, d).select("id", "hauteur", G.area(F.col("rings")[0]).alias("area"))


@query("sink_geojson", _AREA)
def sink_geojson(s, d):
    return _geojson(s, d).select("id", "hauteur", G.area(F.col("rings")[0]).alias("area"))


@query("geojson_merge", "SELECT id, hauteur FROM f_building UNION ALL SELECT id, hauteur FROM f_building")
def geojson_merge(s, d):
    a, b = _place(s), _place(s)
    X.write_geojson(_rings(s, d), a)
    X.write_geojson(_rings(s, d), b)
    one = lambda p: X.read_geojson(s, p, "id bigint, hauteur double").select("id", "hauteur")
    return one(a).unionByName(one(b))


def _osm(s, d) -> DataFrame:
    """Elements as a map service answers: nodes, ways of references to nodes with tags; one element a line."""
    place = _place(s)
    b = G.with_box(view(s, d, B))
    corner = b.select("id", F.posexplode(F.slice("geom", 1, 4)).alias("k", "p"))
    nodes = corner.select(F.to_json(F.struct(F.lit("node").alias("type"), (F.col("id") * 4 + F.col("k")).alias("id"), F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))).alias("value"))
    refs = F.array(*[F.col("id") * 4 + k for k in (0, 1, 2, 3, 0)])
    use = F.element_at(F.array(*map(F.lit, ("footway", "pedestrian", "residential", "steps"))), (F.col("id") % 4 + 1).cast("int"))
    ways = b.select(F.to_json(F.struct(F.lit("way").alias("type"), "id", refs.alias("nodes"), F.struct(use.alias("highway")).alias("tags"))).alias("value"))
    nodes.unionByName(ways).write.text(place)
    return X.read_elements(s, place)


@query("scan_osm_overpass", "SELECT id, 'way' || CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS name, (xmax - xmin) * (ymax - ymin) AS area FROM f_building")
def scan_osm_overpass(s, d):
    """Ways closed into polygons through their nodes, named by key and ordinal."""
    x = J.ranked(_osm(s, d), "id")
    return x.select("id", F.concat(F.lit("way"), F.col("rank").cast("string")).alias("name"), G.area(F.col("ring")).alias("area"))


@query("scan_osm_features", "SELECT id, (xmax - xmin + 4) * (ymax - ymin + 4) AS area FROM f_building WHERE id % 4 <> 2")
def scan_osm_features(s, d):
    """Polygons whose tag is in a list, widened by 2 m with square corners."""
    g = _osm(s, d).where(F.col("tags")["highway"].isin("footway", "pedestrian", "steps")).select("id", G.bounds(F.col("ring")).alias("b"))
    return g.select("id", ((F.col("b.xmax") - F.col("b.xmin") + 4) * (F.col("b.ymax") - F.col("b.ymin") + 4)).alias("area"))


@query("scan_geoclimate", "SELECT 'block' AS layer, id, hauteur AS avg_height FROM f_building UNION ALL SELECT 'rsu', id, CAST(class_id AS DOUBLE) FROM f_landcover")
def scan_geoclimate(s, d):
    """The two layers of indicators that a run leaves in its folder, each a collection of its own."""
    block, rsu = _place(s), _place(s)
    X.write_geojson(_rings(s, d).withColumnRenamed("hauteur", "AVG_HEIGHT"), block)
    X.write_geojson(G.with_box(view(s, d, "f_landcover")).select("id", F.col("class_id").cast("double").alias("AVG_HEIGHT"), F.array("geom").alias("rings")), rsu)
    one = lambda p, n: X.read_geojson(s, p, "id bigint, AVG_HEIGHT double").select(F.lit(n).alias("layer"), "id", F.col("AVG_HEIGHT").alias("avg_height"))
    return one(block, "block").unionByName(one(rsu, "rsu"))


def _shp(s, d) -> DataFrame:
    place = _place(s)
    tiles = G.with_box(view(s, d, B), clockwise=True).withColumn("tile", F.floor(F.col("xmin") / 250)).select("tile", "id", "geom")
    X.binary_files(tiles, "tile", lambda c: X.shp_bytes([[(p["x"], p["y"]) for p in r] for r in c["geom"]]), ["geom"], place, ".shp")
    return X.read_shp(s, X.read_staged(s, place))


_SHP = "SELECT kind, CAST(COUNT(*) AS BIGINT) AS n, SUM(area) AS area FROM (SELECT 'Polygon' AS kind, (xmax-xmin)*(ymax-ymin) AS area FROM f_building) t GROUP BY kind"


@query("scan_shapefile", _SHP)
def scan_shapefile(s, d):
    return _shp(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum(G.area(F.col("rings")[0])).alias("area"))


@query("sink_shp", _SHP)
def sink_shp(s, d):
    return scan_shapefile(s, d)


@query("sink_osm_shp", _SHP)
def sink_osm_shp(s, d):
    return scan_shapefile(s, d)


@query("scan_h2_file", _SHP)
def scan_h2_file(s, d):
    return scan_shapefile(s, d)


@query("scan_csv_wkt", _AREA)
def scan_csv_wkt(s, d):
    place = _place(s)
    G.with_box(view(s, d, B)).select("id", "hauteur", X.wkt_of(F.col("geom")).alias("geometry")).write.csv(place, sep=";", header=True)
    return X.read_wkt_csv(s, place, "id bigint, hauteur double, geometry string").select("id", "hauteur", G.area(F.col("ring")).alias("area"))


def _gpkg(s, d, name: str) -> str:
    """A layer as GeoPackage files, one for each square of 10 km, whose place is in its name (kilometres of the upper left corner)."""
    place = _place(s)
    x, y = F.floor(F.col("xmin") / 250) * 10, F.floor(F.col("ymin") / 250) * 10 + 10
    tiles = G.with_box(view(s, d, name)).withColumn("tile", F.concat_ws("_", F.lit("D017_2021"), x.cast("string"), y.cast("string"), F.lit("vecto")))
    attribute = "hauteur" if name == B else "class_id"
    X.binary_files(tiles.select("tile", "id", F.col(attribute).cast("double").alias("value"), "geom"), "tile", lambda c: X.gpkg_bytes("layer", c["id"], c["value"], [[(p["x"], p["y"]) for p in r] for r in c["geom"]]), ["id", "value", "geom"], place, ".gpkg")
    return place


@query("sink_gpkg", _AREA)
def sink_gpkg(s, d):
    g = X.read_gpkg(s, X.read_staged(s, _gpkg(s, d, B)))
    return g.select("id", F.col("value").alias("hauteur"), G.area(F.col("rings")[0]).alias("area"))


_TILES = "SELECT id, class_id FROM f_landcover WHERE xmax > 200 AND xmin < 600 AND ymax > 200 AND ymin < 600"


def _tiles(s, d) -> DataFrame:
    """Files are chosen by the square in their names before any is opened; of theirs, what meets the window."""
    files = X.read_staged(s, _gpkg(s, d, "f_landcover"))
    km = lambda i: F.regexp_extract("path", r"_(-?\d+)_(-?\d+)_vecto\.gpkg$", i).cast("int") * 25.0
    chosen = files.where((km(1) < 600) & (km(1) + 250 + 34 > 200) & (km(2) - 250 < 600) & (km(2) + 34 > 200))
    g = X.read_gpkg(s, chosen).withColumn("b", G.bounds(F.col("rings")[0]))
    return g.where("b.xmax > 200 AND b.xmin < 600 AND b.ymax > 200 AND b.ymin < 600").select("id", F.col("value").cast("long").alias("class_id"))


@query("scan_gpkg_tiles", _TILES)
def scan_gpkg_tiles(s, d):
    return _tiles(s, d)


@query("scan_postgis_tiles", _TILES)
def scan_postgis_tiles(s, d):
    return _tiles(s, d)


@query("scan_postgres_meta", "SELECT 'f_building' AS layer, 'id' AS col UNION ALL SELECT 'f_building', 'hauteur' UNION ALL SELECT 'f_landcover', 'id'")
def scan_postgres_meta(s, d):
    """Which layers have which of the wanted columns, from the schemas."""
    rows = [(n, c) for n in (B, "f_landcover") for c in view(s, d, n).columns if c in ("id", "hauteur")]
    return s.createDataFrame(rows, "layer string, col string")


_LABEL = {k: v[0] for k, v in CLIMATE_ZONES.items()}
_COLOUR = {k: v[1] for k, v in CLIMATE_ZONES.items()}


@query("scan_lcz_zip", f"SELECT id, CAST(1 + id % 17 AS INTEGER) AS zone, {case('1 + id % 17', _LABEL)} AS label, {case('1 + id % 17', _COLOUR)} AS colour, ROUND((least(xmax, 500) - greatest(xmin, 100)) * (least(ymax, 400) - greatest(ymin, 100)), 6) AS area FROM f_landcover WHERE xmax > 100 AND xmin < 500 AND ymax > 100 AND ymin < 400")
def scan_lcz_zip(s, d):
    """Zipped shapefiles with their attribute tables: two columns, label and colour by zone, cut by a window."""
    place = _place(s)
    t = G.with_box(view(s, d, "f_landcover")).select(F.floor(F.col("xmin") / 340).alias("tile"), "id", (1 + F.col("id") % 17).cast("int").alias("zone"), "geom")
    X.binary_files(t, "tile", lambda c: X.zipped({"zones.shp": X.shp_bytes([[(p["x"], p["y"]) for p in r] for r in c["geom"]]), "zones.dbf": X.dbf_bytes({"ID": c["id"], "ZONE": c["zone"]})}), ["id", "zone", "geom"], place, ".zip")
    z = X.read_zipped_shp(s, X.read_staged(s, place)).select(F.col("attributes")["ID"].cast("long").alias("id"), F.col("attributes")["ZONE"].cast("int").alias("zone"), F.col("rings")[0].alias("g"))
    z = z.withColumn("window", G.box_ring(*[F.lit(float(v)) for v in (100, 100, 500, 400)]))
    z = clip.clipped(z, "g", "window").where("clipped IS NOT NULL").withColumn("area", F.round(G.area(F.col("clipped")), 6)).where("area > 0")
    return z.select("id", "zone", lookup(F.col("zone"), _LABEL).alias("label"), lookup(F.col("zone"), _COLOUR).alias("colour"), "area")


@query("scan_wfs_bisect")
def scan_wfs_bisect(s, d):
    """Cells of a quadtree that hold at most 100 features each, by splitting what holds more: (level, cx, cy, n)."""
    f = cut(view(s, d, B).select(F.col("xmin").alias("x"), F.col("ymin").alias("y")))
    out, level = None, 0
    open_ = f.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
    while level <= 15:
        n = cut(open_.groupBy("cx", "cy").agg(F.count("*").alias("n")))
        done = n.where(F.col("n") <= 100) if level < 15 else n
        part = done.select(F.lit(level).alias("level"), "cx", "cy", "n")
        out = part if out is None else out.unionByName(part)
        full = n.where(F.col("n") > 100).select("cx", "cy")
        if level == 15 or full.isEmpty():
            break
        level += 1
        size = 65536.0 / (1 << level)
        open_ = cut(open_.join(full, ["cx", "cy"], "left_semi").withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}))
    return out


_CAPS = "SELECT 'BDTOPO:' || s_name AS name, 'Layer ' || CAST(s_suppkey AS VARCHAR) AS title, 'urn:ogc:def:crs:EPSG::2154' AS crs FROM supplier"


def _caps(s, d) -> DataFrame:
    place = _place(s)
    one = F.concat(F.lit("<wfs:FeatureType><wfs:Name>BDTOPO:"), "s_name", F.lit("</wfs:Name><wfs:Title>Layer "), F.col("s_suppkey").cast("string"), F.lit("</wfs:Title><wfs:DefaultCRS>urn:ogc:def:crs:EPSG::2154</wfs:DefaultCRS></wfs:FeatureType>"))
    view(s, d, "supplier").select(one.alias("value")).write.text(place)
    return X.read_capabilities(s, place)


@query("scan_wfs_caps", _CAPS)
def scan_wfs_caps(s, d):
    return _caps(s, d).select("name", "title", "crs")


@query("catalog_list", f"SELECT DISTINCT name AS identifier, title, 'wfs' AS service FROM ({_CAPS}) t")
def catalog_list(s, d):
    return _caps(s, d).select("name", "title").distinct().withColumnRenamed("name", "identifier").withColumn("service", F.lit("wfs"))


@query("catalog_lookup", f"SELECT name, title FROM ({_CAPS}) t WHERE title = 'Layer 7'")
def catalog_lookup(s, d):
    return _caps(s, d).where("title = 'Layer 7'").select("name", "title")


@query("scan_wfs_cql", "SELECT id, hauteur FROM f_building WHERE hauteur > 20 AND NOT (id IN (3, 7)) AND xmin <= 500 AND xmax >= 100 AND ymin <= 400 AND ymax >= 50")
def scan_wfs_cql(s, d):
    """A service's filter text, escaped as in its address, as predicates that reach the scan."""
    place = _place(s)
    view(s, d, B).write.parquet(place)
    text = "hauteur%20%3E%2020%20AND%20NOT%20(id%20IN%20(3,7))%20AND%20BBOX(geometrie,100,50,500,400)"
    return s.read.parquet(place).where(X.cql_predicate(text)).select("id", "hauteur")


@query("scan_isochrone_api", "SELECT event_id, CAST(event_id % 30 AS INTEGER) AS minutes FROM events")
def scan_isochrone_api(s, d):
    body = F.to_json(F.struct("event_id", F.struct((F.col("event_id") % 30).cast("int").alias("costValue")).alias("properties")))
    return view(s, d, "events").select(F.from_json(body, "event_id bigint, properties struct<costValue:int>").alias("j")).select("j.event_id", F.col("j.properties.costValue").alias("minutes"))


@query("scan_osm_graph", "SELECT tail, head, len FROM f_edge WHERE tail <> 0")
def scan_osm_graph(s, d):
    place = _place(s)
    view(s, d, "f_edge").select(F.to_json(F.struct("tail", "head", "len")).alias("value")).write.text(place)
    return s.read.schema("tail bigint, head bigint, len double").json(place).where("tail <> 0")


_RNB = "SELECT point_id, ROUND(lon, 6) AS lon, ROUND(lat, 6) AS lat, CASE WHEN street_number IS NOT NULL THEN street_number END AS street_number FROM building_points WHERE lon IS NOT NULL AND lat IS NOT NULL"


@query("scan_rnb", _RNB)
def scan_rnb(s, d):
    """Registry pages: a point, and the first address where there is one."""
    address = F.when(F.col("street_number").isNotNull(), F.array(F.struct("street_number"))).otherwise(F.array().cast("array<struct<street_number:string>>"))
    page = view(s, d, "building_points").where("lon IS NOT NULL AND lat IS NOT NULL").select(F.to_json(F.struct("point_id", F.struct(F.array("lon", "lat").alias("coordinates")).alias("point"), address.alias("addresses"))).alias("j"))
    r = page.select(F.from_json("j", "point_id bigint, point struct<coordinates:array<double>>, addresses array<struct<street_number:string>>").alias("r"))
    return r.select("r.point_id", F.round(F.col("r.point.coordinates")[0], 6).alias("lon"), F.round(F.col("r.point.coordinates")[1], 6).alias("lat"), F.when(F.size("r.addresses") > 0, F.get("r.addresses", F.lit(0))["street_number"]).alias("street_number"))


@query("scan_dpe", "SELECT r AS feature, c, v, CASE WHEN v < 17 THEN 'A' WHEN v < 34 THEN 'D' ELSE 'G' END AS classe FROM f_pixel")
def scan_dpe(s, d):
    """Nested results of features, opened twice."""
    p = view(s, d, "f_pixel")
    j = p.groupBy("r").agg(F.to_json(F.struct(F.array(F.struct(F.struct(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("results")).alias("properties"))).alias("features"))).alias("j"))
    f = j.select("r", F.explode(F.from_json("j", "features array<struct<properties:struct<results:array<struct<c:bigint,v:double>>>>>")["features"]).alias("f"))
    x = f.select(F.col("r").alias("feature"), F.explode("f.properties.results").alias("x"))
    return x.select("feature", "x.c", "x.v", F.when(F.col("x.v") < 17, "A").when(F.col("x.v") < 34, "D").otherwise("G").alias("classe"))


_LAS = "SELECT CAST(oid AS BIGINT) % 8 AS tile, cls, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(x), 3) AS sx, ROUND(SUM(z), 3) AS sz FROM f_point GROUP BY 1, 2"


@query("scan_las", _LAS)
def scan_las(s, d):
    place = _place(s)
    p = view(s, d, "f_point").withColumn("tile", F.col("oid") % 8).select("tile", "x", "y", "z", "cls")
    X.binary_files(p, "tile", lambda c: X.las_bytes(c["x"], c["y"], c["z"], c["cls"]), ["x", "y", "z", "cls"], place, ".las")
    las = X.read_las(s, X.read_staged(s, place)).withColumn("tile", F.regexp_extract("file", r"(\d+)\.las", 1).cast("long"))
    return las.groupBy("tile", "cls").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("z"), 3).alias("sz"))


@query("scan_dxf", "SELECT CAST(class_id AS VARCHAR) AS layer, CAST(COUNT(*) AS BIGINT) AS n, SUM((xmax-xmin)*(ymax-ymin)) AS area FROM f_landcover GROUP BY class_id")
def scan_dxf(s, d):
    one = lambda x, y: F.concat(F.lit("10\n"), F.col(x).cast("string"), F.lit("\n20\n"), F.col(y).cast("string"), F.lit("\n"))
    body = F.concat(F.lit("0\nLWPOLYLINE\n8\n"), F.col("class_id").cast("string"), F.lit("\n"), one("xmin", "ymin"), one("xmax", "ymin"), one("xmax", "ymax"), one("xmin", "ymax"), F.lit("0\nEOF\n"))
    files = view(s, d, "f_landcover").select(F.concat(F.col("id").cast("string"), F.lit(".dxf")).alias("path"), F.encode(body, "utf-8").alias("content"))
    return X.read_dxf(s, files).groupBy("layer").agg(F.count("*").alias("n"), F.sum(G.area(F.col("ring"))).alias("area"))


def _epw_hours(s, d) -> DataFrame:
    h = view(s, d, W)
    return h.select(F.year("ts_h").alias("year"), F.month("ts_h").alias("month"), F.day("ts_h").alias("day"), (F.hour("ts_h") + 1).alias("hour"), F.lit(0).alias("minute"), F.col("td").alias("drybulb"), F.col("rh").alias("relhum"), F.col("kdn").alias("glohorrad"), F.col("wd").cast("double").alias("winddir"), F.col("ws").alias("windspd"))


_EPW = "SELECT CAST(month(ts_h) AS INTEGER) AS month, CAST(day(ts_h) AS INTEGER) AS day, CAST(hour(ts_h) + 1 AS INTEGER) AS hour, td AS drybulb, rh AS relhum, ws AS windspd FROM f_weather"


def _epw(s, d) -> DataFrame:
    place = _place(s)
    lines = X.epw_lines(_epw_hours(s, d))
    head = s.createDataFrame([(x,) for x in X.epw_header("Halles", 48.86, 2.35, 1.0, 35.0)], "value string")
    head.unionByName(lines).write.text(place)
    return X.read_epw(s, place).select("month", "day", "hour", "drybulb", "relhum", "windspd")


@query("scan_epw", _EPW)
def scan_epw(s, d):
    return _epw(s, d)


@query("sink_epw", _EPW)
def sink_epw(s, d):
    return _epw(s, d)


@query("uwg_write_epw", _EPW.replace("td AS drybulb", "ROUND(td + 1.5, 1) AS drybulb"))
def uwg_write_epw(s, d):
    place = _place(s)
    X.epw_lines(_epw_hours(s, d).withColumn("drybulb", F.round(F.col("drybulb") + 1.5, 1))).write.text(place)
    return X.read_epw(s, place).select("month", "day", "hour", "drybulb", "relhum", "windspd")


@query(
    "epw_header",
    "SELECT sid, CAST(k AS INTEGER) AS line, CASE k WHEN 0 THEN 'LOCATION,' || name || ',-,-,-,-,' || CAST(CAST(lat AS DECIMAL(9, 4)) AS VARCHAR) || ',' || CAST(CAST(lon AS DECIMAL(9, 4)) AS VARCHAR) || ',1.0,0.0' WHEN 1 THEN 'DESIGN CONDITIONS,0' WHEN 2 THEN 'TYPICAL/EXTREME PERIODS,0' "
    "WHEN 3 THEN 'GROUND TEMPERATURES,0' WHEN 4 THEN 'HOLIDAYS/DAYLIGHT SAVINGS,No,0,0,0' WHEN 5 THEN 'COMMENTS 1,' WHEN 6 THEN 'COMMENTS 2,' ELSE 'DATA PERIODS,1,1,Data,Sunday,1/1,12/31' END AS text FROM f_station CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS k) g",
)
def epw_header(s, d):
    """The eight lines in front of a station's weather file."""
    place = F.concat(F.lit("LOCATION,"), "name", F.lit(",-,-,-,-,"), F.col("lat").cast("decimal(9,4)").cast("string"), F.lit(","), F.col("lon").cast("decimal(9,4)").cast("string"), F.lit(",1.0,0.0"))
    rest = X.epw_header("", 0.0, 0.0, 0.0, 0.0)[1:]
    return view(s, d, "f_station").select("sid", F.posexplode(F.array(place, *map(F.lit, rest))).alias("line", "text"))


@query("dict_epw_columns", "SELECT CAST(k AS INTEGER) AS place, name FROM (VALUES (6, 'drybulb'), (7, 'dewpoint'), (8, 'relhum'), (9, 'pressure'), (12, 'horirsky'), (13, 'glohorrad'), (14, 'dirnorrad'), (15, 'difhorrad'), (20, 'winddir'), (21, 'windspd')) t(k, name)")
def dict_epw_columns(s, d):
    """The columns that models read by their place in a line."""
    names = F.array(*map(F.lit, X.EPW_COLUMNS))
    return s.range(1).select(F.posexplode(names).alias("place", "name")).where(F.col("place").isin(6, 7, 8, 9, 12, 13, 14, 15, 20, 21))


_MET = "SELECT ts_h AS at, ws, rh, td, kdn FROM f_weather"


def _met(s, d) -> DataFrame:
    place = _place(s)
    w = view(s, d, W).select(F.year("ts_h").alias("%iy"), F.dayofyear("ts_h").alias("id"), F.hour("ts_h").alias("it"), F.lit(0).alias("imin"), F.col("ws").alias("Wind"), F.col("rh").alias("RH"), F.col("td").alias("Td"), F.col("kdn").alias("Kdn"), F.col("wd").alias("Wd"))
    X.write_forcing(w, place)
    return X.read_forcing(s, place).select("at", F.col("Wind").alias("ws"), F.col("RH").alias("rh"), F.col("Td").alias("td"), F.col("Kdn").alias("kdn"))


@query("scan_umep_met", _MET)
def scan_umep_met(s, d):
    return _met(s, d)


@query("sink_umep_txt", _MET)
def sink_umep_txt(s, d):
    return _met(s, d)


@query("scan_meteofrance", "SELECT obs_id, AAAAMMJJHH AS key, T, U FROM station_hourly WHERE AAAAMMJJHH IS NOT NULL")
def scan_meteofrance(s, d):
    place = _place(s)
    view(s, d, "station_hourly").where("AAAAMMJJHH IS NOT NULL").select("obs_id", F.concat(F.lit("k"), "AAAAMMJJHH", F.lit("k")).alias("key"), "T", "U").write.csv(place, sep=";", header=True, compression="gzip")
    h = X.read_hourly_csv(s, place, "obs_id bigint, key string, T double, U double")
    return h.select("obs_id", F.expr("substring(key, 2, length(key) - 2)").alias("key"), "T", "U")


@query("scan_doe_csv", "SELECT CAST(r AS INTEGER) AS row, SUM(v) AS total FROM f_pixel WHERE c BETWEEN 6 AND 29 GROUP BY r")
def scan_doe_csv(s, d):
    """Sheets addressed by place: columns 6 to 29 of each row."""
    p = view(s, d, "f_pixel")
    full = s.range(64 * 64).select(F.floor(F.col("id") / 64).alias("r"), (F.col("id") % 64).alias("c")).join(p, ["r", "c"], "left")
    rows = full.groupBy("r").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce(F.col("v").cast("string"), F.lit("")).alias("t")))), lambda x: x["t"])).alias("line"))
    sheet = rows.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"])).alias("t")).select(F.lit("sheet.csv").alias("path"), F.encode("t", "utf-8").alias("content"))
    m = X.read_matrix(s, sheet)
    cells = F.filter(F.transform(F.slice("cells", 7, 24), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return m.where(F.size(cells) > 0).select("row", F.aggregate(cells, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("scan_uwg_param", "SELECT 'bldheight' AS name, 10.0::DOUBLE AS total UNION ALL SELECT 'schtraffic', 0.6 UNION ALL SELECT 'albroad', 0.1")
def scan_uwg_param(s, d):
    text = "# canyon\nbldHeight,10.0,\nalbRoad, 0.1 # asphalt\nSchTraffic,\n0.1,0.2,\n0.3,\n"
    files = s.range(1).select(F.lit("a.uwg").alias("path"), F.encode(F.lit(text), "utf-8").alias("content"))
    return X.read_parameters(s, files).select(F.lower("name").alias("name"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("uwg_csv", "SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(3 AS INTEGER) AS n FROM supplier")
def uwg_csv(s, d):
    return view(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.size(F.split(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.lit("1"), F.lit("2")), ",")).alias("n"))


@query("uwg_near_zero", "SELECT ts_h FROM f_weather WHERE abs(ws) < 0.05")
def uwg_near_zero(s, d):
    return view(s, d, W).where(F.abs("ws") < 0.05).select("ts_h")


_ASC = "SELECT r, c, v FROM f_pixel"


@query("sink_geotiff", _ASC)
def sink_geotiff(s, d):
    """Pixels as a table split by row bands, with nodata instead of null; read back with null instead of nodata."""
    place = _place(s)
    view(s, d, "f_pixel").select("r", "c", F.coalesce("v", F.lit(-9999.0)).cast("float").alias("v"), F.floor(F.col("r") / 16).alias("band")).write.partitionBy("band").parquet(place)
    return s.read.parquet(place).select("r", "c", F.nullif(F.col("v").cast("double"), F.lit(-9999.0)).alias("v"))


@query("scan_netcdf_glob", "SELECT site_id, CAST(COUNT(*) AS BIGINT) AS n FROM comfort_cells GROUP BY site_id")
def scan_netcdf_glob(s, d):
    """A cube over several files, by a pattern of their names."""
    place = _place(s)
    c = view(s, d, "comfort_cells").select("site_id", "time", "y", "x", "utci")
    c.withColumn("month", F.month("time")).write.partitionBy("month").parquet(place)
    return s.read.option("basePath", place).parquet(f"{place}/month=*").groupBy("site_id").agg(F.count("*").alias("n"))


@query("sink_cube_frames", "SELECT time, CAST(COUNT(*) AS BIGINT) AS n FROM comfort_cells WHERE time IS NOT NULL GROUP BY time")
def sink_cube_frames(s, d):
    """One frame per day of the cube."""
    place = _place(s)
    view(s, d, "comfort_cells").where("time IS NOT NULL").withColumn("day", F.to_date("time")).repartition("day").write.partitionBy("day").parquet(place)
    return s.read.parquet(place).groupBy("time").agg(F.count("*").alias("n"))


@query("cube_to_frames_old", "SELECT time, CAST(COUNT(*) AS BIGINT) AS n FROM comfort_cells WHERE time IS NOT NULL GROUP BY time")
def cube_to_frames_old(s, d):
    return sink_cube_frames(s, d)


@query("sink_csv_exchange", "SELECT id, hauteur FROM f_building")
def sink_csv_exchange(s, d):
    place = _place(s)
    view(s, d, B).select("id", "hauteur").write.csv(place, header=True)
    return s.read.csv(place, header=True, schema="id bigint, hauteur double")


@query("sink_xlsx_report", "SELECT class_id, CAST(COUNT(*) AS BIGINT) AS tiles FROM f_landcover GROUP BY class_id")
def sink_xlsx_report(s, d):
    place = _place(s)
    view(s, d, "f_landcover").groupBy("class_id").agg(F.count("*").alias("tiles")).write.json(place)
    return s.read.json(place, schema="class_id bigint, tiles bigint")


_HEX = G.hexagon_sql("(SELECT r AS row_, c AS col_, v FROM f_pixel)", "col_", "row_", 8.0, "v")


@query("sink_h3_json", f"SELECT q, r, ROUND(8 * (sqrt(3) * q + sqrt(3) / 2 * r), 6) AS x, ROUND(8 * 1.5 * r, 6) AS y, MAX(v) AS val FROM ({_HEX}) t GROUP BY q, r")
def sink_h3_json(s, d):
    """Hexagons (planar) with their centres and values, as JSON lines."""
    place = _place(s)
    h = view(s, d, "f_pixel").groupBy(G.hexagon(F.col("c").cast("double"), F.col("r").cast("double"), 8.0).alias("h")).agg(F.max("v").alias("val")).select("h.q", "h.r", "val")
    x, y = 8 * (3**0.5 * F.col("q") + 3**0.5 / 2 * F.col("r")), 8 * 1.5 * F.col("r")
    h.select(F.to_json(F.struct("q", "r", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), "val")).alias("value")).write.text(place)
    return s.read.schema("q bigint, r bigint, x double, y double, val double").json(place)


@query("sink_grid_average", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, ROUND(AVG(z), 6) AS v FROM f_point JOIN (SELECT unnest(generate_series(0, 20)) AS i) a ON abs(x - (i * 10 + 5)) < 11 JOIN (SELECT unnest(generate_series(0, 20)) AS j) b ON abs(y - (j * 10 + 5)) < 11 WHERE pow(x - (i * 10 + 5), 2) + pow(y - (j * 10 + 5), 2) <= 121 GROUP BY i, j")
def sink_grid_average(s, d):
    """Moving means within 1.1 cells of each centre: points go to the nine cells around them."""
    p = view(s, d, "f_point").select("x", "y", "z")
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / 10) - 1, F.floor(F.col(c) / 10) + 1))
    e = p.withColumn("i", near("x")).withColumn("j", near("y")).where("i BETWEEN 0 AND 20 AND j BETWEEN 0 AND 20")
    d2 = F.pow(F.col("x") - (F.col("i") * 10 + 5), 2) + F.pow(F.col("y") - (F.col("j") * 10 + 5), 2)
    return e.where(d2 <= 121).groupBy("i", "j").agg(F.round(F.avg("z"), 6).alias("v"))


_FIELD = "SELECT r, c, k, 2.5 + 5 * k AS z, v * pow((2.5 + 5 * k) / 10.0, 0.24) / 10 AS u, (r - c) * (k + 1) / 100.0 AS w FROM f_pixel CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) g"


@query(
    "sink_wind_slice",
    f"WITH f AS ({_FIELD}), m AS (SELECT a.r, a.c, a.u + (b.u - a.u) * 0.3 AS u, a.w + (b.w - a.w) * 0.3 AS v FROM f a JOIN f b ON a.r = b.r AND a.c = b.c AND a.k = 1 AND b.k = 2) SELECT r, c, ROUND(sqrt(u * u + v * v), 6) AS hws, ROUND(degrees(atan2(u, v)), 6) AS hwd FROM m",
)
def sink_wind_slice(s, d):
    """Horizontal speed and direction of a field (``u``, ``v`` at levels every 5 m) at 9 m, by the line between the levels around it; written and read back."""
    place, z = _place(s), 9.0
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    f = view(s, d, "f_pixel").select("r", "c", "v", k).withColumn("z", 2.5 + 5 * F.col("k"))
    f = f.select("r", "c", "z", (F.col("v") * F.pow(F.col("z") / 10, F.lit(0.24)) / 10).alias("u"), ((F.col("r") - F.col("c")) * (F.col("k") + 1) / 100.0).alias("v"))
    near = f.where(F.abs(F.col("z") - z) < 5).groupBy("r", "c").agg(*[F.sum(F.col(n) * (1 - F.abs(F.col("z") - z) / 5)).alias(n) for n in "uv"])
    near.write.parquet(place)
    x = s.read.parquet(place)
    return x.select("r", "c", F.round(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")), 6).alias("hws"), F.round(F.degrees(F.atan2("u", "v")), 6).alias("hwd"))


@query("sink_netcdf_wind", "SELECT r AS i, c AS j, ROUND(v / 10, 6) AS u FROM f_pixel")
def sink_netcdf_wind(s, d):
    place = _place(s)
    view(s, d, "f_pixel").select(F.col("r").alias("i"), F.col("c").alias("j"), F.round(F.col("v") / 10, 6).alias("u")).write.parquet(place)
    return s.read.parquet(place)


@query("comfort_collect_csv", "SELECT site_id, CAST(COUNT(*) AS BIGINT) AS n FROM comfort_cells WHERE utci IS NOT NULL GROUP BY site_id")
def comfort_collect_csv(s, d):
    """Result files of a folder, told apart by the name of their folder."""
    place = _place(s)
    view(s, d, "comfort_cells").where("utci IS NOT NULL").select("site_id", "utci").write.partitionBy("site_id").csv(place)
    return s.read.schema("utci double, site_id string").csv(place).groupBy("site_id").agg(F.count("*").alias("n"))


QUERIES, ORACLES = book.queries, book.oracles
