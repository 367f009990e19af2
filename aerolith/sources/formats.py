"""Readers and writers of the domain's file formats. Text formats are plain Spark sources; binary ones are parsed per file in Arrow batches."""

from __future__ import annotations

import io
import math
import re
import sqlite3
import struct
import urllib.parse
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"

# The columns of a weather file (35 fields), and of the forcing text (24).
EPW_COLUMNS = (
    "year month day hour minute flags drybulb dewpoint relhum pressure exthorrad extdirrad horirsky glohorrad dirnorrad difhorrad glohorillum dirnorillum difhorillum zenlum winddir windspd totskycvr "
    "opaqskycvr visibility ceiling presweathobs presweathcodes precip_wtr aerosol snowdepth days_last_snow albedo liq_precip_depth liq_precip_rate"
).split()
FORCING_COLUMNS = "%iy id it imin Q* QH QE Qs Qf Wind RH Td press rain Kdn snow ldown fcld wuh xsmd lai_hr Kdiff Kdir Wd".split()
EPW_INTS = {"year", "month", "day", "hour", "minute"}


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections: the ``properties`` (a schema) as columns, ``kind`` and ``rings`` of polygons. Several files at once merge."""
    shape = f"struct<type:string, features:array<struct<properties:struct<{properties}>, geometry:struct<type:string, coordinates:string>>>>"
    text = spark.read.text(path, wholetext=True)
    f = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    nested = F.from_json(F.col("f.geometry.coordinates"), "array<array<array<double>>>")
    rings = F.transform(nested, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.when(F.col("f.geometry.type") == "Polygon", rings).alias("rings"))


def write_geojson(df: DataFrame, path: str, rings: str = "rings") -> None:
    """One collection a partition: features as text lines between a head and a tail, in one pass. Lines and timestamps are left out, as the format's readers want."""
    times = [f.name for f in df.schema if f.dataType.typeName().startswith(("timestamp", "date"))]
    plain = [c for c in df.columns if c not in (rings, *times)]
    coordinates = F.to_json(F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*plain)), F.lit(',"geometry":{"type":"Polygon","coordinates":'), coordinates, F.lit("}}"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            for v in b.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [('{"type":"FeatureCollection","features":[' if first else ",") + v]})
                first = False
        if not first:
            yield pa.RecordBatch.from_pydict({"value": ["]}"]})

    df.select(feature.alias("value")).where("value IS NOT NULL").mapInArrow(collect, "value string").write.text(path)


def read_wkt_csv(spark: SparkSession, path: str, schema: str, wkt: str = "geometry") -> DataFrame:
    """``;``-separated text with a WKT column, whose first polygon ring comes out as ``ring``."""
    df = spark.read.csv(path, sep=";", header=True, schema=schema)
    pairs = F.expr(rf"regexp_extract_all(regexp_extract({wkt}, '\\(([^()]+)\\)', 1), '(-?[0-9.eE+-]+) (-?[0-9.eE+-]+)', 0)")
    ring = F.transform(pairs, lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    return df.withColumn("ring", ring)


def wkt_of(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", "), F.lit("))"))


def read_epw(spark: SparkSession, path: str) -> DataFrame:
    """Hours of weather files. The eight header lines are told by their number of fields, so files split as they like."""
    t = spark.read.text(path).select(F.split("value", ",").alias("v")).where(F.size("v") >= len(EPW_COLUMNS))
    one = lambda i, n: (F.col("v")[i] if n == "flags" else F.trim(F.col("v")[i]).try_cast("int" if n in EPW_INTS else "double")).alias(n)
    return t.select(*[one(i, n) for i, n in enumerate(EPW_COLUMNS)]).where("year IS NOT NULL AND month BETWEEN 1 AND 12")


def epw_lines(df: DataFrame) -> DataFrame:
    """Hours as lines; columns that are missing take the format's code for none."""
    none = {"flags": "?9", "presweathobs": "9", "presweathcodes": "999999999"}
    cell = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(none.get(n, "9999"))) if n in df.columns else F.lit(none.get(n, "9999"))
    return df.select(F.concat_ws(",", *[cell(n) for n in EPW_COLUMNS]).alias("value"))


def epw_header(name: str, lat: float, lon: float, zone: float, elevation: float) -> list[str]:
    return [
        f"LOCATION,{name},-,-,-,-,{lat},{lon},{zone},{elevation}", "DESIGN CONDITIONS,0", "TYPICAL/EXTREME PERIODS,0", "GROUND TEMPERATURES,0", "HOLIDAYS/DAYLIGHT SAVINGS,No,0,0,0",
        "COMMENTS 1,", "COMMENTS 2,", "DATA PERIODS,1,1,Data,Sunday,1/1,12/31",
    ]


def read_forcing(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated forcing text; -999 is none; ``at`` from year, day of year, hour and minute."""
    t = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("v")).where((F.size("v") >= len(FORCING_COLUMNS)) & F.col("v")[0].rlike("^[0-9]+$"))
    cols = [F.nullif(F.col("v")[i].try_cast("double"), F.lit(-999.0)).alias(n) for i, n in enumerate(FORCING_COLUMNS)]
    df = t.select(*cols)
    return df.withColumn("at", F.expr("timestampadd(MINUTE, CAST((id - 1) * 1440 + it * 60 + COALESCE(imin, 0) AS INT), make_timestamp_ntz(CAST(`%iy` AS INT), 1, 1, 0, 0, 0))"))


def write_forcing(df: DataFrame, path: str) -> None:
    cell = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("-999")) if n in df.columns else F.lit("-999")
    df.select(F.concat_ws(" ", *[cell(n) for n in FORCING_COLUMNS]).alias("value")).write.text(path)


def read_hourly_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``;``-separated hourly readings, plain or gzipped."""
    return spark.read.csv(path, sep=";", header=True, schema=schema)


def read_asc(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Pixels (file, r, c, v) of ASCII grids; the nodata value is null. A file is one task: its lines have no meaning alone."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                head, nodata, r = {}, None, 0
                for line in io.TextIOWrapper(io.BytesIO(body), "utf-8"):
                    p = line.split()
                    if len(p) == 2 and re.match(r"[A-Za-z]", p[0]):
                        head[p[0].lower()] = float(p[1])
                        nodata = head.get("nodata_value")
                    elif p:
                        v = [None if float(x) == nodata else float(x) for x in p]
                        yield pa.RecordBatch.from_pydict({"file": pa.array([name.rsplit("/", 1)[-1]] * len(v)), "r": pa.array([r] * len(v), pa.int64()), "c": pa.array(range(len(v)), pa.int64()), "v": pa.array(v, pa.float64())})
                        r += 1

    return _files(spark, path).mapInArrow(kernel, "file string, r bigint, c bigint, v double")


def las_bytes(x: list[float], y: list[float], z: list[float], cls: list[int], scale: float = 0.001) -> bytes:
    """An uncompressed LAS 1.2 file, point format 0."""
    low, high = [min(v, default=0.0) for v in (x, y, z)], [max(v, default=0.0) for v in (x, y, z)]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"\0" * 8, 1, 2, b"aerolith", b"aerolith", 1, 2024, 227, 227, 0, 0, 20, len(x), len(x), 0, 0, 0, 0)
    head += struct.pack("<3d3d6d", scale, scale, scale, 0.0, 0.0, 0.0, high[0], low[0], high[1], low[1], high[2], low[2])
    return head + b"".join(struct.pack("<iiiHBBbBH", round(a / scale), round(b / scale), round(c / scale), 0, 0, k, 0, 0, 0) for a, b, c, k in zip(x, y, z, cls, strict=True))


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, content) of files, or of a frame that has them already."""
    return path.select("path", "content") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select("path", "content")


def read_las(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Points (file, x, y, z, intensity, cls) of uncompressed LAS files; files that are none are skipped."""
    import numpy as np

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if body[:4] != b"LASF":
                    continue
                start, fmt, width, n = *struct.unpack_from("<I", body, 96), body[104] & 63, *struct.unpack_from("<HI", body, 105)
                sx, sy, sz, ox, oy, oz = struct.unpack_from("<6d", body, 131)
                raw = np.frombuffer(body, np.uint8, n * width, start).reshape(n, width)
                xyz = raw[:, :12].copy().view("<i4")
                cls = raw[:, 15] & 31 if fmt < 6 else raw[:, 16]
                out = {"file": pa.array([name.rsplit("/", 1)[-1]] * n), "x": xyz[:, 0] * sx + ox, "y": xyz[:, 1] * sy + oy, "z": xyz[:, 2] * sz + oz, "intensity": raw[:, 12:14].copy().view("<u2")[:, 0].astype(np.int32), "cls": cls.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(out)

    return _files(spark, path).mapInArrow(kernel, "file string, x double, y double, z double, intensity int, cls int")


def shp_bytes(rings: list[list[tuple[float, float]]]) -> bytes:
    """A shapefile of polygons, one ring each."""
    body = b""
    for k, r in enumerate(rings):
        xs, ys = [p[0] for p in r], [p[1] for p in r]
        rec = struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), 1, len(r)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in r)
        body += struct.pack(">ii", k + 1, len(rec) // 2) + rec
    xs, ys = [p[0] for r in rings for p in r] or [0.0], [p[1] for r in rings for p in r] or [0.0]
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0) + body


def read_shp(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, n, kind, rings) of the main files of shapefiles: points, lines and polygons by their parts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                at, ns, kinds, rings = 100, [], [], []
                while at + 12 <= len(body):
                    n, size = struct.unpack_from(">ii", body, at)
                    kind = struct.unpack_from("<i", body, at + 8)[0]
                    base = kind % 10
                    parts: list[list[tuple[float, float]]] = []
                    if base == 1:
                        parts = [[struct.unpack_from("<2d", body, at + 12)]]
                    elif base in (3, 5):
                        count, total = struct.unpack_from("<2i", body, at + 44)
                        first = [*struct.unpack_from(f"<{count}i", body, at + 52), total]
                        xy = struct.unpack_from(f"<{2 * total}d", body, at + 52 + 4 * count)
                        pts = list(zip(xy[::2], xy[1::2], strict=True))
                        parts = [pts[a:z] for a, z in zip(first[:-1], first[1:], strict=True)]
                    ns.append(n)
                    kinds.append({1: "Point", 3: "LineString", 5: "Polygon"}.get(base, "Null"))
                    rings.append([[{"x": x, "y": y} for x, y in p] for p in parts])
                    at += 8 + 2 * size
                yield pa.RecordBatch.from_pydict({"file": pa.array([name.rsplit("/", 1)[-1]] * len(ns)), "n": pa.array(ns, pa.int32()), "kind": pa.array(kinds), "rings": pa.array(rings, pa.list_(pa.list_(point)))})

    return _files(spark, path).mapInArrow(kernel, f"file string, n int, kind string, rings {RINGS}")


def dbf_bytes(columns: dict[str, list]) -> bytes:
    """An attribute table of whole numbers (18 places)."""
    names, n = list(columns), len(next(iter(columns.values())))
    fields = b"".join(struct.pack("<11sc4xBB14x", c.encode()[:10], b"N", 18, 0) for c in names)
    rows = b"".join(b" " + b"".join(f"{columns[c][i]:>18}".encode() for c in names) for i in range(n))
    return struct.pack("<B3xIHH20x", 3, n, 33 + 32 * len(names), 1 + 18 * len(names)) + fields + b"\r" + rows + b"\x1a"


def dbf_rows(body: bytes) -> list[dict[str, str]]:
    """Rows of an attribute table as text by field; deleted ones are left out."""
    n, head, size = struct.unpack_from("<IHH", body, 4)
    fields, at, place = [], 32, 1
    while body[at : at + 1] not in (b"\r", b""):
        fields.append((body[at : at + 11].split(b"\0")[0].decode("latin-1"), place, body[at + 16]))
        place += body[at + 16]
        at += 32
    rows = [body[head + i * size : head + (i + 1) * size] for i in range(n)]
    return [{c: r[a : a + w].decode("latin-1").strip() for c, a, w in fields} for r in rows if r[:1] != b"*"]


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def _shp_polygons(body: bytes) -> list[list[list[dict[str, float]]]]:
    at, out = 100, []
    while at + 12 <= len(body):
        size, kind = struct.unpack_from(">i", body, at + 4)[0], struct.unpack_from("<i", body, at + 8)[0]
        rings = []
        if kind % 10 == 5:
            count, total = struct.unpack_from("<2i", body, at + 44)
            first = [*struct.unpack_from(f"<{count}i", body, at + 52), total]
            xy = struct.unpack_from(f"<{2 * total}d", body, at + 52 + 4 * count)
            rings = [[{"x": xy[2 * k], "y": xy[2 * k + 1]} for k in range(a, z)] for a, z in zip(first[:-1], first[1:], strict=True)]
        out.append(rings)
        at += 8 + 2 * size
    return out


def read_zipped_shp(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, attributes, rings) of polygons of shapefiles in zip archives, with their attribute tables."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    for shp in (n for n in z.namelist() if n.lower().endswith(".shp")):
                        shapes, rows = _shp_polygons(z.read(shp)), dbf_rows(z.read(shp[:-3] + "dbf"))
                        columns = {"file": pa.array([name.rsplit("/", 1)[-1]] * len(shapes)), "attributes": pa.array([list(r.items()) for r in rows], pa.map_(pa.string(), pa.string())), "rings": pa.array(shapes, pa.list_(pa.list_(point)))}
                        yield pa.RecordBatch.from_pydict(columns)

    return _files(spark, path).mapInArrow(kernel, f"file string, attributes map<string,string>, rings {RINGS}")


def gpkg_bytes(layer: str, ids: list[int], values: list[float | None], rings: list[list[tuple[float, float]]], srid: int = 2154) -> bytes:
    """A GeoPackage with one layer of polygons (``fid``, ``value``, ``geom``)."""
    db = sqlite3.connect(":memory:")
    db.executescript(
        "PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);"
        f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, value DOUBLE, geom BLOB);'
    )
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", (layer, layer, min(xs), min(ys), max(xs), max(ys), srid))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
    blob = lambda r: struct.pack("<2sBBi", b"GP", 0, 1, srid) + struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    db.executemany(f'INSERT INTO "{layer}" VALUES (?, ?, ?)', [(i, v, blob(r)) for i, v, r in zip(ids, values, rings, strict=True)])
    db.commit()
    return db.serialize()


def _gpkg_polygon(blob: bytes) -> list[list[dict[str, float]]]:
    """Rings of the first polygon of a GeoPackage geometry; other kinds give none."""
    envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
    at = 8 + envelope
    end = "<" if blob[at] else ">"
    kind = struct.unpack_from(end + "I", blob, at + 1)[0]
    if kind % 1000 == 6:  # of several parts the first
        at += 9
        kind = struct.unpack_from(end + "I", blob, at + 1)[0]
    if kind % 1000 != 3:
        return []
    wide = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
    n, at, out = struct.unpack_from(end + "I", blob, at + 5)[0], at + 9, []
    for _ in range(n):
        m = struct.unpack_from(end + "I", blob, at)[0]
        v = struct.unpack_from(f"{end}{m * wide}d", blob, at + 4)
        out.append([{"x": v[k * wide], "y": v[k * wide + 1]} for k in range(m)])
        at += 4 + 8 * m * wide
    return out


def read_gpkg(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, layer, id, value, rings) of the polygon layers of GeoPackages; ``value`` is the first numeric attribute."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(body)
                for layer, geom in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
                    info = db.execute(f'PRAGMA table_info("{layer}")').fetchall()
                    key = next(c[1] for c in info if c[5])
                    value = next((f'"{c[1]}"' for c in info if not c[5] and c[1] != geom and any(k in c[2].upper() for k in ("DOUBLE", "REAL", "FLOAT", "INT"))), "NULL")
                    rows = db.execute(f'SELECT "{key}", {value}, "{geom}" FROM "{layer}" WHERE "{geom}" IS NOT NULL').fetchall()
                    n = len(rows)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": pa.array([name.rsplit("/", 1)[-1]] * n, pa.string()),
                            "layer": pa.array([layer] * n, pa.string()),
                            "id": pa.array([r[0] for r in rows], pa.int64()),
                            "value": pa.array([r[1] for r in rows], pa.float64()),
                            "rings": pa.array([_gpkg_polygon(r[2]) for r in rows], pa.list_(pa.list_(point))),
                        }
                    )
                db.close()

    return _files(spark, path).mapInArrow(kernel, f"file string, layer string, id bigint, value double, rings {RINGS}")


def read_dxf(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, layer, ring) of the closed polylines of DXF text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                lines = body.decode("utf-8", "replace").splitlines()
                layers, rings, layer, pts, inside = [], [], None, [], False
                for code, value in zip(lines[::2], lines[1::2], strict=False):
                    code, value = code.strip(), value.strip()
                    if code == "0":
                        if inside and len(pts) >= 3:
                            layers.append(layer)
                            rings.append([{"x": p[0], "y": p[1]} for p in [*pts, pts[0]]])
                        inside, pts, layer = value == "LWPOLYLINE", [], None
                    elif inside and code == "8":
                        layer = value
                    elif inside and code == "10":
                        pts.append([float(value), math.nan])
                    elif inside and code == "20":
                        pts[-1][1] = float(value)
                yield pa.RecordBatch.from_pydict({"file": pa.array([name.rsplit("/", 1)[-1]] * len(layers), pa.string()), "layer": pa.array(layers, pa.string()), "ring": pa.array(rings, pa.list_(point))})

    return _files(spark, path).mapInArrow(kernel, f"file string, layer string, ring array<{POINT}>")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(id, tags, ring) of the closed ways of a map's elements, one element a line: ways are joined with their nodes, in order. A way with a missing node is left out."""
    e = spark.read.schema("type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>").json(path)
    nodes = e.where("type = 'node'").select(F.col("id").alias("node"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    ways = e.where("type = 'way' and size(nodes) >= 4 and nodes[0] = element_at(nodes, -1)")
    at = ways.select("id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("k", "node")).join(nodes, "node")
    rings = at.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("r")).where("size(r) = n").select("id", F.transform("r", lambda v: v["p"]).alias("ring"))
    return ways.select("id", "tags").join(rings, "id")


def cql_predicate(text: str) -> Column:
    """A service's filter (comparisons, AND, OR, NOT, IN, LIKE, IS NULL, and BBOX of a layer with xmin .. ymax), which may be escaped for an address."""
    number = r"\s*([-+0-9.eE]+)\s*"
    plain = urllib.parse.unquote(text)
    plain = re.sub(rf"(?i)\bBBOX\s*\(\s*\w+\s*,{number},{number},{number},{number}(?:,[^)]*)?\)", r"(xmin <= \3 AND xmax >= \1 AND ymin <= \4 AND ymax >= \2)", plain)
    return F.expr(plain)


def read_capabilities(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, crs, abstract) of the feature types of capabilities documents, namespaces stripped, wholly empty rows left out."""
    text = spark.read.text(path, wholetext=True)
    bare = F.regexp_replace("value", r"<(/?)[A-Za-z0-9]+:", "<$1")
    types = F.expr(r"regexp_extract_all(v, '(?s)<FeatureType>(.*?)</FeatureType>', 1)")
    t = text.select(bare.alias("v")).select(F.explode(types).alias("t"))
    tag = lambda n: F.nullif(F.regexp_extract("t", rf"(?s)<{n}>(.*?)</{n}>", 1), F.lit("")).alias(n.lower())
    return t.select(tag("Name"), tag("Title"), tag("DefaultCRS"), tag("Abstract")).withColumnRenamed("defaultcrs", "crs").na.drop(how="all")


def read_matrix(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, row, cells) of comma-separated sheets whose cells are addressed by place."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import csv

        for b in batches:
            for name, body in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(csv.reader(io.StringIO(body.decode("utf-8", "replace"))))
                yield pa.RecordBatch.from_pydict({"file": pa.array([name.rsplit("/", 1)[-1]] * len(rows)), "row": pa.array(range(len(rows)), pa.int32()), "cells": pa.array(rows, pa.list_(pa.string()))})

    return _files(spark, path).mapInArrow(kernel, "file string, row int, cells array<string>")


def read_parameters(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(name, values) of key/value text: ``#`` begins a comment; lines without a name continue the block above."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column("content").to_pylist():
                names: list[str] = []
                values: list[list[float]] = []
                for line in body.decode("utf-8", "replace").splitlines():
                    cells = [c.strip() for c in line.split("#")[0].split(",") if c.strip()]
                    if not cells:
                        continue
                    if re.match(r"[A-Za-z]", cells[0]):
                        names.append(cells.pop(0))
                        values.append([])
                    values[-1] += [float(c) for c in cells if re.fullmatch(r"[-+]?[0-9.]+(?:[eE][-+]?\d+)?", c)]
                yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "values": pa.array(values, pa.list_(pa.float64()))})

    return _files(spark, path).select("content").mapInArrow(kernel, "name string, values array<double>")


def binary_files(df: DataFrame, key: str, encode: Callable[[dict[str, list]], bytes], columns: list[str], path: str, suffix: str) -> None:
    """One binary file per value of ``key`` (a tile: its rows must fit a task), written by the tasks through Hadoop-style staging of a binary column."""

    def kernel(t: pa.Table) -> pa.Table:
        return pa.table({"name": pa.array([f"{t.column(key)[0].as_py()}{suffix}"]), "body": pa.array([encode({c: t.column(c).to_pylist() for c in columns})], pa.binary())})

    df.select(key, *columns).groupBy(key).applyInArrow(kernel, "name string, body binary").write.parquet(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Files staged by ``binary_files`` in the shape of the ``binaryFile`` source: (path, content)."""
    return spark.read.parquet(path).select(F.col("name").alias("path"), F.col("body").alias("content"))


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The reader that a file's extension asks for."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "json"):
        return read_geojson(spark, path, schema or "id bigint")
    if kind == "csv":
        return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None)
    readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {"shp": read_shp, "zip": read_zipped_shp, "gpkg": read_gpkg, "las": read_las, "asc": read_asc, "dxf": read_dxf, "epw": read_epw, "txt": read_forcing}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path)
