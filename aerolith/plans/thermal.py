"""Canyon model, comfort cube and the remaining operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import comfort as C
from ..functions.timekeys import minutes_of_key
from ..functions.utci import utci
from ..functions.wind import power_profile
from ..operators import canyon as K
from .base import Book, view

book = Book()
query = book.query
_WLH = "(SELECT id, xmax - xmin AS w, ymax - ymin AS l, hauteur AS h FROM f_building WHERE hauteur IS NOT NULL) t"


def r6(c, name):
    return F.round(c, 6).alias(name)


def _blocks(s, d) -> DataFrame:
    return view(s, d, "f_building").where("hauteur IS NOT NULL").select("id", (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("l"), F.col("hauteur").alias("h"))


def _forcing(s: SparkSession, d: str) -> DataFrame:
    """Hourly forcing of every station, from its readings: one row per hour, physical values only."""
    h = view(s, d, "station_hourly").select("station_id", "T", "FF", "GLO", "TD", F.floor(minutes_of_key(F.col("AAAAMMJJHH")) / 60).alias("hour")).where("hour IS NOT NULL")
    t, v = F.when(F.col("T").between(-40, 50), F.col("T")), F.when(F.col("FF").between(0, 60), F.col("FF"))
    sun = F.when(F.col("GLO").between(0, 400), F.col("GLO") * (1e4 / 3600))
    g = h.groupBy("station_id", "hour").agg(F.avg(t).alias("t"), F.avg(v).alias("wind"), F.avg(sun).alias("sun"))
    return g.withColumn("sky", 0.85 * 5.67e-8 * F.pow(F.coalesce("t", F.lit(10.0)) + 273.15, 4))


def _simulated(s, d) -> DataFrame:
    return K.run_sites(_forcing(s, d), "station_id")


@query("uwg_simulate")
def uwg_simulate(s, d):
    """Each station's weather inside a standard district: hours and means."""
    return _simulated(s, d).groupBy("station_id").agg(F.count("*").alias("hours"), F.round(F.avg("rural"), 3).alias("rural"), F.round(F.avg("canyon"), 3).alias("canyon"), F.round(F.avg("ubl"), 3).alias("ubl"))


@query("ucm_step")
def ucm_step(s, d):
    return _simulated(s, d).select("station_id", "hour", F.round("canyon", 4).alias("canyon"))


@query("ubl_step")
def ubl_step(s, d):
    return _simulated(s, d).select("station_id", "hour", F.round("ubl", 4).alias("ubl"))


@query("urban_flux")
def urban_flux(s, d):
    """Convective flux from road and walls to the canyon's air, W/m² of ground."""
    x = _simulated(s, d)
    return x.select("station_id", "hour", F.round(0.6 * 9.5 * (F.col("road") - F.col("canyon")) + 9.5 * (F.col("wall") - F.col("canyon")), 4).alias("flux"))


@query("building_energy")
def building_energy(s, d):
    """Heat that rooms give off, by station."""
    w = F.col("wall")
    heat = F.greatest(1.2 * (w - 24.0), F.lit(0.0)) * (4 / 3) + F.greatest(1.2 * (20.0 - w), F.lit(0.0)) * 0.2
    return _simulated(s, d).groupBy("station_id").agg(F.round(F.avg(heat), 4).alias("waste"))


@query("uwg_param_sweep")
def uwg_param_sweep(s, d):
    """One simulation per station and built density."""
    f = _forcing(s, d).withColumn("density", F.explode(F.array(F.lit(0.2), F.lit(0.5))))
    f = f.withColumn("case", F.concat_ws("/", F.col("station_id").cast("string"), F.col("density").cast("string")))
    return K.run_sites(f, "case").groupBy("case").agg(F.round(F.avg("canyon"), 3).alias("canyon"))


@query("surface_flux", "SELECT ts_h, ROUND(0.9 * kdn + 0.5 * (300 - 0.0000000567 * pow(293.15, 4)) + (5.8 + 3.7 * ws) * (td - 20), 4) AS flux FROM f_weather")
def surface_flux(s, d):
    """Net flux into a road at 20 °C that sees half the sky."""
    return view(s, d, "f_weather").select("ts_h", F.round(0.9 * F.col("kdn") + 0.5 * (300 - 5.67e-8 * 293.15**4) + (5.8 + 3.7 * F.col("ws")) * (F.col("td") - 20), 4).alias("flux"))


@query("conduction")
def conduction(s, d):
    """Five layers after one step under each hour's flux: the systems of a batch are solved together."""
    from pyspark.sql.types import ArrayType, DoubleType

    def step(flux: pa.Array) -> pa.Array:
        f = flux.to_numpy(zero_copy_only=False)
        t = K.conduct(np.full((len(f), 5), 290.0), f, K.Canyon())
        return pa.array(list(np.round(t, 4)), pa.list_(pa.float64()))

    x = surface_flux(s, d)
    return x.select("ts_h", F.arrow_udf(step, ArrayType(DoubleType()))("flux").alias("layers")).select("ts_h", *[F.col("layers")[i].alias(f"t{i}") for i in range(5)])


@query("rsm_profile", "SELECT ts_h, CAST(k AS INTEGER) AS k, ROUND(ws * ln((k * 10 + 5 + 0.1) / 0.1) / ln(10.1 / 0.1), 6) AS wind, ROUND((td + 273.15) * pow(0.998 - 0.001 * k, 0.286) - 273.15, 6) AS t, ROUND(101325 * exp(-9.81 * (k * 10 + 5) / (287 * (td + 273.15))), 4) AS p FROM f_weather CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS k) g")
def rsm_profile(s, d):
    """Wind, temperature and pressure at ten rural levels."""
    x = view(s, d, "f_weather").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    z, t = F.col("k") * 10 + 5.0, F.col("td") + 273.15
    return x.select("ts_h", "k", r6(F.col("ws") * F.ln((z + 0.1) / 0.1) / F.ln(F.lit(10.1 / 0.1)), "wind"), r6(t * F.pow(0.998 - 0.001 * F.col("k"), 0.286) - 273.15, "t"), F.round(101325 * F.exp(-9.81 * z / (287 * t)), 4).alias("p"))


_A = "(h / 12.0)"


@query("solar_canyon", f"SELECT id, ROUND(500 * (sqrt({_A} * {_A} + 1) - {_A}), 6) AS road, ROUND(500 * 0.5 * ({_A} + 1 - sqrt({_A} * {_A} + 1)) / {_A}, 6) AS wall, ROUND(500 * (sqrt({_A} * {_A} + 1) - {_A}) * 0.1 * 0.25, 6) AS bounced FROM {_WLH}")
def solar_canyon(s, d):
    """What of 500 W/m² reaches road and walls of a street 12 m wide, and what comes back after two bounces."""
    a = F.col("h") / 12.0
    road = F.sqrt(a * a + 1) - a
    return _blocks(s, d).select("id", r6(500 * road, "road"), r6(500 * 0.5 * (a + 1 - F.sqrt(a * a + 1)) / a, "wall"), r6(500 * road * 0.1 * 0.25, "bounced"))


@query("char_length", f"SELECT id, ROUND(sqrt(w * l), 6) AS char_length FROM {_WLH}")
def char_length(s, d):
    return _blocks(s, d).select("id", r6(F.sqrt(F.col("w") * F.col("l")), "char_length"))


@query("veg_percent", "SELECT CAST(id % 10 AS BIGINT) AS block, ROUND(100.0 * SUM(CASE WHEN class_id IN (5, 6, 7, 8) THEN 1 ELSE 0 END) / COUNT(*), 6) AS pct FROM f_landcover GROUP BY id % 10")
def veg_percent(s, d):
    g = view(s, d, "f_landcover").groupBy((F.col("id") % 10).alias("block"))
    return g.agg(r6(100.0 * F.count_if(F.col("class_id").isin(5, 6, 7, 8)) / F.count("*"), "pct"))


@query("bloc_building_ids", "SELECT CAST(floor(xmin / 250) AS BIGINT) AS bx, CAST(floor(ymin / 250) AS BIGINT) AS by_, list_sort(list(id)) AS ids FROM f_building GROUP BY 1, 2")
def bloc_building_ids(s, d):
    """Buildings of each 250 m block, a bounded list by the size of a block."""
    return view(s, d, "f_building").groupBy(F.floor(F.col("xmin") / 250).alias("bx"), F.floor(F.col("ymin") / 250).alias("by_")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


_HEIGHTS = "(2 + (hour(ts_h) * 3) % 40)"


@query("wind_profile_user", f"SELECT ts_h, CAST({_HEIGHTS} AS DOUBLE) AS z, ROUND(ws * CASE WHEN {_HEIGHTS} <= 5 THEN 0.8 WHEN {_HEIGHTS} <= 10 THEN 0.8 + 0.2 * ({_HEIGHTS} - 5) / 5.0 WHEN {_HEIGHTS} <= 30 THEN 1 + 0.3 * ({_HEIGHTS} - 10) / 20.0 ELSE 1.3 END, 6) AS v FROM f_weather")
def wind_profile_user(s, d):
    """A measured profile (heights and factors to the speed at 10 m, as a table) read at any height: the line between the levels around it, the end levels beyond."""
    profile = s.createDataFrame([(5.0, 0.8), (10.0, 1.0), (30.0, 1.3)], "level double, factor double")
    levels = profile.agg(F.array_sort(F.collect_list(F.struct("level", "factor"))).alias("p"))
    w = view(s, d, "f_weather").select("ts_h", "ws", (2 + (F.hour("ts_h") * 3) % 40).cast("double").alias("z")).crossJoin(F.broadcast(levels))
    below, above = F.filter("p", lambda x: x["level"] <= F.col("z")), F.filter("p", lambda x: x["level"] > F.col("z"))
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = lo["factor"] + (hi["factor"] - lo["factor"]) * (F.col("z") - lo["level"]) / (hi["level"] - lo["level"])
    return w.select("ts_h", "z", r6(F.col("ws") * F.coalesce(between, lo["factor"], hi["factor"]), "v"))


# The comfort cube -------------------------------------------------------------------------------------------------------------------------


def _cube(s, d) -> DataFrame:
    ok = "utci IS NOT NULL AND NOT isnan(utci) AND utci BETWEEN -50 AND 70 AND tmr BETWEEN -50 AND 100 AND NOT isnan(tmr) AND wind BETWEEN 0 AND 30 AND NOT isnan(wind)"
    return view(s, d, "comfort_cells").where(ok)


@query("utci")
def utci_cells(s, d):
    """The index of every cell at 25 °C and 50 % humidity, from its mean radiant temperature and wind."""
    return _cube(s, d).select("site_id", "time", "y", "x", F.round(utci(F.lit(25.0), F.col("tmr"), F.greatest("wind", F.lit(0.5)), F.lit(50.0)), 4).alias("utci"))


@query("comfort_from_rasters")
def comfort_from_rasters(s, d):
    """Comfort classes at fixed 25 °C and 75 %."""
    u = utci(F.lit(25.0), F.col("tmr"), F.greatest("wind", F.lit(0.5)), F.lit(75.0))
    return _cube(s, d).select("site_id", "time", u.alias("u")).groupBy("site_id", "time", C.comfort_class(F.col("u")).alias("cls")).agg(F.count("*").alias("n"))


@query("utci_table_pipeline", "SELECT site_id, time, ROUND(AVG(CASE WHEN shadow < 0.5 THEN utci END), 8) AS shade, ROUND(AVG(CASE WHEN shadow > 0.5 THEN utci END), 8) AS sun, CAST(COUNT(*) AS BIGINT) AS n FROM comfort_cells WHERE utci IS NOT NULL AND NOT isnan(utci) AND utci <> -9999 AND shadow IS NOT NULL AND NOT isnan(shadow) GROUP BY site_id, time")
def utci_table_pipeline(s, d):
    c = view(s, d, "comfort_cells").where("utci IS NOT NULL AND NOT isnan(utci) AND utci <> -9999 AND shadow IS NOT NULL AND NOT isnan(shadow)")
    return c.groupBy("site_id", "time").agg(F.round(F.avg(F.when(F.col("shadow") < 0.5, F.col("utci"))), 8).alias("shade"), F.round(F.avg(F.when(F.col("shadow") > 0.5, F.col("utci"))), 8).alias("sun"), F.count("*").alias("n"))


# Reference buildings and parameters ---------------------------------------------------------------------------------------------------------

_R = "(SELECT id, CASE WHEN h < 10 THEN 'low' WHEN h < 20 THEN 'mid' ELSE 'high' END AS type, CASE id % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'recent' ELSE 'new' END AS era, CASE WHEN id % 5 = 0 THEN '1B' ELSE '4A' END AS zone FROM " + _WLH + ") r"
_ZONE = "CASE zone WHEN '1B' THEN '1A' WHEN '5C' THEN '5B' ELSE zone END"


def _reference(s, d) -> DataFrame:
    b = _blocks(s, d)
    kind = F.when(F.col("h") < 10, "low").when(F.col("h") < 20, "mid").otherwise("high")
    era = F.when(F.col("id") % 3 == 0, "old").when(F.col("id") % 3 == 1, "recent").otherwise("new")
    zone = F.when(F.col("id") % 5 == 0, "1B").otherwise("4A")
    near = F.when(zone == "1B", "1A").when(zone == "5C", "5B").otherwise(zone)
    return b.select("id", kind.alias("type"), era.alias("era"), near.alias("zone"))


@query("uwg_generate", f"SELECT type, era, {_ZONE} AS zone, CAST(COUNT(*) AS BIGINT) AS n FROM {_R} GROUP BY 1, 2, 3")
def uwg_generate(s, d):
    """Buildings by type, era and climate zone; zones that the reference set lacks take their neighbour."""
    return _reference(s, d).groupBy("type", "era", "zone").agg(F.count("*").alias("n"))


@query("doe_reference", "SELECT id, CASE WHEN h < 10 THEN 0.2 WHEN h < 20 THEN 0.35 ELSE 0.5 END::DOUBLE AS glazing, ROUND(1 / (0.17 + h / 40), 6) AS u_wall FROM " + _WLH)
def doe_reference(s, d):
    """Glazing and wall conductance by type and thickness."""
    h = F.col("h")
    return _blocks(s, d).select("id", F.when(h < 10, 0.2).when(h < 20, 0.35).otherwise(0.5).alias("glazing"), r6(1 / (0.17 + h / 40), "u_wall"))


@query("uwg_custom_reference", f"SELECT type, era, MAX(v) AS v FROM (SELECT type, era, 1 AS v FROM {_R} UNION ALL SELECT 'low', 'old', 2) t GROUP BY type, era")
def uwg_custom_reference(s, d):
    """A reference set with own entries spliced in: of two for one place the own one counts."""
    own = s.createDataFrame([("low", "old", 2)], "type string, era string, v int")
    return _reference(s, d).select("type", "era", F.lit(1).alias("v")).unionByName(own).groupBy("type", "era").agg(F.max("v").alias("v"))


@query("uwg_json_roundtrip", "SELECT id, w, l, h FROM " + _WLH)
def uwg_json_roundtrip(s, d):
    j = _blocks(s, d).select(F.to_json(F.struct("id", "w", "l", "h")).alias("j"))
    return j.select(F.from_json("j", "id bigint, w double, l double, h double").alias("o")).select("o.*")


_KIND = "CASE isodow(ts_h) WHEN 6 THEN 'saturday' WHEN 7 THEN 'sunday' ELSE 'weekday' END"


@query("uwg_week_validity", f"SELECT kind, CAST(COUNT(*) AS INTEGER) AS hours, COUNT(*) = 24 AND MIN(share) >= 0 AND MAX(share) <= 1 AS valid FROM (SELECT {_KIND} AS kind, hour(ts_h) AS h, AVG(rh) / 100 AS share FROM f_weather GROUP BY 1, 2) t GROUP BY kind")
def uwg_week_validity(s, d):
    """Schedules of a week (weekday, Saturday, Sunday) from hourly means: valid with 24 hours each, every value a share."""
    day = F.weekday("ts_h")
    kind = F.when(day == 5, "saturday").when(day == 6, "sunday").otherwise("weekday")
    hours = view(s, d, "f_weather").groupBy(kind.alias("kind"), F.hour("ts_h").alias("h")).agg((F.avg("rh") / 100).alias("share"))
    week = hours.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("h", "share"))).alias("day"))
    return week.select("kind", F.size("day").alias("hours"), ((F.size("day") == 24) & F.forall("day", lambda x: x["share"].between(0, 1))).alias("valid"))


@query("uwg_z_mesh", "SELECT CAST(k AS INTEGER) AS k, 10.0 * k * (k + 1) / 2 AS z, CAST(10.0 * (k + 1) AS DOUBLE) AS dz FROM (SELECT unnest(generate_series(0, 54)) AS k) g")
def uwg_z_mesh(s, d):
    """A vertical mesh whose layers grow upward."""
    k = F.col("id")
    return s.range(55).select(k.cast("int").alias("k"), (10.0 * k * (k + 1) / 2).alias("z"), (10.0 * (k + 1)).alias("dz"))


@query("batch_urock", "SELECT ts_h, CAST(dir AS INTEGER) AS direction, ROUND(ws * pow(15 / 10.0, 0.12 * 0.5 + 0.18), 6) AS v FROM f_weather CROSS JOIN (SELECT unnest([0, 90, 180, 270]) AS dir) g")
def batch_urock(s, d):
    x = view(s, d, "f_weather").withColumn("direction", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))))
    return x.select("ts_h", "direction", r6(power_profile(F.col("ws"), F.lit(15.0), 10.0, F.lit(0.5)), "v"))


@query("scan_cosia_wms", "SELECT r // 2 AS r, c // 2 AS c, arg_min(v, r * 1000 + c) AS v FROM f_pixel GROUP BY 1, 2")
def scan_cosia_wms(s, d):
    """A coarser image by the first pixel of each block."""
    p = view(s, d, "f_pixel")
    return p.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(F.min_by("v", F.col("r") * 1000 + F.col("c")).alias("v"))


@query("scan_gitlab_raw", "SELECT 'project/-/raw/main/' || s_name AS url FROM supplier")
def scan_gitlab_raw(s, d):
    """The addresses at which raw files would be fetched; no network is at hand."""
    return view(s, d, "supplier").select(F.concat(F.lit("project/-/raw/main/"), "s_name").alias("url"))


QUERIES, ORACLES = book.queries, book.oracles
