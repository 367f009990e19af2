"""Scalar functions, dates and strings, physics and comfort formulas over the weather and comfort tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import air as A
from ..functions import comfort as C
from ..functions import geometry as G
from ..functions import wind as W
from ..functions.lookups import COMPASS
from .base import Book, view

book = Book()
query = book.query
_K = "(td + 273.15)"
_PWS = f"(exp(-5800.2206 / {_K} + 1.3914993 - 0.048640239 * {_K} + 0.000041764768 * pow({_K}, 2) - 0.000000014452093 * pow({_K}, 3) + 6.5459673 * ln({_K})) / 1000)"
_WR = f"(0.62198 * (rh * {_PWS} * 10) / (101325 - rh * {_PWS} * 10))"
_PW = f"({_WR} * 101.325 / (0.621945 + {_WR}))"
_PPD = lambda v: f"(100 - 95 * exp(-0.03353 * pow(greatest({v}, 0.0), 4) - 0.2179 * pow(greatest({v}, 0.0), 2)))"
_PMV = lambda u: f"(0.5 + 2.5 * ({u} - 26) / 16.0)"
_CLEAN = "(SELECT site_id, time, y, x, shadow, utci, tmr, wind FROM comfort_cells WHERE utci IS NOT NULL AND NOT isnan(utci) AND utci BETWEEN -50 AND 70 AND tmr IS NOT NULL AND NOT isnan(tmr) AND tmr > -100 AND shadow IS NOT NULL AND NOT isnan(shadow))"


def _w(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "f_weather")


def _cells(s: SparkSession, d: str) -> DataFrame:
    ok = "utci IS NOT NULL AND NOT isnan(utci) AND utci BETWEEN -50 AND 70 AND tmr IS NOT NULL AND NOT isnan(tmr) AND tmr > -100 AND shadow IS NOT NULL AND NOT isnan(shadow)"
    return view(s, d, "comfort_cells").where(ok).select("site_id", "time", "y", "x", "shadow", "utci", "tmr", "wind")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Angles, bins, wind ---------------------------------------------------------------------------------------------------------------------


@query("fn_deg_to_rad", "SELECT ts_h, ROUND(radians(wd), 6) AS rad FROM f_weather")
def fn_deg_to_rad(s, d):
    return _w(s, d).select("ts_h", r6(F.radians("wd"), "rad"))


_DEG = "(360 - degrees(radians(wd)) + 90)"


@query("fn_rad_to_deg", f"SELECT ts_h, ROUND(CASE WHEN {_DEG} > 360 THEN {_DEG} - 360 WHEN {_DEG} < 0 THEN {_DEG} + 360 ELSE {_DEG} END, 5) AS deg FROM f_weather WHERE wd <> 90")
def fn_rad_to_deg(s, d):
    return _w(s, d).where("wd <> 90").select("ts_h", F.round(W.to_degrees(F.radians("wd")), 5).alias("deg"))


_UV = "(SELECT ts_h, CAST(wd % 7 - 3 AS DOUBLE) AS u, CAST(wd % 5 - 2 AS DOUBLE) AS v FROM f_weather) t"


@query("fn_wind_dir_xy", f"SELECT ts_h, ROUND((CASE WHEN u = 0 THEN 0 ELSE atan(v / u) END) + CASE WHEN u <= 0 AND v > 0 THEN pi() WHEN u < 0 AND v <= 0 THEN pi() WHEN u >= 0 AND v < 0 THEN 2 * pi() ELSE 0 END, 6) AS dir FROM {_UV}")
def fn_wind_dir_xy(s, d):
    return _w(s, d).select("ts_h", r6(W.direction_of((F.col("wd") % 7 - 3).cast("double"), (F.col("wd") % 5 - 2).cast("double")), "dir"))


_COMPASS_SQL = "list_extract([" + ", ".join(f"'{c}'" for c in COMPASS) + "], CAST(floor(wd / 22.5 + 0.5) AS BIGINT) % 16 + 1)"


@query("fn_deg_to_compass", f"SELECT ts_h, {_COMPASS_SQL} AS compass FROM f_weather")
def fn_deg_to_compass(s, d):
    return _w(s, d).select("ts_h", W.compass(F.col("wd")).alias("compass"))


@query("fn_speed_bin", "SELECT ts_h, CAST(floor(ws) AS INTEGER) || '-' || CAST(floor(ws) + 1 AS INTEGER) AS bin FROM f_weather")
def fn_speed_bin(s, d):
    return _w(s, d).select("ts_h", W.speed_bin(F.col("ws")).alias("bin"))


@query("fn_bin_rank", "SELECT ts_h, CAST(floor(ws) * 100 AS BIGINT) AS bin_rank FROM f_weather")
def fn_bin_rank(s, d):
    return _w(s, d).select("ts_h", (F.floor("ws") * 100).alias("bin_rank"))


_ROSE = f"SELECT {_COMPASS_SQL} AS dir, floor(ws) AS b, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM f_weather), 3) AS frequency FROM f_weather GROUP BY 1, 2"


def _rose(s, d):
    """Share of hours by direction and speed step, in percent of all hours."""
    w = _w(s, d)
    n = F.broadcast(w.agg(F.count("*").alias("n")))
    g = w.groupBy(W.compass(F.col("wd")).alias("dir"), F.floor("ws").cast("double").alias("b")).agg(F.count("*").alias("k"))
    return g.crossJoin(n).select("dir", "b", F.round(F.col("k") * 100.0 / F.col("n"), 3).alias("frequency"))


@query("agg_wind_freq", _ROSE)
def agg_wind_freq(s, d):
    return _rose(s, d)


@query("sort_wind_order", f"SELECT dir, b, CAST(list_position([{', '.join(repr(c) for c in COMPASS)}], dir) - 1 + b * 100 AS BIGINT) AS k FROM ({_ROSE}) t ORDER BY k")
def sort_wind_order(s, d):
    place = F.array_position(F.array(*map(F.lit, COMPASS)), F.col("dir")) - 1
    return _rose(s, d).select("dir", "b", (place + F.col("b") * 100).cast("long").alias("k")).orderBy("k")


_MEAN_ROSE = f"SELECT dir, ROUND(SUM((b + 0.5) * frequency) / SUM(frequency), 6) AS speed FROM ({_ROSE}) t GROUP BY dir"


@query("agg_wind_mean_speed", _MEAN_ROSE)
def agg_wind_mean_speed(s, d):
    return _rose(s, d).groupBy("dir").agg(F.round(F.sum((F.col("b") + 0.5) * F.col("frequency")) / F.sum("frequency"), 6).alias("speed"))


@query("wind_rose", f"SELECT CAST((list_position([{', '.join(repr(c) for c in COMPASS)}], dir) - 1) * 45 // 2 AS INTEGER) AS direction, speed FROM ({_MEAN_ROSE}) t")
def wind_rose(s, d):
    """Mean speed by direction in whole degrees."""
    place = F.array_position(F.array(*map(F.lit, COMPASS)), F.col("dir")) - 1
    return agg_wind_mean_speed(s, d).select(F.floor(place * 45 / 2).cast("int").alias("direction"), "speed")


@query("fn_slope_deg", "SELECT tail, head, ROUND(greatest(least(degrees(atan((head - tail) / len)), 20), -20), 6) AS slope FROM f_edge")
def fn_slope_deg(s, d):
    return view(s, d, "f_edge").select("tail", "head", r6(F.greatest(F.least(F.degrees(F.atan((F.col("head") - F.col("tail")) / F.col("len"))), F.lit(20.0)), F.lit(-20.0)), "slope"))


_SPEED = "6 * exp(-3.5 * abs((head - tail) / len * 0.1 + 0.05))"


@query("fn_walk_speed", f"SELECT tail, head, ROUND({_SPEED}, 6) AS speed, ROUND(3.6 * len / ({_SPEED}), 6) AS seconds FROM f_edge")
def fn_walk_speed(s, d):
    v = W.walking_speed((F.col("head") - F.col("tail")) / F.col("len") * 0.1)
    return view(s, d, "f_edge").select("tail", "head", r6(v, "speed"), r6(3.6 * F.col("len") / v, "seconds"))


@query("graph_travel_time", f"SELECT tail, head, ROUND(3.6 * len / ({_SPEED}), 6) AS travel_time_s FROM f_edge")
def graph_travel_time(s, d):
    v = W.walking_speed((F.col("head") - F.col("tail")) / F.col("len") * 0.1)
    return view(s, d, "f_edge").select("tail", "head", r6(3.6 * F.col("len") / v, "travel_time_s"))


@query("fn_ndvi", "SELECT r, c, ROUND(CASE WHEN v + n = 0 THEN NULL WHEN (v - n) / (v + n) < 0.2 THEN -999 ELSE (v - n) / (v + n) END, 6) AS ndvi FROM f_pixel")
def fn_ndvi(s, d):
    i = F.try_divide(F.col("v") - F.col("n"), F.col("v") + F.col("n"))
    return view(s, d, "f_pixel").select("r", "c", r6(F.when(i < 0.2, -999.0).otherwise(i), "ndvi"))


_PX = "SELECT sid, CAST(floor(0.02 * 40075000 * cos(radians(lat)) / 360 / 5) AS INTEGER) AS width_px, CAST(floor(0.01 * 111320 / 5) AS INTEGER) AS height_px FROM f_station"


def _px(s, d):
    return view(s, d, "f_station").select("sid", F.floor(0.02 * 40075000 * F.cos(F.radians("lat")) / 360 / 5).cast("int").alias("width_px"), F.lit(0.01 * 111320 / 5).cast("int").alias("height_px"))


@query("fn_wms_px", _PX)
def fn_wms_px(s, d):
    return _px(s, d)


@query("scan_wms_grid", _PX)
def scan_wms_grid(s, d):
    return _px(s, d)


@query("fn_log_wind_scale", "SELECT ts_h, ROUND(ws * ln(10 / 0.01) / ln(1.5 / 0.01), 6) AS v10 FROM f_weather")
def fn_log_wind_scale(s, d):
    return _w(s, d).select("ts_h", r6(W.log_scale(F.col("ws")), "v10"))


_TREE = "SELECT oid, lno, z AS height, ROUND(0.3 * z, 6) AS trunk, ROUND(greatest(0.1 * pow(z, 1.2), 1), 6) AS dbh FROM f_point WHERE cls = 5"


def _tree(s, d):
    return view(s, d, "f_point").where("cls = 5").select("oid", "lno", F.col("z").alias("height"), r6(0.3 * F.col("z"), "trunk"), r6(F.greatest(0.1 * F.pow("z", F.lit(1.2)), F.lit(1.0)), "dbh"))


@query("fn_tree_allometry", _TREE)
def fn_tree_allometry(s, d):
    return _tree(s, d)


@query("pc_tree_table", _TREE)
def pc_tree_table(s, d):
    return _tree(s, d)


_TENTHS = "CASE WHEN N = 9 THEN 99 ELSE CAST(round_even(least(greatest(N / 8 * 10, 0), 10), 0) AS INTEGER) END"
_N_OK = "N IS NOT NULL AND NOT isnan(N) AND N BETWEEN 0 AND 9"


@query("fn_okta_tenths", f"SELECT obs_id, {_TENTHS} AS tenths FROM station_hourly WHERE {_N_OK}")
def fn_okta_tenths(s, d):
    return view(s, d, "station_hourly").where(_N_OK).select("obs_id", A.okta_tenths(F.col("N")).alias("tenths"))


@query("fn_is_leap", "SELECT CAST(y AS INTEGER) AS y, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap FROM (SELECT unnest(generate_series(1890, 2110)) AS y) t")
def fn_is_leap(s, d):
    y = F.col("id").cast("int")
    return s.range(1890, 2111).select(y.alias("y"), (((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)).alias("leap"))


@query("fn_first_weekday", "SELECT CAST(y AS INTEGER) AS y, CAST(isodow(make_date(y, 1, 1)) AS INTEGER) AS weekday FROM (SELECT unnest(generate_series(1990, 2050)) AS y) t")
def fn_first_weekday(s, d):
    """1 (Monday) .. 7 of each January 1st."""
    y = F.col("id").cast("int")
    return s.range(1990, 2051).select(y.alias("y"), (F.weekday(F.make_date(y, F.lit(1), F.lit(1))) + 1).alias("weekday"))


# Strings, dates, JSON --------------------------------------------------------------------------------------------------------------------

_TILE = "(SELECT l_orderkey, l_linenumber, 'D0' || CAST(l_orderkey % 90 + 10 AS VARCHAR) || '_2023_' || CAST(l_partkey % 900 + 100 AS VARCHAR) || '_' || CAST(l_suppkey % 900 + 6000 AS VARCHAR) || '_vecto.gpkg' AS f FROM lineitem) t"


@query("str_regex_tile", f"SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(l_linenumber AS BIGINT) AS l, CAST(regexp_extract(f, 'D0(\\d+)_(\\d+)_(\\d+)_(\\d+)_vecto\\.gpkg', 3) AS INTEGER) * 1000 AS xmin, CAST(regexp_extract(f, 'D0(\\d+)_(\\d+)_(\\d+)_(\\d+)_vecto\\.gpkg', 4) AS INTEGER) * 1000 AS ymax FROM {_TILE}")
def str_regex_tile(s, d):
    li = view(s, d, "lineitem")
    name = F.concat(F.lit("D0"), (F.col("l_orderkey") % 90 + 10).cast("string"), F.lit("_2023_"), (F.col("l_partkey") % 900 + 100).cast("string"), F.lit("_"), (F.col("l_suppkey") % 900 + 6000).cast("string"), F.lit("_vecto.gpkg"))
    km = lambda i: F.regexp_extract(name, r"D0(\d+)_(\d+)_(\d+)_(\d+)_vecto\.gpkg", i).cast("int") * 1000
    return li.select(F.col("l_orderkey").cast("long").alias("o"), F.col("l_linenumber").cast("long").alias("l"), km(3).alias("xmin"), km(4).alias("ymax"))


@query("str_strip_ns", "SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name FROM supplier")
def str_strip_ns(s, d):
    tagged = F.concat(F.lit("{http://www.opengis.net/wfs/2.0}"), F.col("s_name"))
    return view(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.regexp_replace(tagged, r"\{.*\}", "").alias("name"))


@query("str_split_parts", "SELECT CAST(s_suppkey AS BIGINT) AS k, split_part(s_name, '#', -1) AS tail FROM supplier")
def str_split_parts(s, d):
    return view(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.element_at(F.split("s_name", "#"), -1).alias("tail"))


@query("str_prefix_postfix", "SELECT CAST(s_suppkey AS BIGINT) AS k, 'zone_' || s_name || '_1' AS label FROM supplier")
def str_prefix_postfix(s, d):
    return view(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("zone_"), "s_name", F.lit("_1")).alias("label"))


@query("str_zfill_hour", "SELECT ts_h, lpad(CAST(hour(ts_h) AS VARCHAR), 2, '0') || '00' AS it, 'Tmrt_' || year(ts_h) || '_' || dayofyear(ts_h) || '_' || lpad(CAST(hour(ts_h) AS VARCHAR), 2, '0') || '00' AS key FROM f_weather")
def str_zfill_hour(s, d):
    it = F.concat(F.lpad(F.hour("ts_h").cast("string"), 2, "0"), F.lit("00"))
    return _w(s, d).select("ts_h", it.alias("it"), F.concat_ws("_", F.lit("Tmrt"), F.year("ts_h").cast("string"), F.dayofyear("ts_h").cast("string"), it).alias("key"))


@query("str_filename_time", "SELECT tmr_key, CAST(make_date(CAST(split_part(tmr_key, '_', 2) AS INTEGER), 1, 1) + CAST(split_part(tmr_key, '_', 3) AS INTEGER) - 1 AS DATE) AS day, CAST(split_part(tmr_key, '_', 4)[1:2] AS INTEGER) AS h FROM comfort_cells WHERE tmr_key IS NOT NULL GROUP BY tmr_key")
def str_filename_time(s, d):
    k = view(s, d, "comfort_cells").where("tmr_key IS NOT NULL").select("tmr_key").distinct()
    part = lambda i: F.regexp_extract("tmr_key", r"_(\d{4})_(\d+)_(\d\d)\d\d", i).cast("int")
    return k.select("tmr_key", F.date_add(F.make_date(part(1), F.lit(1), F.lit(1)), part(2) - 1).alias("day"), part(3).alias("h"))


@query("str_similarity", "SELECT p_name AS a, levenshtein(p_name, 'green metal building') AS dist FROM part GROUP BY p_name")
def str_similarity(s, d):
    """Edit distance to a label: no language model is at hand, so similarity is of letters, not of meaning."""
    return view(s, d, "part").select(F.col("p_name").alias("a")).distinct().select("a", F.levenshtein("a", F.lit("green metal building")).cast("long").alias("dist"))


@query("str_layer_lookup", "SELECT CAST(p_partkey AS BIGINT) AS k FROM part WHERE contains(p_name, 'green')")
def str_layer_lookup(s, d):
    return view(s, d, "part").where(F.col("p_name").contains("green")).select(F.col("p_partkey").cast("long").alias("k"))


@query("str_range_label", "SELECT ts_h, (floor(ws) + floor(ws) + 1) / 2 AS mid FROM f_weather")
def str_range_label(s, d):
    label = W.speed_bin(F.col("ws"))
    ends = F.split(label, "-")
    return _w(s, d).select("ts_h", ((ends[0].cast("double") + ends[1].cast("double")) / 2).alias("mid"))


@query("date_julian_to_date", "SELECT ts_h, CAST(make_date(year(ts_h), 1, 1) + CAST(dayofyear(ts_h) - 1 AS INTEGER) AS DATE) AS day FROM f_weather")
def date_julian_to_date(s, d):
    return _w(s, d).select("ts_h", F.date_add(F.make_date(F.year("ts_h"), F.lit(1), F.lit(1)), F.dayofyear("ts_h") - 1).alias("day"))


@query("date_julian_offset", "SELECT ts_h, make_timestamp(2022, 1, 1, 0, 0, 0) + to_days(CAST(dayofyear(ts_h) - 7 AS INTEGER)) + to_hours(CAST(hour(ts_h) AS INTEGER)) AS at FROM f_weather")
def date_julian_offset(s, d):
    return _w(s, d).select("ts_h", F.expr("timestampadd(HOUR, (dayofyear(ts_h) - 7) * 24 + hour(ts_h), TIMESTAMP_NTZ '2022-01-01 00:00:00')").alias("at"))


@query("date_parts", "SELECT ts_h, CAST(year(ts_h) AS INTEGER) AS y, CAST(dayofyear(ts_h) AS INTEGER) AS doy, CAST(month(ts_h) AS INTEGER) AS m, CAST(hour(ts_h) + 1 AS INTEGER) AS h FROM f_weather")
def date_parts(s, d):
    return _w(s, d).select("ts_h", F.year("ts_h").alias("y"), F.dayofyear("ts_h").alias("doy"), F.month("ts_h").alias("m"), (F.hour("ts_h") + 1).alias("h"))


@query("date_range", "SELECT unnest(generate_series(TIMESTAMP '2023-07-01 00:00:00', TIMESTAMP '2023-07-10 00:00:00', INTERVAL 3 HOUR)) AS at")
def date_range(s, d):
    return s.range(1).select(F.explode(F.expr("sequence(TIMESTAMP_NTZ '2023-07-01 00:00:00', TIMESTAMP_NTZ '2023-07-10 00:00:00', INTERVAL 3 HOURS)")).alias("at"))


@query("date_parse", "SELECT obs_id, strptime(AAAAMMJJHH, '%Y%m%d%H') AS at FROM station_hourly WHERE regexp_full_match(AAAAMMJJHH, '20[0-9]{6}([01][0-9]|2[0-3])') AND try_strptime(AAAAMMJJHH, '%Y%m%d%H') IS NOT NULL")
def date_parse(s, d):
    t = view(s, d, "station_hourly").where(F.col("AAAAMMJJHH").rlike(r"^20[0-9]{6}([01][0-9]|2[0-3])$"))
    return t.select("obs_id", F.try_to_timestamp("AAAAMMJJHH", F.lit("yyyyMMddHH")).cast("timestamp_ntz").alias("at")).where("at IS NOT NULL")


@query("json_nested", "SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k FROM events")
def json_nested(s, d):
    return view(s, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.get_json_object("props", "$.k").alias("k"))


@query("json_tags_name", "SELECT event_id, COALESCE(json_extract_string('{\"name\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"n' || event_id || '\"' END || '}', '$.name'), 'unnamed') AS name FROM events")
def json_tags_name(s, d):
    tags = F.concat(F.lit('{"name":'), F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.concat(F.lit('"n'), F.col("event_id").cast("string"), F.lit('"'))), F.lit("}"))
    return view(s, d, "events").select("event_id", F.coalesce(F.get_json_object(tags, "$.name"), F.lit("unnamed")).alias("name"))


@query("array_list_parse", "SELECT r, CAST(r AS DOUBLE) + 0.5 + 2 * r AS total FROM (SELECT DISTINCT r FROM f_pixel) t")
def array_list_parse(s, d):
    text = F.concat(F.lit("["), F.col("r").cast("string"), F.lit(", 0.5, "), (F.col("r") * 2).cast("string"), F.lit("]"))
    numbers = F.transform(F.split(F.regexp_replace(text, r"[\[\] ]", ""), ","), lambda x: x.cast("double"))
    return view(s, d, "f_pixel").select("r").distinct().select("r", F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("map_dictionary", "SELECT ts_h, CASE wd % 4 WHEN 0 THEN 'calm' WHEN 1 THEN 'light' WHEN 2 THEN 'fresh' END AS word FROM f_weather")
def map_dictionary(s, d):
    from ..functions.lookups import lookup

    return _w(s, d).select("ts_h", lookup(F.col("wd") % 4, {0: "calm", 1: "light", 2: "fresh"}).alias("word"))


@query("fn_range_checks", "SELECT ts_h, rh FROM f_weather WHERE rh BETWEEN 0 AND 100")
def fn_range_checks(s, d):
    """Every value in its range, or the query fails."""
    return _w(s, d).withColumn("ok", F.assert_true(F.col("rh").between(0, 100), F.lit("humidity out of range"))).where("ok IS NULL").select("ts_h", "rh")


@query("resolve_period_url", "SELECT ts_h, CASE WHEN year(ts_h) >= 2000 AND year(ts_h) < 2020 THEN 'H_2000-2019' WHEN year(ts_h) >= 2020 AND year(ts_h) < 2030 THEN 'H_2020-2029' END AS title FROM f_weather")
def resolve_period_url(s, d):
    """The title ``…_A-B`` whose years hold the row's: an interval lookup against an array."""
    titles = F.array(*map(F.lit, ("H_2000-2019", "H_2020-2029", "H_1950-1999")))
    years = lambda t, i: F.element_at(F.split(F.element_at(F.split(t, "_"), -1), "-"), i).cast("int")
    hit = F.filter(titles, lambda t: (years(t, 1) <= F.year("ts_h")) & (F.year("ts_h") <= years(t, 2)))
    return _w(s, d).select("ts_h", F.get(hit, F.lit(0)).alias("title"))


# Moist air, sun, radiation ----------------------------------------------------------------------------------------------------------------


@query("saturation_pressure", f"SELECT ts_h, ROUND({_PWS}, 6) AS pws FROM f_weather")
def saturation_pressure(s, d):
    return _w(s, d).select("ts_h", r6(A.saturation_pressure(F.col("td")), "pws"))


def _ratio():
    return A.humidity_ratio(F.col("rh"), F.col("td"), F.lit(101325.0))


@query("humidity_ratio", f"SELECT ts_h, ROUND({_WR}, 9) AS w FROM f_weather")
def humidity_ratio(s, d):
    return _w(s, d).select("ts_h", F.round(_ratio(), 9).alias("w"))


@query("air_density", f"SELECT ts_h, ROUND(101325 / (1000 * 0.287042 * {_K} * (1 + 1.607858 * {_WR})), 6) AS rho FROM f_weather")
def air_density(s, d):
    return _w(s, d).select("ts_h", r6(A.air_density(F.lit(101325.0), F.col("td") + 273.15, _ratio()), "rho"))


@query("psychrometrics", f"SELECT ts_h, ROUND({_PW} / {_PWS} * 100, 5) AS phi, ROUND(1006 * td + {_WR} * (2501000 + 1860 * td), 4) AS h, ROUND(0.287042 * {_K} * (1 + 1.607858 * {_WR}) / 101.325, 6) AS v, ROUND(6.54 + 14.526 * ln({_PW}) + 0.7389 * pow(ln({_PW}), 2) + 0.09486 * pow(ln({_PW}), 3) + 0.4569 * pow({_PW}, 0.1984), 5) AS tdp FROM f_weather")
def psychrometrics(s, d):
    t, w, p = F.col("td"), F.col("w"), F.lit(101325.0)
    x = _w(s, d).withColumn("w", _ratio())
    return x.select("ts_h", F.round(A.relative_humidity(t, w, p), 5).alias("phi"), F.round(A.enthalpy(t, w), 4).alias("h"), r6(A.specific_volume(t, w, p), "v"), F.round(A.dew_point(w, p), 5).alias("tdp"))


@query("qsat", f"SELECT ts_h, ROUND(0.62198 * {_PWS} / (101.325 - {_PWS}), 8) AS q FROM f_weather")
def qsat(s, d):
    """Saturation ratio of the air at standard pressure."""
    p = A.saturation_pressure(F.col("td"))
    return _w(s, d).select("ts_h", F.round(0.62198 * p / (101.325 - p), 8).alias("q"))


_G = "(2 * pi() * (dayofyear(ts_h) - 1) / 365)"
_DECL = f"(0.006918 - 0.399912 * cos({_G}) + 0.070257 * sin({_G}) - 0.006758 * cos(2 * {_G}) + 0.000907 * sin(2 * {_G}) - 0.002697 * cos(3 * {_G}) + 0.00148 * sin(3 * {_G}))"
_EQT = f"(229.18 * (0.000075 + 0.001868 * cos({_G}) - 0.032077 * sin({_G}) - 0.014615 * cos(2 * {_G}) - 0.040849 * sin(2 * {_G})))"
_HA = f"radians((hour(ts_h) * 60 + {_EQT} + 4 * 2.35) / 4 - 180)"
_SUN = f"SELECT ts_h, ROUND({_DECL}, 6) AS declination, ROUND({_EQT}, 6) AS eqtime, ROUND(acos(sin(radians(48.85)) * sin({_DECL}) + cos(radians(48.85)) * cos({_DECL}) * cos({_HA})), 6) AS zenith FROM f_weather"


@query("solar_angles", _SUN)
def solar_angles(s, d):
    doy = F.dayofyear("ts_h")
    return _w(s, d).select("ts_h", r6(A.declination(doy), "declination"), r6(A.equation_of_time(doy), "eqtime"), r6(A.zenith(doy, F.hour("ts_h"), 48.85, 2.35), "zenith"))


@query("sun_path", f"SELECT ts_h, ROUND(90 - degrees(zenith), 4) AS altitude FROM ({_SUN}) t WHERE hour(ts_h) > 6 AND hour(ts_h) < 22")
def sun_path(s, d):
    z = F.round(A.zenith(F.dayofyear("ts_h"), F.hour("ts_h"), 48.85, 2.35), 6)
    return _w(s, d).where((F.hour("ts_h") > 6) & (F.hour("ts_h") < 22)).select("ts_h", F.round(90 - F.degrees(z), 4).alias("altitude"))


_MET = "T IS NOT NULL AND TD IS NOT NULL AND T BETWEEN -60 AND 60 AND TD BETWEEN -60 AND 60 AND (N IS NULL OR isnan(N) OR N BETWEEN 0 AND 9)"
_NN = "(CASE WHEN N IS NULL OR isnan(N) THEN 0 ELSE N END)"
_T10 = f"(CASE WHEN {_NN} = 9 THEN 99 ELSE round_even(least(greatest({_NN} / 8 * 10, 0), 10), 0) END)"
_EPS = "least(greatest(0.787 + 0.764 * ln((TD + 273.15) / 273.15), 0.1), 1.0)"


@query("epw_infrared", f"SELECT obs_id, ROUND(CASE WHEN INFRAR > 0 AND INFRAR < 500 THEN INFRAR * (10000.0 / 3600) ELSE {_EPS} * (1 + 0.0224 * {_T10} - 0.0035 * {_T10} * {_T10} + 0.00028 * {_T10} * {_T10} * {_T10}) * 0.0000000567 * pow(T + 273.15, 4) END, 3) AS ir FROM station_hourly WHERE {_MET}")
def epw_infrared(s, d):
    h = view(s, d, "station_hourly").where(_MET)
    known = F.when((F.col("INFRAR") > 0) & (F.col("INFRAR") < 500), F.col("INFRAR"))
    n = F.when(F.col("N").isNull() | F.isnan("N"), 0.0).otherwise(F.col("N"))
    return h.select("obs_id", F.round(A.sky_infrared(known, F.col("T"), F.col("TD"), n), 3).alias("ir"))


@query("epw_convert", "SELECT obs_id, ROUND(COALESCE(least(greatest(T, -70), 70), 99.9), 4) AS drybulb, COALESCE(least(greatest(U, 0), 100), 999) AS relhum, ROUND(COALESCE(least(greatest(PSTAT * 100, 31000), 120000), 999999), 3) AS pressure, COALESCE(least(greatest(FF, 0), 40), 999) AS windspd, COALESCE(least(greatest(DD, 0), 360), 999) AS winddir, ROUND(COALESCE(VV / 1000, 9999), 4) AS visibility FROM station_hourly")
def epw_convert(s, d):
    """Readings as weather-file columns: clipped to the format's ranges, its codes for what is missing."""
    clip = lambda c, lo, hi, none: F.coalesce(F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))), F.lit(float(none)))
    return view(s, d, "station_hourly").select(
        "obs_id", F.round(clip(F.col("T"), -70, 70, 99.9), 4).alias("drybulb"), clip(F.col("U"), 0, 100, 999).alias("relhum"), F.round(clip(F.col("PSTAT") * 100, 31000, 120000, 999999), 3).alias("pressure"),
        clip(F.col("FF"), 0, 40, 999).alias("windspd"), clip(F.col("DD"), 0, 360, 999).alias("winddir"), F.round(F.coalesce(F.col("VV") / 1000, F.lit(9999.0)), 4).alias("visibility"),
    )


_KT = "least(greatest(kdn / 900, 0), 1)"


@query("epw_dni_dhi", f"SELECT ts_h, ROUND(kdn * CASE WHEN {_KT} <= 0.22 THEN 1 - 0.09 * {_KT} WHEN {_KT} <= 0.8 THEN 0.9511 - 0.1604 * {_KT} + 4.388 * pow({_KT}, 2) - 16.638 * pow({_KT}, 3) + 12.336 * pow({_KT}, 4) ELSE 0.165 END, 9) AS dhi FROM f_weather")
def epw_dni_dhi(s, d):
    """Diffuse part of global radiation by clearness (Erbs's published correlation)."""
    k = F.least(F.greatest(F.col("kdn") / 900, F.lit(0.0)), F.lit(1.0))
    share = F.when(k <= 0.22, 1 - 0.09 * k).when(k <= 0.8, 0.9511 - 0.1604 * k + 4.388 * F.pow(k, 2) - 16.638 * F.pow(k, 3) + 12.336 * F.pow(k, 4)).otherwise(0.165)
    return _w(s, d).select("ts_h", F.round(F.col("kdn") * share, 9).alias("dhi"))


@query("umep_forcing", "SELECT CAST(year(ts_h) AS INTEGER) AS iy, CAST(dayofyear(ts_h) AS INTEGER) AS id, CAST(hour(ts_h) AS INTEGER) AS it, 0 AS imin, ws AS wind, rh AS rh, td AS td, kdn AS kdn, -999.0::DOUBLE AS rain, wd FROM f_weather")
def umep_forcing(s, d):
    return _w(s, d).select(F.year("ts_h").alias("iy"), F.dayofyear("ts_h").alias("id"), F.hour("ts_h").alias("it"), F.lit(0).alias("imin"), F.col("ws").alias("wind"), "rh", "td", "kdn", F.lit(-999.0).alias("rain"), "wd")


@query("umep_forcing_days", "SELECT CAST(dayofyear(ts_h) + k AS INTEGER) AS id, CAST(hour(ts_h) AS INTEGER) AS it, td FROM f_weather CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS k) g WHERE hour(ts_h) > 8 AND hour(ts_h) < 22")
def umep_forcing_days(s, d):
    w = _w(s, d).where((F.hour("ts_h") > 8) & (F.hour("ts_h") < 22)).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return w.select((F.dayofyear("ts_h") + F.col("k")).alias("id"), F.hour("ts_h").alias("it"), "td")


# Comfort ------------------------------------------------------------------------------------------------------------------------------------


@query("comfort_pmv", f"SELECT site_id, time, y, x, utci, ROUND({_PPD(_PMV('utci'))}, 6) AS ppd FROM {_CLEAN} t")
def comfort_pmv(s, d):
    return _cells(s, d).select("site_id", "time", "y", "x", "utci", r6(C.ppd(C.utci_to_pmv(F.col("utci"))), "ppd"))


@query("comfort_utci_to_pmv", f"SELECT site_id, time, y, x, ROUND({_PMV('utci')}, 9) AS pmv FROM {_CLEAN} t")
def comfort_utci_to_pmv(s, d):
    return _cells(s, d).select("site_id", "time", "y", "x", F.round(C.utci_to_pmv(F.col("utci")), 9).alias("pmv"))


_SHARE = f"(SELECT site_id, time, AVG(1 - shadow) AS share, AVG(CASE WHEN shadow < 0.5 THEN utci END) AS u_shade, AVG(CASE WHEN shadow > 0.5 THEN utci END) AS u_sun FROM {_CLEAN} c GROUP BY site_id, time) g"


def _shares(s, d):
    """By site and hour: the share of shade, and the mean UTCI in the shade and in the sun."""
    c = _cells(s, d)
    return c.groupBy("site_id", "time").agg(F.avg(1 - F.col("shadow")).alias("share"), F.avg(F.when(F.col("shadow") < 0.5, F.col("utci"))).alias("u_shade"), F.avg(F.when(F.col("shadow") > 0.5, F.col("utci"))).alias("u_sun"))


@query("comfort_ppd_shade", f"SELECT site_id, time, ROUND({_PPD('(3 - 2.5 * (100 * share) / 25.0)')}, 5) AS ppd_shade FROM {_SHARE}")
def comfort_ppd_shade(s, d):
    return _shares(s, d).select("site_id", "time", F.round(C.shade_ppd(F.col("share"), 25.0), 5).alias("ppd_shade"))


_WANT = "(2 + 23 * (u_sun - 26) / 12.0)"


@query(
    "comfort_indicator",
    f"SELECT site_id, time, ROUND(greatest({_PPD(_PMV('u_shade'))}, CASE WHEN 100 * share = 100 THEN 5 WHEN u_sun < 26 THEN 5 ELSE {_PPD(f'(3 - 2.5 * (10000 * share) / {_WANT})')} END), 5) AS ppd FROM (SELECT site_id, time, share, COALESCE(u_shade, u_sun) AS u_shade, u_sun FROM {_SHARE}) h WHERE u_sun IS NOT NULL AND {_WANT} <> 0",
)
def comfort_indicator(s, d):
    x = _shares(s, d).withColumn("u_shade", F.coalesce("u_shade", "u_sun")).where("u_sun IS NOT NULL")
    return x.where(C.wanted_shade(F.col("u_sun")) != 0).select("site_id", "time", F.round(C.comfort_indicator(F.col("share"), F.col("u_shade"), F.col("u_sun")), 5).alias("ppd"))


@query("comfort_ppd_variants", f"SELECT site_id, time, ROUND({_PPD('greatest(0.5 + 2.5 * (100 * share) / 100.0, 0)')}, 5) AS ppd_a, ROUND(10 + 65 * (u_sun - 26) / 12.0, 11) AS shade_max FROM {_SHARE}")
def comfort_ppd_variants(s, d):
    return _shares(s, d).select("site_id", "time", F.round(C.ppd(0.5 + 2.5 * (100 * F.col("share")) / 100), 5).alias("ppd_a"), F.round(C.wanted_shade(F.col("u_sun"), 10.0, 75.0), 11).alias("shade_max"))


@query("comfort_utci_fill", f"SELECT site_id, time, ROUND(COALESCE(u_shade, u_sun), 6) AS u_shade FROM {_SHARE}")
def comfort_utci_fill(s, d):
    return _shares(s, d).select("site_id", "time", r6(F.coalesce("u_shade", "u_sun"), "u_shade"))


@query("comfort_class", f"SELECT site_id, time, y, x, CASE WHEN utci < 26 THEN 0 WHEN utci < 32 THEN 1 WHEN utci < 38 THEN 2 WHEN utci < 46 THEN 3 ELSE 4 END AS cls, ROUND(CASE WHEN utci < 26 THEN (utci - 9) / 17 WHEN utci < 32 THEN 1 + (utci - 26) / 6 WHEN utci < 38 THEN 2 + (utci - 32) / 6 WHEN utci < 46 THEN 3 + (utci - 38) / 8 ELSE 4 + (utci - 46) / 14 END, 6) AS part FROM {_CLEAN} t")
def comfort_class(s, d):
    return _cells(s, d).select("site_id", "time", "y", "x", C.comfort_class(F.col("utci")).alias("cls"), r6(C.comfort_class_fraction(F.col("utci")), "part"))


@query("comfort_category", f"SELECT site_id, time, y, x, CASE WHEN utci > 32 THEN 2 WHEN utci < 28 THEN 0 ELSE 1 END AS cat FROM {_CLEAN} t")
def comfort_category(s, d):
    return _cells(s, d).select("site_id", "time", "y", "x", C.comfort_category(F.col("utci")).alias("cat"))


@query("comfort_area_ratio", f"SELECT site_id, time, CAST(COUNT(*) * 4 AS DOUBLE) AS area, CAST(SUM(CASE WHEN shadow < 0.5 THEN 4 ELSE 0 END) AS DOUBLE) AS shaded, ROUND(SUM(CASE WHEN shadow < 0.5 THEN 4 ELSE 0 END) / CAST(COUNT(*) * 4 AS DOUBLE), 6) AS ratio FROM {_CLEAN} t GROUP BY site_id, time")
def comfort_area_ratio(s, d):
    dark = F.sum(F.when(F.col("shadow") < 0.5, 4.0).otherwise(0.0))
    return _cells(s, d).groupBy("site_id", "time").agg((F.count("*") * 4.0).alias("area"), dark.alias("shaded"), F.round(dark / (F.count("*") * 4.0), 6).alias("ratio"))


@query("comfort_hot_mask", f"SELECT site_id, time, ROUND(CASE WHEN u_sun > 26 THEN u_shade END, 6) AS u FROM {_SHARE}")
def comfort_hot_mask(s, d):
    return _shares(s, d).select("site_id", "time", r6(F.when(F.col("u_sun") > 26, F.col("u_shade")), "u"))


@query("heatmap_bins", f"SELECT site_id, CAST(SUM(CASE WHEN utci < 9 THEN 1 ELSE 0 END) AS BIGINT) AS b0, CAST(SUM(CASE WHEN utci >= 9 AND utci < 26 THEN 1 ELSE 0 END) AS BIGINT) AS b1, CAST(SUM(CASE WHEN utci >= 26 AND utci < 32 THEN 1 ELSE 0 END) AS BIGINT) AS b2, CAST(SUM(CASE WHEN utci >= 32 AND utci < 38 THEN 1 ELSE 0 END) AS BIGINT) AS b3, CAST(SUM(CASE WHEN utci >= 38 THEN 1 ELSE 0 END) AS BIGINT) AS b4 FROM {_CLEAN} t GROUP BY site_id")
def heatmap_bins(s, d):
    b = F.when(F.col("utci") < 9, "b0").when(F.col("utci") < 26, "b1").when(F.col("utci") < 32, "b2").when(F.col("utci") < 38, "b3").otherwise("b4")
    return _cells(s, d).withColumn("b", b).groupBy("site_id").pivot("b", ["b0", "b1", "b2", "b3", "b4"]).count().na.fill(0)


# Blocks, canyon -----------------------------------------------------------------------------------------------------------------------------

_WLH = "(SELECT id, xmax - xmin AS w, ymax - ymin AS l, hauteur AS h FROM f_building WHERE hauteur IS NOT NULL) t"
_LR = "(1.8 * w / (pow(l / h, 0.3) * (1 + 0.24 * w / h)))"
_R = "(0.67 * least(h, w) + 0.33 * greatest(h, w))"


def _blocks(s, d):
    return view(s, d, "f_building").where("hauteur IS NOT NULL").select("id", (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("l"), F.col("hauteur").alias("h"))


@query("wind_zone_lengths", f"SELECT id, ROUND(1.5 * w / (1 + 0.8 * w / h), 6) AS displacement, ROUND(0.6 * w / (1 + 0.8 * w / h), 6) AS vortex, ROUND({_LR}, 6) AS cavity, ROUND(3 * {_LR}, 6) AS wake, ROUND(0.22 * {_R}, 6) AS roof_height, ROUND(0.9 * {_R}, 6) AS roof_length, ROUND(1 + 0.05 * w / h, 6) AS corner FROM {_WLH}")
def wind_zone_lengths(s, d):
    z = W.zone_lengths(F.col("w"), F.col("l"), F.col("h"))
    return _blocks(s, d).select("id", *[r6(v, k) for k, v in z.items()])


@query("wind_effective_dims", "SELECT id, (xmax - xmin) AS w_eff, (ymax - ymin) AS l_eff FROM f_building")
def wind_effective_dims(s, d):
    """Widths across and along the wind, scaled by the share of the envelope that the block fills."""
    b = G.with_box(view(s, d, "f_building"))
    box = G.bounds(F.col("geom"))
    fill = G.area(F.col("geom")) / ((F.col("b.xmax") - F.col("b.xmin")) * (F.col("b.ymax") - F.col("b.ymin")))
    x = b.withColumn("b", box)
    return x.select("id", F.round((F.col("b.xmax") - F.col("b.xmin")) * fill, 9).alias("w_eff"), F.round((F.col("b.ymax") - F.col("b.ymin")) * fill, 9).alias("l_eff"))


_RG = "WITH g AS (SELECT exp(SUM((xmax-xmin)*(ymax-ymin)*ln(hauteur)) / SUM((xmax-xmin)*(ymax-ymin))) AS hr, SUM((xmax-xmin)*hauteur) / ((MAX(xmax)-MIN(xmin))*(MAX(ymax)-MIN(ymin))) AS lf FROM f_building WHERE hauteur IS NOT NULL) "


@query("wind_roughness", _RG + "SELECT ROUND(CASE WHEN lf <= 0.15 THEN lf * hr ELSE 0.15 * hr END, 6) AS z0, ROUND(CASE WHEN lf <= 0.05 THEN 3 * lf * hr WHEN lf <= 0.15 THEN (0.15 + 5.5 * (lf - 0.05)) * hr ELSE (0.7 + 0.35 * (least(lf, 1) - 0.15)) * hr END, 6) AS d FROM g")
def wind_roughness(s, d):
    b = view(s, d, "f_building").where("hauteur IS NOT NULL")
    a = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    lf = F.sum((F.col("xmax") - F.col("xmin")) * F.col("hauteur")) / ((F.max("xmax") - F.min("xmin")) * (F.max("ymax") - F.min("ymin")))
    g = b.agg(F.exp(F.sum(a * F.ln("hauteur")) / F.sum(a)).alias("hr"), lf.alias("lf"))
    z0, disp = W.roughness(F.col("lf"), F.col("hr"))
    return g.select(r6(z0, "z0"), r6(disp, "d"))


@query("wind_max_height", "SELECT MAX(h) AS h_max FROM (SELECT hauteur AS h FROM f_building UNION ALL SELECT z FROM f_point WHERE cls = 5) t")
def wind_max_height(s, d):
    return view(s, d, "f_building").select(F.col("hauteur").alias("h")).unionByName(view(s, d, "f_point").where("cls = 5").select(F.col("z").alias("h"))).agg(F.max("h").alias("h_max"))


@query("wind_profile_power", "SELECT ts_h, CAST(k AS INTEGER) AS k, ROUND(ws * pow((k * 2 + 1) / 10.0, 0.12 * 0.5 + 0.18), 6) AS v FROM f_weather CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS k) g")
def wind_profile_power(s, d):
    x = _w(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(14))))
    return x.select("ts_h", "k", r6(W.power_profile(F.col("ws"), F.col("k") * 2 + 1.0, 10.0, F.lit(0.5)), "v"))


@query("wind_profile_urban", "SELECT CAST(k AS INTEGER) AS k, ROUND(CASE WHEN k * 2 + 1 < 15 THEN exp(9.6 * 0.2 * ((k * 2 + 1) / 15.0 - 1)) ELSE 1 + ln((k * 2 + 1) / 15.0) END, 6) AS f FROM (SELECT unnest(generate_series(0, 20)) AS k) g")
def wind_profile_urban(s, d):
    """Exponential below the roofs, logarithmic above, over the speed at roof height."""
    z = F.col("k") * 2 + 1.0
    return s.range(21).select(F.col("id").cast("int").alias("k")).select("k", r6(F.when(z < 15, F.exp(9.6 * 0.2 * (z / 15.0 - 1))).otherwise(1 + F.ln(z / 15.0)), "f"))


_CANYON = "SELECT CAST(id % 10 AS BIGINT) AS block, ROUND(2 * AVG(hauteur) * (1 - SUM(a) / (COUNT(*) * 625.0)) / (SUM(2 * (w + l) * hauteur) / (COUNT(*) * 625.0)), 6) AS width FROM (SELECT *, (xmax-xmin)*(ymax-ymin) AS a, xmax-xmin AS w, ymax-ymin AS l FROM f_building WHERE hauteur IS NOT NULL) t GROUP BY id % 10"


@query("canyon_width", _CANYON)
def canyon_width(s, d):
    """Mean street width of a block: open ground over half the facade, per height."""
    b = _blocks(s, d)
    plot = F.count("*") * 625.0
    return b.groupBy((F.col("id") % 10).alias("block")).agg(r6(2 * F.avg("h") * (1 - F.sum(F.col("w") * F.col("l")) / plot) / (F.sum(2 * (F.col("w") + F.col("l")) * F.col("h")) / plot), "width"))


@query("ucm_geometry", "SELECT id, ROUND(h / 12, 6) AS aspect, ROUND(sqrt(1 + pow(h / 12, 2)) - h / 12, 6) AS road_view, ROUND(0.5 * (1 + 12 / h - sqrt(1 + pow(12 / h, 2))), 6) AS wall_view FROM " + _WLH)
def ucm_geometry(s, d):
    """Aspect ratio of a street 12 m wide, and the sky that its road and walls see."""
    a = F.col("h") / 12
    return _blocks(s, d).select("id", r6(a, "aspect"), r6(F.sqrt(1 + a * a) - a, "road_view"), r6(0.5 * (1 + 1 / a - F.sqrt(1 + 1 / (a * a))), "wall_view"))


@query("infra_canyon", "SELECT id, ROUND(4 * 0.95 * 0.0000000567 * pow(293.15, 3) * (0.5 * (1 + 12 / h - sqrt(1 + pow(12 / h, 2)))) * 5, 6) AS net FROM " + _WLH)
def infra_canyon(s, d):
    """Linearised long-wave exchange of a wall with a sky 5 K colder."""
    a = F.col("h") / 12
    return _blocks(s, d).select("id", r6(4 * 0.95 * 5.67e-8 * 293.15**3 * (0.5 * (1 + 1 / a - F.sqrt(1 + 1 / (a * a)))) * 5, "net"))


@query("uwg_material_layers", "SELECT id, CAST(k AS INTEGER) AS layer, ROUND(h / 10 / ceil(h / 10 / 0.5), 6) AS thickness FROM " + _WLH + " JOIN (SELECT unnest(generate_series(0, 10)) AS k) g ON k < ceil(h / 10 / 0.5)")
def uwg_material_layers(s, d):
    """Layers of at most half a metre: as many equal parts as that takes."""
    n = F.ceil(F.col("h") / 10 / 0.5).cast("int")
    return _blocks(s, d).select("id", F.explode(F.sequence(F.lit(0), n - 1)).alias("layer"), r6(F.col("h") / 10 / n, "thickness"))


QUERIES, ORACLES = book.queries, book.oracles
