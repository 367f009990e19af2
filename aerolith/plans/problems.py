"""Queries p2 to p6: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timekeys import hour_label, minutes_of_key
from ..operators.gridding import regular_grid
from ..operators.imputation import fill_sky, sky_records
from ..operators.proximity import contained, located, near_pairs, point_tree
from ..operators.spikes import flag_implausible
from ..operators.units import minute_of, other_units, resolve_units
from ..sources.tables import table


def _hourly(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "station_hourly", "obs_id", "station_id", "AAAAMMJJHH", *columns).withColumn("minute", minutes_of_key(F.col("AAAAMMJJHH"))).drop("AAAAMMJJHH")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_flags(spark, folder).select("obs_id", "field")


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Each wrong value of T, TD, U and FF, with the reason."""
    return flag_implausible(_hourly(spark, folder, "T", "TD", "U", "FF"), "obs_id", "station_id", "minute")


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Each physically impossible value of T, TD, U and FF by itself."""
    return p2_flags(spark, folder).where("reason = 'bound'").select("obs_id", "field")


def p3_grid(spark: SparkSession, folder: str) -> DataFrame:
    """One value of T per station and grid period."""
    stations = table(spark, folder, "stations", "station_id", "step_hours").withColumn("step_minutes", F.col("step_hours") * 60)
    g = regular_grid(_hourly(spark, folder, "T"), stations, "station_id", "minute", "T", "step_minutes")
    return g.select("station_id", hour_label(F.col("period")).alias("slot"), F.round("value", 9).alias("value"), "n_readings", "state")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_grid(spark, folder).where("state != 'read'").select("station_id", "slot")


def _resolved(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    h = _hourly(spark, folder, "ALTI", "PSTAT", "INFRAR", "GLO", "DIR", "DIF", "N", "remark", "ingested_at", *keep)
    return resolve_units(h.withColumn("arrived", minute_of("ingested_at")), table(spark, folder, "station_feeds"), keep)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return other_units(_resolved(spark, folder))


def p4_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """GLO in J/cm² per hour, PSTAT in hPa, N in oktas, INFRAR in J/cm², null where missing."""
    return _resolved(spark, folder).select("obs_id", *[F.round(f"{q}_value", 4).alias(q) for q in ("GLO", "PSTAT", "N", "INFRAR")])


def p5_filled(spark: SparkSession, folder: str) -> DataFrame:
    """INFRAR (J/cm²) and N (oktas) of every reading, with a mark on filled values."""
    return fill_sky(sky_records(_resolved(spark, folder, "T"), table(spark, folder, "stations", "station_id", "dep")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    mark = lambda q: F.when(F.col(f"{q}_filled"), F.lit(q))
    return p5_filled(spark, folder).select("obs_id", F.explode(F.array_compact(F.array(mark("INFRAR"), mark("N")))).alias("field"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of points at most 15 m apart, and the zone that contains each point."""
    p = point_tree(located(table(spark, folder, "building_points", "point_id", "lon", "lat"), "point_id", "lon", "lat"))
    near = near_pairs(p, 15.0).select(F.lit("near").alias("relation"), "a_id", "b_id")
    inside = contained(p, table(spark, folder, "lcz_zones", "zone_id", "geometry"), "zone_id", "geometry")
    return near.unionByName(inside.select(F.lit("inside").alias("relation"), F.col("id").alias("a_id"), F.col("region").alias("b_id")))


QUERIES = {f.__name__: f for f in (p2_found, p2_flags, p2_bounds, p3_found, p3_grid, p4_found, p4_canonical, p5_found, p5_filled, p6_found)}

_SLOTS = r"""
WITH k AS (SELECT station_id, T, trim(regexp_replace(AAAAMMJJHH, '[\s\x{00a0}\x{2009}\x{202f}\x{200b}\x{feff}]+', ' ', 'g')) AS key FROM station_hourly WHERE T IS NOT NULL AND NOT isnan(T) AND AAAAMMJJHH IS NOT NULL),
p AS (SELECT station_id, T,
  CASE WHEN regexp_full_match(key, '[0-9]{10}([0-9]{2})?') THEN key[1:4] || '-' || key[5:6] || '-' || key[7:8] WHEN regexp_full_match(key, '[0-9]{4}-[0-9]{2}-[0-9]{2}T.*') THEN key[1:10] WHEN regexp_full_match(key, '[0-9]{2}/[0-9]{2}/[0-9]{4} .*') THEN key[7:10] || '-' || key[4:5] || '-' || key[1:2] END AS day,
  CASE WHEN regexp_full_match(key, '[0-9]{10}([0-9]{2})?') THEN key[9:10] ELSE key[12:13] END AS hh,
  CASE WHEN regexp_full_match(key, '[0-9]{10}') THEN '00' WHEN regexp_full_match(key, '[0-9]{12}') THEN key[11:12] ELSE key[15:16] END AS mi,
  CASE WHEN regexp_full_match(key, '.*T.*[+-][0-9]{2}:[0-9]{2}') THEN CAST(key[-6:-6] || '1' AS INTEGER) * (CAST(key[-5:-4] AS INTEGER) * 60 + CAST(key[-2:] AS INTEGER)) ELSE 0 END AS off FROM k),
m AS (SELECT station_id, T, CAST(epoch(TRY_CAST(day AS DATE)) / 60 AS BIGINT) + TRY_CAST(hh AS INTEGER) * 60 + TRY_CAST(mi AS INTEGER) - off AS minute FROM p WHERE TRY_CAST(day AS DATE) IS NOT NULL AND TRY_CAST(hh AS INTEGER) * 60 + TRY_CAST(mi AS INTEGER) <= 1440),
r AS (SELECT m.station_id, T AS v, minute, s.step_hours * 60 AS step, CAST(floor(minute / (s.step_hours * 60.0)) AS BIGINT) AS slot FROM m JOIN stations s ON s.station_id = m.station_id WHERE minute IS NOT NULL),
e AS (SELECT station_id, step, MIN(slot) AS a, MAX(slot) AS b FROM r GROUP BY station_id, step),
g AS (SELECT station_id, step, unnest(generate_series(a, b)) AS slot FROM e),
n AS (SELECT station_id, slot, COUNT(*) AS n FROM r GROUP BY station_id, slot),
q AS (SELECT g.station_id, g.step, g.slot, g.slot * g.step AS start, COALESCE(n.n, 0) AS n FROM g LEFT JOIN n ON n.station_id = g.station_id AND n.slot = g.slot)
"""
_LABEL = "strftime(TIMESTAMP '1970-01-01 00:00:00' + to_minutes(CAST({0} AS INTEGER)), '%Y%m%d%H')"
ORACLES = {
    "p2_bounds": """
SELECT obs_id, 'T' AS field FROM station_hourly WHERE NOT isnan(T) AND (T < -60 OR T > 60) UNION ALL SELECT obs_id, 'TD' FROM station_hourly WHERE NOT isnan(TD) AND (TD < -75 OR TD > 45)
UNION ALL SELECT obs_id, 'U' FROM station_hourly WHERE NOT isnan(U) AND (U < 0 OR U > 100) UNION ALL SELECT obs_id, 'FF' FROM station_hourly WHERE NOT isnan(FF) AND (FF < 0 OR FF > 75)""",
    "p3_found": f"{_SLOTS} SELECT station_id, {_LABEL.format('start')} AS slot FROM q WHERE n = 0",
    "p3_grid": _SLOTS
    + f"""
, l AS (SELECT q.*, r.minute AS lt, r.v AS lv FROM q ASOF LEFT JOIN (SELECT station_id, minute, MAX(v) AS v FROM r GROUP BY station_id, minute) r ON r.station_id = q.station_id AND q.start >= r.minute),
x AS (SELECT l.*, r.minute AS rt, r.v AS rv FROM l ASOF LEFT JOIN (SELECT station_id, minute, MIN(v) AS v FROM r GROUP BY station_id, minute) r ON r.station_id = l.station_id AND l.start <= r.minute)
SELECT station_id, {_LABEL.format('start')} AS slot, ROUND(CASE WHEN n > 0 AND (lt IS NULL OR rt = lt OR rt - lt > 360) THEN rv WHEN rt - lt <= 360 THEN lv + (rv - lv) * (start - lt) / (rt - lt) END, 9) AS value, CAST(n AS BIGINT) AS n_readings, CASE WHEN n > 0 THEN 'read' WHEN rt - lt <= 360 THEN 'filled' ELSE 'marked' END AS state FROM x""",
    "p6_found": r"""
WITH p AS (SELECT point_id AS id, MIN(lon) AS lon, MIN(lat) AS lat FROM building_points WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0) GROUP BY point_id),
near AS (SELECT a.id AS a_id, b.id AS b_id FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) < 0.0002
  WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 15),
rings AS (SELECT zone_id, unnest(regexp_extract_all(geometry, '\(([-0-9][^()]*)\)', 1)) AS ring FROM lcz_zones),
numbered AS (SELECT zone_id, ring, row_number() OVER () AS rid FROM rings),
pts AS (SELECT zone_id, rid, unnest(generate_series(1, len(string_split(ring, ',')))) AS k, string_split(ring, ',') AS l FROM numbered),
xy AS (SELECT zone_id, rid, k, CAST(split_part(trim(l[k]), ' ', 1) AS DOUBLE) AS x, CAST(split_part(trim(l[k]), ' ', 2) AS DOUBLE) AS y FROM pts),
edges AS (SELECT zone_id, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM xy WINDOW w AS (PARTITION BY rid ORDER BY k)),
inside AS (SELECT p.id AS a_id, e.zone_id AS b_id FROM p JOIN edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < e.x1 + (p.lat - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) WHERE e.y1 <> e.y2 GROUP BY p.id, e.zone_id HAVING COUNT(*) % 2 = 1)
SELECT 'near' AS relation, a_id, b_id FROM near UNION ALL SELECT 'inside', a_id, b_id FROM inside""",
}
