"""Registration of named queries, and the fixture views that they share with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixture views: one text that both engines run; ``{t}`` stands for a table.
FIXTURES = {
    "f_building": """
        SELECT CAST(p_partkey AS BIGINT) AS id, CAST((p_partkey % 40) * 25 AS DOUBLE) AS xmin, CAST(FLOOR(p_partkey / 40.0) * 25 AS DOUBLE) AS ymin,
               CAST((p_partkey % 40) * 25 + 5 + p_size % 10 AS DOUBLE) AS xmax, CAST(FLOOR(p_partkey / 40.0) * 25 + 5 + (p_partkey * 7) % 12 AS DOUBLE) AS ymax,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(3 + p_size % 30 AS DOUBLE) END AS hauteur,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(1 + p_size % 8 AS BIGINT) END AS nombre_d_etages
        FROM {part}""",
    "f_landcover": """
        SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_custkey % 17 AS BIGINT) AS class_id,
               CAST((c_custkey % 30) * 34 AS DOUBLE) AS xmin, CAST(FLOOR(c_custkey / 30.0) * 34 AS DOUBLE) AS ymin,
               CAST((c_custkey % 30) * 34 + 34 AS DOUBLE) AS xmax, CAST(FLOOR(c_custkey / 30.0) * 34 + 34 AS DOUBLE) AS ymax
        FROM {customer}""",
    "f_weather": """
        SELECT date_trunc('hour', ts) AS ts_h, CAST(10 + CAST(SUM(event_id * 7) % 250 AS BIGINT) / 10.0 AS DOUBLE) AS td,
               CAST(30 + CAST(SUM(user_id) % 70 AS BIGINT) AS DOUBLE) AS rh, CAST(CAST(SUM(event_id) % 97 AS BIGINT) / 10.0 AS DOUBLE) AS ws,
               CAST(SUM(event_id) % 360 AS BIGINT) AS wd, CAST(CAST(SUM(event_id * 3) % 9000 AS BIGINT) / 10.0 AS DOUBLE) AS kdn
        FROM {events} GROUP BY date_trunc('hour', ts)""",
    "f_pixel": """
        SELECT CAST(l_orderkey % 64 AS BIGINT) AS r, CAST(l_partkey % 64 AS BIGINT) AS c, CAST(MAX(l_quantity) AS DOUBLE) AS v, CAST(COUNT(*) AS BIGINT) AS n
        FROM {lineitem} GROUP BY l_orderkey % 64, l_partkey % 64""",
    "f_point": """
        SELECT CAST(l_orderkey AS BIGINT) AS oid, CAST(l_linenumber AS BIGINT) AS lno, CAST((l_orderkey * 13 + l_linenumber * 101) % 200 AS DOUBLE) + (l_partkey % 8) * CAST(0.125 AS DOUBLE) AS x,
               CAST((l_orderkey * 29 + l_linenumber * 37) % 200 AS DOUBLE) + (l_suppkey % 8) * CAST(0.125 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS z,
               CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 6 END AS cls
        FROM {lineitem}""",
    "f_edge": """
        SELECT tail, head, MIN(len) AS len FROM (
          SELECT CAST(l_suppkey % 50 AS BIGINT) AS tail, CAST(l_partkey % 50 AS BIGINT) AS head, CAST(10 + (l_partkey * 7 + l_suppkey * 3) % 90 AS DOUBLE) AS len FROM {lineitem}) t
        WHERE tail <> head GROUP BY tail, head""",
    "f_station": """
        SELECT CAST(s_suppkey AS BIGINT) AS sid, CAST(42.0 + (s_suppkey * 37 % 900) / 100.0 AS DOUBLE) AS lat, CAST(-4.0 + (s_suppkey * 53 % 1200) / 100.0 AS DOUBLE) AS lon, s_name AS name
        FROM {supplier}""",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "station_hourly", "stations", "comfort_cells", "building_points", "station_feeds", "lcz_zones", "documents")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fixture view, or a table."""
    if name not in FIXTURES:
        return table(spark, folder, name)
    text = FIXTURES[name]
    df = spark.sql(text, **{t: table(spark, folder, t) for t in _TABLES if "{" + t + "}" in text})
    zoned = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"}
    return df.withColumns(zoned) if zoned else df


def with_fixtures(sql: str) -> str:
    """SQL for the oracle, with the fixture views that it names in front."""
    used = [f for f in FIXTURES if f in sql]
    ctes = ", ".join(f"{f} AS ({FIXTURES[f].format(**{t: t for t in _TABLES})})" for f in used)
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


class Book:
    """Queries by name, with their SQL where they have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def take(f: Query) -> Query:
            self.queries[name] = f
            if oracle:
                self.oracles[name] = with_fixtures(oracle)
            return f

        return take
