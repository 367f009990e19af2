"""Queries p1, p7, p8 and p9: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .encoding import encode
from .leaks import find_leaks
from .privacy import detect
from .quantiles import Universe, digests_of_latest, merge, percentiles

#: The value that stands for none in rasters.
NODATA = -9999.0
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """(site_id, day, time, y, x, utci, tmr, loaded_at), the value that stands for none as null."""
    raw = table(spark, folder, "comfort_cells", "site_id", "time", "y", "x", "utci", "tmr", "loaded_at")
    sound = lambda c: F.when(F.col(c) != NODATA, F.col(c)).alias(c)
    return raw.select("site_id", F.to_date("time").alias("day"), "time", "y", "x", sound("utci"), sound("tmr"), "loaded_at")


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    """(site_id, day, field, value), a row loaded twice once: of the loads of one key the last counts."""
    rows = _cells(spark, folder).groupBy("site_id", "day", "time", "y", "x").agg(F.max(F.struct("loaded_at", "utci", "tmr")).alias("r"))
    each = F.explode(F.array(F.struct(F.lit("utci").alias("field"), F.col("r.utci").alias("value")), F.struct(F.lit("tmr").alias("field"), F.col("r.tmr").alias("value"))))
    return rows.select("site_id", "day", each.alias("e")).select("site_id", "day", "e.field", "e.value").where("value is not null and not isnan(value)")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of utci and tmr for each site and day, and (day null) for each site over all its days, by merging the digests of its days."""
    daily = cut(digests_of_latest(_cells(spark, folder), ["site_id", "day"], ("utci", "tmr"), ["time", "y", "x"], "loaded_at"))
    whole = merge(daily, ["site_id"]).withColumn("day", F.lit(None).cast("date"))
    p = percentiles(daily.unionByName(whole), SHARES)
    return p.select("site_id", "day", "field", "n", *[F.col("percentiles")[i].alias(f"p{round(s * 100):02d}") for i, s in enumerate(SHARES)], "rank_bound")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of utci and tmr count for each site and day."""
    return _latest(spark, folder).groupBy("site_id", "day", "field").agg(F.count("value").alias("n"))


def p1_within(spark: SparkSession, folder: str) -> DataFrame:
    """For each site, day and field the number of percentiles whose rank among the values themselves is within the stated bound (and, one site over all days with it, day null)."""
    names = [f"p{round(s * 100):02d}" for s in SHARES]
    p = p1_percentiles(spark, folder).withColumnRenamed("n", "stated")
    v = _latest(spark, folder).withColumn("leaf", Universe().leaf(F.col("value")))
    v = v.unionByName(v.withColumn("day", F.lit(None).cast("date")))
    on = (v.site_id == p.site_id) & v.day.eqNullSafe(p.day) & (v.field == p.field)
    j = v.join(p, on).select(p.site_id, p.day, p.field, "leaf", "stated", "rank_bound", *[Universe().leaf(F.col(c)).alias(c) for c in names])
    below = [F.count_if(F.col("leaf") < F.col(c)).alias(f"{c}_below") for c in names]
    upto = [F.count_if(F.col("leaf") <= F.col(c)).alias(f"{c}_upto") for c in names]
    g = j.groupBy("site_id", "day", "field").agg(F.count("*").alias("n"), F.max("stated").alias("stated"), F.max("rank_bound").alias("bound"), *below, *upto)
    need = lambda s: F.greatest(F.ceil(F.col("n") * s), F.lit(1))
    good = [((F.col(f"{c}_upto") >= need(s)) & (F.col(f"{c}_below") + 1 <= need(s) + F.col("bound"))).cast("bigint") for c, s in zip(names, SHARES, strict=True)]
    return g.select("site_id", "day", "field", "n", (F.col("n") == F.col("stated")).alias("all_counted"), sum(good[1:], good[0]).alias("within"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as token ids of the 50k byte-level vocabulary."""
    return encode(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items and the documents that hold ten successive words of them: of which part, and whether the answer stands there too."""
    items = table(spark, folder, "eval_items", "item_id", "passage", "question", "answer")
    return find_leaks(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", ("passage", "question"), "answer")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_report(spark, folder).select("item_id", "doc_id")


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with typed placeholders in place of personal information."""
    return detect(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", "redacted", F.size("kinds").alias("n_found"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each email, phone number, identity number, address and name with its place."""
    d = detect(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    one = F.explode(F.arrays_zip("kinds", "starts", "ends")).alias("x")
    return d.select("doc_id", one).select("doc_id", F.col("x.kinds").alias("kind"), F.col("x.starts").alias("start_pos"), F.col("x.ends").alias("end_pos"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_counts, p1_within, p7_ids, p8_found, p8_report, p9_found, p9_redacted)}
_VALUES = """
WITH last AS (SELECT site_id, time, y, x, MAX(loaded_at) AS loaded_at FROM comfort_cells GROUP BY site_id, time, y, x),
c AS (SELECT DISTINCT site_id, time, y, x, utci, tmr FROM comfort_cells JOIN last USING (site_id, time, y, x, loaded_at)),
w AS (SELECT site_id, CAST(time AS DATE) AS day, 'utci' AS field, utci AS value FROM c UNION ALL SELECT site_id, CAST(time AS DATE), 'tmr', tmr FROM c),
v AS (SELECT * FROM w WHERE value IS NOT NULL AND NOT isnan(value) AND value <> -9999)"""
ORACLES = {
    "p1_counts": f"{_VALUES} SELECT site_id, day, field, CAST(COUNT(*) AS BIGINT) AS n FROM v GROUP BY site_id, day, field",
    "p1_within": f"""{_VALUES}
SELECT site_id, day, field, CAST(COUNT(*) AS BIGINT) AS n, TRUE AS all_counted, CAST({len(SHARES)} AS BIGINT) AS within FROM v GROUP BY site_id, day, field
UNION ALL SELECT site_id, NULL, field, CAST(COUNT(*) AS BIGINT), TRUE, CAST({len(SHARES)} AS BIGINT) FROM v GROUP BY site_id, field""",
}
