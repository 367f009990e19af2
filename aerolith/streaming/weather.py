"""Hourly weather as a stream: late readings within a watermark, repeated deliveries once, hourly means per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(readings: DataFrame, lateness: str = "6 hours", value: str = "T") -> DataFrame:
    """(station_id, hour, mean, n) of a stream of station_id, at (TIMESTAMP), ``value``: an hour comes out once the watermark has passed it.

    Readings later than ``lateness`` are left out; a reading of one station and time counts once, whichever delivery comes first; null and NaN values are no readings.
    """
    r = readings.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col("at").isNotNull()).withWatermark("at", lateness)
    once = r.dropDuplicatesWithinWatermark(["station_id", "at"])
    w = once.groupBy("station_id", F.window("at", "1 hour").alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return w.select("station_id", F.col("w.start").alias("hour"), "mean", "n")


def write_hours(hours: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts the stream into a table under ``path``; both folders lie where all executors reach them. ``once``: take what is there and stop."""
    w = hours.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
