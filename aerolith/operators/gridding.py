"""Irregular readings onto a regular grid: an as-of merge, from both sides, of grid times and readings.

Readings are shuffled once, by source and block of ``BLOCK`` periods, and folded into their periods; each filled period then looks at its
neighbours in a window over its block, and the ends of blocks in a window over the two ends of each. No task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Periods in one window partition.
BLOCK = 4096


def regular_grid(
    readings: DataFrame,
    sources: DataFrame,
    source: str,
    minute: str,
    value: str,
    step_minutes: str,
    gap_limit_minutes: int = 360,
) -> DataFrame:
    """One row per source and grid period, from the first period with a reading to the last.

    ``readings`` has ``source``, ``minute`` (minutes since the epoch) and ``value``; ``sources`` has ``source`` (unique;
    of repeated rows the smallest step counts) and ``step_minutes``, a divisor of 1440, so periods start at 00 UTC each day.
    A reading belongs to the period that contains it, start included, end excluded.

    Result: ``source``, ``period`` (its start in minutes since the epoch), ``value`` (time-weighted linear interpolation at the
    period's start, between the last reading at or before it and the first at or after it; of the first period, its first
    reading), ``n_readings`` and ``state``: ``read`` (the period has a reading), ``filled`` (it has none; its two neighbours are
    at most ``gap_limit_minutes`` apart) or ``marked`` (it has none and the gap is wider; ``value`` is null).

    Readings with a null or NaN value, a null time or a null source are none. Repeated readings change nothing; of several readings at
    one time the smallest value counts on the right side and the largest on the left. A source without row in ``sources`` has
    no grid. Empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    steps = sources.select(F.col(source).alias("g_src"), F.col(step_minutes).cast("long").alias("g_step")).where("g_src is not null and g_step > 0").groupBy("g_src").agg(F.min("g_step").alias("g_step"))
    r = readings.select(F.col(source).alias("g_src"), F.col(minute).cast("long").alias("g_t"), F.col(value).cast("double").alias("g_v")).where("g_src is not null and g_t is not null and g_v is not null and not isnan(g_v)")
    r = r.join(steps, "g_src").withColumn("g_slot", F.floor(F.col("g_t") / F.col("g_step"))).withColumn("g_block", F.floor(F.col("g_slot") / BLOCK))
    # One shuffle, by source and block, serves the folding into periods and the look at neighbours.
    at, w = F.struct("g_t", "g_v"), Window.partitionBy("g_src", "g_block").orderBy("g_slot")
    p = r.repartition("g_src", "g_block").groupBy("g_src", "g_block", "g_slot", "g_step").agg(F.min(at).alias("g_first"), F.max(at).alias("g_last"), F.count("*").alias("n_readings"))
    p = cut(p.withColumns({"g_before": F.lag("g_last").over(w), "g_next": F.lead(F.struct("g_slot", "g_first")).over(w)}))

    # The ends of blocks, two rows each at most, look across to the ends of the blocks beside them.
    per_source = Window.partitionBy("g_src").orderBy("g_slot")
    is_end = F.col("g_before").isNull() | F.col("g_next").isNull()
    ends = p.where(is_end).withColumns(
        {"g_before": F.coalesce("g_before", F.lag("g_last").over(per_source)), "g_next": F.coalesce("g_next", F.lead(F.struct("g_slot", "g_first")).over(per_source))}
    )
    p = p.where(~is_end).unionByName(ends)
    until = F.coalesce(F.col("g_next.g_slot") - 1, F.col("g_slot"))
    g = p.select("g_src", "g_slot", "g_step", "g_first", "g_last", "n_readings", "g_before", F.col("g_next.g_first").alias("g_after"), F.explode(F.sequence("g_slot", until)).alias("g_at"))

    own = F.col("g_at") == F.col("g_slot")
    start = F.col("g_at") * F.col("g_step")
    exact = own & (F.col("g_first.g_t") == start)
    left = F.when(exact, F.col("g_first")).when(own, F.col("g_before")).otherwise(F.col("g_last"))
    right = F.when(own, F.col("g_first")).otherwise(F.col("g_after"))
    g = g.select("g_src", "g_step", "g_at", own.alias("own"), start.alias("period"), left.alias("l"), right.alias("r"), "n_readings")
    span = F.col("r.g_t") - F.col("l.g_t")
    near = span <= gap_limit_minutes
    line = F.col("l.g_v") + (F.col("r.g_v") - F.col("l.g_v")) * (F.col("period") - F.col("l.g_t")) / span
    return g.select(
        F.col("g_src").alias(source),
        "period",
        F.when(F.col("own") & (F.col("l").isNull() | (span == 0) | ~near), F.col("r.g_v")).when(near, line).alias("value"),
        F.when(F.col("own"), F.col("n_readings")).otherwise(F.lit(0)).cast("long").alias("n_readings"),
        F.when(F.col("own"), "read").when(near, "filled").otherwise("marked").alias("state"),
    )
