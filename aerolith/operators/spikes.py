"""Implausible readings: spikes against a source's own course, stuck stretches, physical bounds.

A source's readings are cut into blocks of time that overlap by a margin, and each block is judged by itself, so a source
with a third of all rows is many tasks and a spike at a block's edge still sees its neighbours. In a block:

1. physical bounds, per quantity;
2. run lengths: windows of ``stuck`` successive readings whose values span no more than the quantity's tolerance;
3. a Hampel filter: rolling median of ``HALF`` readings on either side, against the rolling median absolute deviation of ``SCALE`` readings
   (moving on by half of that, so that spells with many spikes do not set their own measure). Readings beyond it are candidates; an exact check then asks that one to three successive candidates leave the line
   between their neighbours, all to one side, by ``leave`` times the source's usual step (the 90th percentile of the changes
   between successive readings), and so come back. What is found is taken out and the rest judged again, until nothing is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF, SCALE = 3, 48
HAMPEL = 2.5


@dataclass(frozen=True)
class Quantity:
    """What is known of a measured quantity. ``tick``: its resolution; ``stuck_ticks``: how many ticks a stuck stretch may span; ``free``: a value at which it may stay;
    ``leave``: by how many usual steps a spike leaves the course, chosen in the gap between weather and faults that the quantity's departures show."""

    name: str
    low: float
    high: float
    tick: float
    stuck_ticks: int = 0
    free: float | None = None
    least_step: float = 0.5
    leave: float = 3.8
    not_above: str | None = None


#: Air temperature, dew point (°C), relative humidity (%), wind speed (m/s) at ground stations.
GROUND_STATION = (
    Quantity("T", -60.0, 60.0, 0.1, 1, None, 0.8, 3.3),
    Quantity("TD", -75.0, 45.0, 0.1, 1, None, 0.8, 3.35, not_above="T"),
    Quantity("U", 0.0, 100.0, 1.0, 0, 100.0, 3.0, 3.0),
    Quantity("FF", 0.0, 75.0, 0.1, 0, 0.0, 0.6, 4.3),
)


@dataclass(frozen=True)
class Plan:
    quantities: tuple[Quantity, ...] = GROUND_STATION
    stuck: int = 10
    block_minutes: int = 256 * 1440
    margin_minutes: int = 16 * 1440
    longest: int = 3
    fewest: int = 8


def stuck_mask(values: np.ndarray, q: Quantity, n: int) -> np.ndarray:
    """True where a value lies in a window of ``n`` successive values that stays within the tolerance and off the free value."""
    out = np.zeros(len(values), bool)
    if len(values) < n:
        return out
    ticks = np.round(values / q.tick)
    w = sliding_window_view(ticks, n)
    hit = (w.max(1) - w.min(1)) <= q.stuck_ticks
    if q.free is not None:
        hit &= w[:, 0] != round(q.free / q.tick)
    edge = np.zeros(len(values) + 1, int)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def hampel(values: np.ndarray, floor: float) -> np.ndarray:
    """Distance of each value to the rolling median, in robust standard deviations of the ``SCALE`` readings around it (``floor / 3`` at least)."""
    k = min(HALF, (len(values) - 1) // 2)
    if k < 1:
        return np.zeros(len(values))
    w = sliding_window_view(np.pad(values, k, mode="reflect"), 2 * k + 1)
    off = np.abs(values - np.partition(w, k, axis=1)[:, k])
    if len(off) <= SCALE:
        return off / max(1.4826 * np.median(off), floor / 3)
    hop = SCALE // 2
    some = sliding_window_view(off, SCALE)[::hop]
    spread = np.median(some, axis=1)
    nearest = np.clip((np.arange(len(off)) - hop + hop // 2) // hop, 0, len(spread) - 1)
    return off / np.maximum(1.4826 * spread, floor / 3)[nearest]


def spike_mask(times: np.ndarray, values: np.ndarray, q: Quantity, longest: int, fewest: int) -> np.ndarray:
    """True where one to ``longest`` successive values leave the course and come back."""
    out = np.zeros(len(values), bool)
    if len(values) < fewest:
        return out
    step = max(np.quantile(np.abs(np.diff(values)), 0.9), q.least_step)
    need = q.leave * step
    alive = np.arange(len(values))
    while True:  # every round but the last takes readings out
        v, t = values[alive], times[alive]
        n = len(v)
        if n < fewest:
            break
        cand = np.append(hampel(v, q.least_step) > HAMPEL, np.zeros(longest, bool))
        best, size = np.zeros(n), np.zeros(n, int)
        for k in range(1, longest + 1):
            i = np.flatnonzero(cand[1 : n - k]) + 1
            for j in range(1, k):
                i = i[cand[i + j]]
            if not len(i):
                continue
            a, b, ta, tb = v[i - 1], v[i + k], t[i - 1], t[i + k]
            d = np.stack([v[i + j] - (a + (b - a) * (t[i + j] - ta) / np.maximum(tb - ta, 1)) for j in range(k)])
            off = np.where(np.abs(np.sign(d).sum(0)) == k, np.abs(d).min(0), 0)
            up = (off > need) & (off > best[i])
            best[i[up]], size[i[up]] = off[up], k
        # A reading at either end of the block has one neighbour only; the margins cover inner ends.
        found = np.flatnonzero(size)
        if not len(found):
            break
        taken, gone = np.zeros(n + 2 * longest + 8, bool), []
        for c in found[np.argsort(-best[found], kind="stable")]:
            lo, hi = max(c - longest - 1, 0), c + size[c] + longest + 1
            if not taken[lo:hi].any():
                taken[lo:hi] = True
                gone.append(np.arange(c, c + size[c]))
        gone = np.concatenate(gone)
        out[alive[gone]] = True
        alive = np.delete(alive, gone)
    return out


def judge(times: np.ndarray, columns: dict[str, np.ndarray], plan: Plan) -> dict[str, np.ndarray]:
    """Reasons (0 none, 1 bound, 2 stuck, 3 spike, 4 above another quantity) of each reading; ``times`` ascending, NaN is no reading."""
    out: dict[str, np.ndarray] = {}
    for q in plan.quantities:
        x = columns[q.name]
        why = np.zeros(len(x), np.int8)
        with np.errstate(invalid="ignore"):
            why[(x < q.low) | (x > q.high)] = 1
        have = np.flatnonzero(~np.isnan(x))
        s = have[stuck_mask(x[have], q, plan.stuck)]
        why[s[why[s] == 0]] = 2
        sound = have[why[have] == 0]
        why[sound[spike_mask(times[sound], x[sound], q, plan.longest, plan.fewest)]] = 3
        if q.not_above:
            with np.errstate(invalid="ignore"):
                over = (x > columns[q.not_above] + q.tick / 2) & (out[q.not_above] == 0)
            why[over & (why == 0)] = 4
        out[q.name] = why
    return out


REASONS = ("", "bound", "stuck", "spike", "above")


def _unordered(plan: Plan) -> Column:
    """What can be said of a row by itself: an array of (field, reason)."""
    out = []
    for q in plan.quantities:
        x = F.col(q.name)
        there = x.isNotNull() & ~F.isnan(x)
        code = F.when(there & ((x < q.low) | (x > q.high)), "bound")
        if q.not_above:
            o = next(p for p in plan.quantities if p.name == q.not_above)
            code = code.when(there & F.col(o.name).between(o.low, o.high) & (x > F.col(o.name) + q.tick / 2), "above")
        out.append(F.struct(F.lit(q.name).alias("field"), code.alias("reason")))
    return F.array(*out)


def flag_implausible(df: DataFrame, row_id: str, source: str, minute: str, plan: Plan = Plan()) -> DataFrame:
    """One row per wrong value: ``row_id``, ``field`` and ``reason`` (bound, stuck, spike, above).

    ``df`` has ``row_id``, ``source``, ``minute`` (minutes since the epoch) and the columns of ``plan.quantities``. Successive means in
    order of time within the source, nulls and NaN skipped; rows with the same time and the same values are deliveries of one
    reading: judged once, each row listed. Readings of one time that differ count as successive, in order of their values. A silence longer than the margin may end a course at a block's edge.
    A quantity with ``not_above`` is wrong where it exceeds a sound value of that other quantity in its row.

    Rows without a time or a source have no order and are held against the bounds (and ``not_above``) only. Null values are never
    flagged. Empty input gives an empty result; other columns are ignored.
    """
    names = [q.name for q in plan.quantities]
    id_type = df.schema[row_id].dataType.simpleString()
    base = df.select(F.col(row_id).alias("r_id"), F.col(source).alias("r_src"), F.col(minute).cast("long").alias("r_t"), *[F.col(n).cast("double").alias(n) for n in names])

    untimed = base.where("r_t is null or r_src is null").select("r_id", F.explode(_unordered(plan)).alias("w")).where("w.reason is not null").select("r_id", "w.field", "w.reason")

    b, m = plan.block_minutes, plan.margin_minutes
    timed = base.where("r_t is not null and r_src is not null").withColumn("r_own", F.floor(F.col("r_t") / b))
    into = F.col("r_t") - F.col("r_own") * b
    blocks = F.array(F.col("r_own"), F.when(into < m, F.col("r_own") - 1), F.when(into >= b - m, F.col("r_own") + 1))
    timed = timed.withColumn("r_block", F.explode(F.array_compact(blocks)))

    def kernel(block: pa.Table) -> pa.Table:
        column = {c: block.column(c).to_numpy() for c in ("r_own", "r_block", "r_t", "r_id", *names)}
        own = column["r_own"] == column["r_block"]
        ids, fields, reasons = [column["r_id"][:0]], [np.empty(0, np.int8)], [np.empty(0, np.int8)]
        if own.any():
            x = np.stack([column[n].astype(float) for n in names], axis=1)
            t = column["r_t"]
            order = np.lexsort((*x.T[::-1], t))
            x, t, own = x[order], t[order], own[order]
            same = np.zeros(len(t), bool)
            same[1:] = (t[1:] == t[:-1]) & ((x[1:] == x[:-1]) | (np.isnan(x[1:]) & np.isnan(x[:-1]))).all(1)
            lead = np.flatnonzero(~same)
            member = np.cumsum(~same) - 1
            said = judge(t[lead], {n: x[lead, i] for i, n in enumerate(names)}, plan)
            for i, n in enumerate(names):
                code = said[n][member]
                hit = np.flatnonzero((code > 0) & own)
                ids.append(column["r_id"][order][hit])
                fields.append(np.full(len(hit), i, np.int8))
                reasons.append(code[hit])
        return pa.table({"r_id": pa.array(np.concatenate(ids), block.schema.field("r_id").type), "f": np.concatenate(fields), "w": np.concatenate(reasons)})

    judged = timed.groupBy("r_src", "r_block").applyInArrow(kernel, f"r_id {id_type}, f tinyint, w tinyint")
    word = lambda code, words: F.element_at(F.array(*map(F.lit, words)), F.col(code).cast("int") + 1)
    judged = judged.select("r_id", word("f", names).alias("field"), word("w", REASONS).alias("reason")).unionByName(untimed)
    return judged.withColumnRenamed("r_id", row_id)
