"""Readings in mixed units brought to one unit per quantity.

The unit of a reading is settled from what speaks closest to it: the row's remark, then the number itself, then what most
numbers of its feed show, then the feed's note. Notes and remarks go through the grammar of ``functions.unitgrammar``;
the numbers are held against what the station can read: pressure at its altitude, global radiation against its direct and
diffuse parts, infrared radiation of a sky, and the values that cloud cover takes on in each scale.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.unitgrammar import CANONICAL, QUANTITY_NAMES, read_note, units_in
from ..session import cut



def _factors(quantity: str, *texts: str) -> tuple[float, ...]:
    return tuple(round(units_in(t)[0].to(CANONICAL[quantity]), 9) for t in texts)


#: Factors to J/cm² of an hour, and to hPa, of the units in which stations are known to report, read by the grammar.
ENERGY = _factors("GLO", "J/cm²", "W/m²", "kJ/m²", "MJ/m²")
PRESSURE = _factors("PSTAT", "hPa", "Pa", "kPa", "inHg", "mmHg")
PA, KPA, INHG, MMHG = PRESSURE[1:]
#: Infrared radiation of a sky, J/cm² in an hour: its middle, and how far (in logarithms) a reading may be off.
INFRARED, INFRARED_OFF = 110.0, 0.85
#: Share of the horizontal direct and diffuse parts that global radiation comes to, and the sum from which it is held against them.
PARTS, PARTS_FROM = 0.975, 8.0
_FACTORS = StructType([StructField(q, DoubleType()) for q in QUANTITY_NAMES])


@F.arrow_udf(_FACTORS)
def note_factors(text: pa.Array) -> pa.Array:
    """Factors that a note names, by quantity."""
    d = text.dictionary_encode()
    read = [read_note(x) for x in d.dictionary.to_pylist()]
    known = pa.StructArray.from_arrays([pa.array([r.get(q) for r in read], pa.float64()) for q in QUANTITY_NAMES], list(QUANTITY_NAMES))
    return known.take(d.indices.fill_null(len(read))) if not d.indices.null_count else pa.concat_arrays([known, pa.array([None], known.type)]).take(d.indices.fill_null(len(read)))


def minute_of(ts: str) -> Column:
    """Minutes since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def _nearest(value: Column, factors: tuple[float, ...], expected: Column | float) -> Column:
    """The factor that brings ``value`` nearest to ``expected``, in logarithms: a comparison with the geometric means between factors."""
    order = sorted(factors)
    out = F.lit(order[-1])
    for small, great in zip(order[-2::-1], order[:0:-1], strict=True):
        out = F.when(value * math.sqrt(small * great) > expected, small).otherwise(out)
    return F.when((value > 0) & ((expected if isinstance(expected, Column) else F.lit(expected)) > 0), out)


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c)


def _vote(name: str, factor: Column, factors: tuple[float, ...]) -> list[Column]:
    return [F.count_if(factor == f).alias(f"{name}_{i}") for i, f in enumerate(factors)]


def _won(name: str, factors: tuple[float, ...]) -> Column:
    """The factor with most votes; null without votes."""
    top = F.greatest(*[F.struct(F.col(f"{name}_{i}").alias("n"), F.lit(-i), F.lit(f).alias("f")) for i, f in enumerate(factors)])
    return F.when(top["n"] > 0, top["f"])


_PERCENTS = (12, 13, 25, 37, 38, 50, 62, 63, 75, 87, 88, 100)


def resolve_units(readings: DataFrame, feeds: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each reading with its unit and canonical values.

    ``readings``: obs_id, station_id, minute (may be null), arrived (minutes, stands in for a null time), ALTI, PSTAT, INFRAR, GLO, DIR,
    DIF, N, remark. ``feeds``: feed_id, station_id, valid_from, valid_to, note. Result: obs_id, station_id, minute and for each of GLO, PSTAT, N, INFRAR
    ``x_factor`` (to J/cm² per hour, hPa, oktas, J/cm²), ``x_missing`` (null, NaN, or a number that stands for no value or
    cannot be a reading in its unit), ``x_value`` (canonical, null where missing) and ``x_raw`` (as stored); then the columns ``keep`` as they are.

    A null remark or note says nothing; a row without a feed is judged with its station's other rows without one. Of feeds that
    overlap the later one counts; of rows of one feed the least counts, repeated readings change nothing. Negative values of cloud cover and infrared radiation, and infrared 0, stand for no value.
    Empty input gives an empty result; other columns are ignored.
    """
    w = Window.partitionBy("f_station").orderBy("f_from", "feed_id")
    f = feeds.select("feed_id", F.col("station_id").alias("f_station"), minute_of("valid_from").alias("f_from"), minute_of("valid_to").alias("f_to"), "note")
    f = f.groupBy("feed_id").agg(F.min(F.struct("f_station", "f_from", "f_to", "note")).alias("f")).select("feed_id", "f.*")
    f = f.withColumn("f_to", F.least(F.coalesce("f_to", F.lit(1 << 40)), F.coalesce(F.lead("f_from").over(w), F.lit(1 << 40))))
    names = ("obs_id", "station_id", "minute", "arrived", "ALTI", "PSTAT", "INFRAR", "GLO", "DIR", "DIF", "N", "remark")
    r = readings.select(*names, *[F.col(c).alias(f"keep_{c}") for c in keep]).withColumn("at", F.coalesce("minute", "arrived"))
    spans = f.select("feed_id", "f_station", "f_from", "f_to")
    fed = lambda x: x.join(spans, (F.col("station_id") == F.col("f_station")) & (F.col("f_from") <= F.col("at")) & (F.col("at") < F.col("f_to")), "left").withColumn("feed", F.coalesce("feed_id", -F.abs("station_id") - 1))

    # What the numbers of each feed show.
    parts = F.col("DIR") + F.col("DIF")
    infrared = _present("INFRAR") & (F.col("INFRAR") > 0) & ~F.col("INFRAR").isin(999.0, 9999.0, 99999.0)
    n = F.col("N")
    evidence = (
        fed(r)
        .groupBy("feed")
        .agg(
            *_vote("glo", F.when((parts >= 20) & (F.col("GLO") > 0), _nearest(F.col("GLO"), ENERGY, parts * PARTS)), ENERGY),
            *_vote("infrar", F.when(infrared, _nearest(F.col("INFRAR"), ENERGY, INFRARED)), ENERGY),
            F.count_if((n > 0) & (n < 1)).alias("n_frac"),
            F.count_if(n.isin(*map(float, _PERCENTS))).alias("n_pct"),
            F.count_if(n == 10).alias("n_ten"),
            F.count_if(n.between(1, 10) & (n % 1 == 0)).alias("n_whole"),
            F.max(F.when(_present("GLO"), F.col("GLO"))).alias("glo_max"),
        )
    )
    noted = f.select(F.col("feed_id").alias("n_feed"), note_factors("note").alias("note"))
    judged = evidence.join(noted, F.col("feed") == F.col("n_feed"), "left")
    by_size = F.when(F.col("glo_max") > 1400, 0.1).when(F.col("glo_max") > 420, 0.36).when(F.col("glo_max") < 5, 100.0).otherwise(1.0)
    seen = F.col("n_frac") + F.col("n_pct") + F.col("n_whole")
    sky = (
        F.when(seen < 20, F.col("note.N"))
        .when(F.col("n_frac") > 0.4 * seen, 8.0)
        .when(F.col("n_pct") > 0.4 * seen, 0.08)
        .when(F.col("n_ten") > 0.015 * seen, 0.8)
        .when((F.col("note.N") == 0.8) & (seen < 100), 0.8)
        .otherwise(1.0)
    )
    # A table of its own, so that its size is known: Spark broadcasts it only while it is small.
    feed_units = judged.select(
        F.col("feed").alias("u_feed"),
        F.coalesce(_won("glo", ENERGY), F.col("note.GLO"), F.when(F.col("glo_max") > 0, by_size), F.lit(1.0)).alias("u_glo"),
        F.coalesce(_won("infrar", ENERGY), F.col("note.INFRAR"), F.lit(1.0)).alias("u_infrar"),
        F.coalesce(sky, F.lit(1.0)).alias("u_n"),
        F.col("note.PSTAT").alias("u_pstat"),
    )
    feed_units = cut(feed_units)

    # Each row.
    x = fed(r).join(feed_units, F.col("feed") == F.col("u_feed"), "left").withColumn("said", F.when(F.col("remark").isNotNull(), note_factors("remark")))
    glo_number = F.when((parts >= PARTS_FROM) & (F.col("GLO") > 0), _nearest(F.col("GLO"), ENERGY, parts * PARTS))
    glo_number = F.when((F.col("GLO") * glo_number).between(parts * (PARTS / 1.35), parts * (PARTS * 1.35)), glo_number)
    x = x.withColumn("GLO_factor", F.coalesce("said.GLO", glo_number, "u_glo"))

    v = F.col("INFRAR")
    fits = lambda c, off=INFRARED_OFF: (v * c).between(INFRARED * math.exp(-off), INFRARED * math.exp(off))
    ir_said, ir_feed = F.col("said.INFRAR"), F.col("u_infrar")
    x = x.withColumn("INFRAR_missing", ~_present("INFRAR") | (v <= 0) | v.isin(9999.0, 99999.0))
    x = x.withColumn("INFRAR_factor", F.when(F.col("INFRAR_missing"), F.coalesce(ir_said, ir_feed)).when(ir_said.isNotNull(), ir_said).when(fits(ir_feed), ir_feed).otherwise(_nearest(v, ENERGY, INFRARED)))
    x = x.withColumn("INFRAR_missing", F.col("INFRAR_missing") | ~fits(F.col("INFRAR_factor"), 1.6) | ((v == 999) & ~fits(F.col("INFRAR_factor"))))

    p = F.col("PSTAT")
    expected = 1013.25 * F.pow(1 - 2.25577e-5 * F.least(F.col("ALTI"), F.lit(9000.0)), 5.25588)
    low_unknown = F.coalesce("said.PSTAT", F.when(F.col("u_pstat").isin(MMHG, 1.0), F.col("u_pstat")), F.lit(1.0))
    by_range = F.when(p > 4000, PA).when(p > 825, 1.0).when(p > 300, low_unknown).when(p > 38, KPA).otherwise(INHG)
    by_altitude = F.when(F.col("ALTI").isNotNull() & ~F.isnan("ALTI"), _nearest(p, PRESSURE, expected))
    x = x.withColumn("PSTAT_factor", F.when(p > 0, F.coalesce(F.when((p * by_altitude).between(expected / 1.13, expected * 1.13), by_altitude), "said.PSTAT", by_range)).otherwise(1.0)).withColumn("PSTAT_missing", ~_present("PSTAT"))

    n_said, n_feed = F.col("said.N"), F.col("u_n")
    most = lambda c: F.when(c == 8.0, 1.0).when(c == 0.08, 100.0).when(c == 0.8, 10.0).otherwise(8.0)
    other = (
        F.when((n > 0) & (n < 1), 8.0)
        .when(n.isin(*map(float, _PERCENTS)), 0.08)
        .when((n == 10) & (n_feed != 0.08), 0.8)
        .when((n_feed == 8.0) & (n > 1) & (n <= 8), 1.0)
    )
    x = x.withColumn("N_factor", F.coalesce(n_said, F.when((n <= most(n_feed)) & ~((n > 0) & (n < 1)), n_feed), other, n_feed))
    x = x.withColumn("N_missing", ~_present("N") | (n < 0) | (n > most(F.col("N_factor")))).withColumn("GLO_missing", ~_present("GLO"))
    value = lambda q: F.when(~F.col(f"{q}_missing"), F.col(q) * F.col(f"{q}_factor"))
    return x.select("obs_id", "station_id", "minute", *[c for q in QUANTITY_NAMES for c in (F.col(f"{q}_factor"), F.col(f"{q}_missing"), value(q).alias(f"{q}_value"))], *[F.col(q).alias(f"{q}_raw") for q in QUANTITY_NAMES], *[F.col(f"keep_{c}").alias(c) for c in keep])


def other_units(resolved: DataFrame) -> DataFrame:
    """(obs_id, field) of each present value that is not 0 and is written in another unit than the canonical one."""
    hit = lambda q: F.when(~F.col(f"{q}_missing") & (F.col(f"{q}_raw") != 0) & (F.abs(F.col(f"{q}_factor") - 1) > 1e-9), F.lit(q))
    return resolved.select("obs_id", F.explode(F.array_compact(F.array(*map(hit, QUANTITY_NAMES)))).alias("field"))
