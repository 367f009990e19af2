"""Hour keys written in many notations, as minutes since 1970-01-01 UTC, independent of the session's time zone."""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_KEY = re.compile(
    r"(?:(?P<y>\d{4})[-/.]?(?P<m>\d\d)[-/.]?(?P<d>\d\d)|(?P<d2>\d\d)[-/.](?P<m2>\d\d)[-/.](?P<y2>\d{4}))[T ]?(?P<h>\d\d)(?:[:h]?(?P<mi>\d\d))?h?(?::?\d\d(?:[.]\d+)?)?"
    r" ?(?:Z|UTC|(?P<sign>[+-])(?P<oh>\d\d):?(?P<om>\d\d))?",
    re.ASCII,
)
#: White space and invisible characters that may stand around or inside a key.
_BLANK = re.compile("[\\s\u200b-\u200f\u2060\ufeff]+")


@lru_cache(maxsize=1 << 18)
def read_key(key: str) -> int | None:
    m = _KEY.fullmatch(_BLANK.sub(" ", key).strip())
    if not m:
        return None
    try:
        day = date(int(m["y"] or m["y2"]), int(m["m"] or m["m2"]), int(m["d"] or m["d2"])).toordinal() - 719163
    except ValueError:
        return None
    hour, minute = int(m["h"]), int(m["mi"] or 0)
    if minute > 59 or hour * 60 + minute > 1440:
        return None
    offset = int(m["sign"] + "1") * (int(m["oh"]) * 60 + int(m["om"])) if m["sign"] else 0
    return day * 1440 + hour * 60 + minute - offset


def _read_keys(key: pa.Array) -> pa.Array:
    d = key.dictionary_encode()
    return pa.array([read_key(k) if k is not None else None for k in d.dictionary.to_pylist()], pa.int64()).take(d.indices)


def minutes_of_key(key: Column) -> Column:
    """Minutes since the epoch (BIGINT) of a time key, null where that is null or no date.

    Understood: ``yyyyMMddHH``, ``yyyyMMddHHmm``, ISO dates and times with or without seconds, ``dd/MM/yyyy HH:mm``;
    blanks anywhere around; ``Z`` or a UTC offset at the end. Without an offset the key is UTC. Hour 24 with no minutes
    is the midnight that ends the day.

    Batches are dictionary-encoded, so each notation of an hour is read once and not once a row; as one Column the same rules overflow what the
    JVM compiles and take ten times as long. It counts as non-deterministic so that the optimizer does not copy it into filters.
    """
    return F.arrow_udf(_read_keys, LongType()).asNondeterministic()(key)


def hour_label(minutes: Column) -> Column:
    """``yyyyMMddHH`` of minutes since the epoch."""
    hour = F.floor(F.pmod(minutes, F.lit(1440)) / 60).cast("string")
    return F.concat(F.date_format(F.date_from_unix_date(F.floor(minutes / 1440).cast("int")), "yyyyMMdd"), F.lpad(hour, 2, "0"))
