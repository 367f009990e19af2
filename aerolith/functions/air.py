"""Moist air, sun and canyon formulas as column expressions (published engineering equations)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def saturation_pressure(celsius: Column, sign: float = -1.0) -> Column:
    """Saturation pressure over water, kPa (Hyland and Wexler)."""
    t = celsius + 273.15
    return F.exp(-5.8002206e3 / t + 1.3914993 + sign * 4.8640239e-2 * t + 4.1764768e-5 * F.pow(t, 2) - 1.4452093e-8 * F.pow(t, 3) + 6.5459673 * F.ln(t)) / 1000


def humidity_ratio(rh: Column, celsius: Column, pascal: Column) -> Column:
    """kg of water per kg of dry air."""
    pw = rh * saturation_pressure(celsius) * 1000 / 100
    return 0.62198 * pw / (pascal - pw)


def partial_pressure(w: Column, kilopascal: Column) -> Column:
    return w * kilopascal / (0.621945 + w)


def relative_humidity(celsius: Column, w: Column, pascal: Column) -> Column:
    return partial_pressure(w, pascal / 1000) / saturation_pressure(celsius) * 100


def enthalpy(celsius: Column, w: Column) -> Column:
    """J per kg of dry air."""
    return 1006.0 * celsius + w * (2501000.0 + 1860.0 * celsius)


def specific_volume(celsius: Column, w: Column, pascal: Column) -> Column:
    return 0.287042 * (celsius + 273.15) * (1 + 1.607858 * w) / (pascal / 1000)


def dew_point(w: Column, pascal: Column) -> Column:
    """°C, for dew points between 0 and 93."""
    p = partial_pressure(w, pascal / 1000)
    a = F.ln(p)
    return 6.54 + 14.526 * a + 0.7389 * F.pow(a, 2) + 0.09486 * F.pow(a, 3) + 0.4569 * F.pow(p, 0.1984)


def air_density(pascal: Column, kelvin: Column, w: Column) -> Column:
    return pascal / (1000 * 0.287042 * kelvin * (1.0 + 1.607858 * w))


def sky_infrared(infrar: Column, t: Column, td: Column, oktas: Column) -> Column:
    """W/m²: the reading (J/cm² in an hour) where there is one, else the Clark-Allen emissivity with a cubic in cloud tenths."""
    eps = F.least(F.greatest(F.coalesce(0.787 + 0.764 * F.ln((td + 273.15) / 273.15), F.lit(0.7)), F.lit(0.1)), F.lit(1.0))
    n = okta_tenths(oktas)
    return F.coalesce(infrar * (1e4 / 3600), eps * (1 + 0.0224 * n - 0.0035 * n * n + 0.00028 * n * n * n) * 5.67e-8 * F.pow(t + 273.15, 4))


def okta_tenths(oktas: Column) -> Column:
    """Tenths of cloud cover, 9 oktas (sky not seen) as 99; halves to the even number."""
    return F.when(oktas == 9, 99).otherwise(F.rint(F.least(F.greatest(oktas / 8 * 10, F.lit(0.0)), F.lit(10.0)))).cast("int")


def declination(day_of_year: Column) -> Column:
    """Radians (Spencer's series)."""
    g = 2 * math.pi * (day_of_year - 1) / 365
    return 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)


def equation_of_time(day_of_year: Column) -> Column:
    """Minutes."""
    g = 2 * math.pi * (day_of_year - 1) / 365
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def zenith(day_of_year: Column, utc_hour: Column, lat: Column | float, lon: Column | float) -> Column:
    """Solar zenith, radians."""
    lat = lat if isinstance(lat, Column) else F.lit(float(lat))
    lon = lon if isinstance(lon, Column) else F.lit(float(lon))
    d = declination(day_of_year)
    h = F.radians((utc_hour * 60 + equation_of_time(day_of_year) + 4 * lon) / 4 - 180)
    return F.acos(F.sin(F.radians(lat)) * F.sin(d) + F.cos(F.radians(lat)) * F.cos(d) * F.cos(h))
