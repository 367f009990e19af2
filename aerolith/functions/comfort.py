"""Outdoor comfort: indices and indicators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ppd(pmv: Column) -> Column:
    """Predicted percentage of dissatisfied (ISO 7730) of a predicted mean vote, votes below 0 counting as 0."""
    v = F.greatest(pmv, F.lit(0.0))
    return 100 - 95 * F.exp(-0.03353 * F.pow(v, 4) - 0.2179 * F.pow(v, 2))


def on_line(x: Column, x0: float | Column, x1: float | Column, y0: float, y1: float) -> Column:
    """The line through (x0, y0) and (x1, y1)."""
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def utci_to_pmv(utci: Column) -> Column:
    return on_line(utci, 26.0, 42.0, 0.5, 3.0)


def shade_ppd(share: Column, full: Column | float) -> Column:
    """Dissatisfaction with a shaded share (0 .. 1), where ``full`` percent of shade would satisfy."""
    return ppd(3 - 2.5 * F.try_divide(100 * share, full if isinstance(full, Column) else F.lit(float(full))))


def wanted_shade(utci_sun: Column, low: float = 2.0, high: float = 25.0, cool: float = 26.0, hot: float = 38.0) -> Column:
    """Percent of shade wanted at a UTCI in the sun."""
    return on_line(utci_sun, cool, hot, low, high)


def comfort_indicator(share: Column, utci_shade: Column, utci_sun: Column) -> Column:
    """The worse of the two dissatisfactions: with the UTCI in the shade, and with the share of shade (5 where all is shaded or the sun is cool).

    The share is scaled to percent twice, as in the published tool whose figures this reproduces.
    """
    by_shade = F.when(100 * share == 100, 5.0).when(utci_sun < 26, 5.0).otherwise(shade_ppd(100 * share, wanted_shade(utci_sun)))
    return F.greatest(ppd(utci_to_pmv(utci_shade)), by_shade)


def comfort_class(utci: Column) -> Column:
    """0 .. 4 by the steps 26, 32, 38, 46; null for null."""
    return F.when(utci < 26, 0).when(utci < 32, 1).when(utci < 38, 2).when(utci < 46, 3).when(utci.isNotNull(), 4)


def comfort_class_fraction(utci: Column) -> Column:
    """The same steps with the place inside a step (from 9, up to 60)."""
    return F.when(utci < 26, on_line(utci, 9, 26, 0, 1)).when(utci < 32, on_line(utci, 26, 32, 1, 2)).when(utci < 38, on_line(utci, 32, 38, 2, 3)).when(utci < 46, on_line(utci, 38, 46, 3, 4)).otherwise(on_line(utci, 46, 60, 4, 5))


def comfort_category(utci: Column) -> Column:
    return F.when(utci > 32, 2).when(utci < 28, 0).otherwise(1)


def vapour_pressure(t: Column) -> Column:
    """Saturation vapour pressure over water, hPa, of °C (Hardy 1998), as the UTCI procedure prescribes."""
    k = t + 273.15
    # The coefficients of powers -2 .. 4, and of the logarithm.
    g = (-2836.5744, -6028.076559, 19.54263612, -0.02737830188, 0.000016261698, 7.0229056e-10, -1.8680009e-13)
    total = 2.7150305 * F.ln(k)
    for i, c in enumerate(g):
        total = total + c * F.pow(k, i - 2)
    return F.exp(total) * 0.01
