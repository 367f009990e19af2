"""Wind directions, bins, profiles and obstacle zones as column expressions (Röckle's parametrisation and its published successors)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import COMPASS


def compass(degrees: Column) -> Column:
    """One of 16 names."""
    return F.element_at(F.array(*map(F.lit, COMPASS)), F.pmod(F.floor(degrees / 22.5 + 0.5), F.lit(16)).cast("int") + 1)


def speed_bin(speed: Column, step: int = 1) -> Column:
    low = (F.floor(speed / step) * step).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + step).cast("string"))


def direction_of(east: Column, north: Column) -> Column:
    """Radians from east, counter-clockwise; with no eastward part the quarter turns come from the sign alone (π up, 2π down, 0 at rest)."""
    a = F.when(east == 0, 0.0).otherwise(F.atan(F.try_divide(north, east)))
    return a + F.when((east <= 0) & (north > 0), math.pi).when((east < 0) & (north <= 0), math.pi).when((east >= 0) & (north < 0), 2 * math.pi).otherwise(0.0)


def to_degrees(rad: Column, origin: float = 90.0) -> Column:
    """Clockwise degrees from ``origin``, 0 .. 360."""
    d = 360 - F.degrees(rad) + origin
    return F.when(d > 360, d - 360).when(d < 0, d + 360).otherwise(d)


def power_profile(v_ref: Column, z: Column, z_ref: float, z0: Column) -> Column:
    return v_ref * F.pow(z / z_ref, 0.12 * z0 + 0.18)


def log_scale(x: Column, z: float = 1.5, z_ref: float = 10.0, z0: float = 0.01) -> Column:
    """A speed at ``z`` brought to ``z_ref`` along a logarithmic profile."""
    return x * math.log(z_ref / z0) / math.log(min(z, z_ref) / z0)


def zone_lengths(width: Column, length: Column, height: Column) -> dict[str, Column]:
    """Displacement, vortex, cavity and wake lengths, rooftop height, centre and length of an obstacle."""
    r = 0.67 * F.least(height, width) + 0.33 * F.greatest(height, width)
    cavity = 1.8 * width / (F.pow(length / height, 0.3) * (1 + 0.24 * width / height))
    return {
        "displacement": 1.5 * width / (1 + 0.8 * width / height),
        "vortex": 0.6 * width / (1 + 0.8 * width / height),
        "cavity": cavity,
        "wake": 3 * cavity,
        "roof_height": 0.22 * r,
        "roof_length": 0.9 * r,
        "corner": 1 + 0.05 * width / height,
    }


def roughness(lambda_f: Column, mean_height: Column) -> tuple[Column, Column]:
    """Roughness length and displacement height of a frontal density (Hanna and Britter)."""
    lf = F.least(lambda_f, F.lit(1.0))
    z0 = F.when(lambda_f <= 0.15, lambda_f * mean_height).otherwise(0.15 * mean_height)
    d = F.when(lambda_f <= 0.05, 3 * lambda_f * mean_height).when(lambda_f <= 0.15, (0.15 + 5.5 * (lambda_f - 0.05)) * mean_height).otherwise((0.7 + 0.35 * (lf - 0.15)) * mean_height)
    return z0, d


def walking_speed(slope: Column) -> Column:
    """km/h on a slope given as its tangent (Tobler)."""
    return 6 * F.exp(-3.5 * F.abs(slope + 0.05))
