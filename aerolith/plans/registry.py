"""All named queries of the core and their SQL."""

from __future__ import annotations

from . import formats, formulas, geometry, overlays, problems, rasters, relational, thermal, windfield
from .base import Query

_MODULES = (problems, relational, formulas, rasters, windfield, formats, thermal, geometry, overlays)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.ORACLES.items()}
