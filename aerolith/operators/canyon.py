"""Urban canyon energy balance: hour by hour temperatures of the air between buildings (after Bueno et al. 2013).

The model is recursive in time, so a site is one sequence; sites are independent and run side by side, as NumPy arrays in one grouped task per batch of sites.
A site's year is 8 760 rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, CP = 5.67e-8, 1004.0


@dataclass(frozen=True)
class Canyon:
    """A district: mean height (m), built share of the ground, facade to ground ratio, vegetated share, and its materials and people."""

    height: float = 15.0
    density: float = 0.4
    facade: float = 1.0
    green: float = 0.15
    albedo_road: float = 0.1
    albedo_wall: float = 0.25
    traffic: float = 20.0
    setpoint_cool: float = 24.0
    setpoint_heat: float = 20.0
    u_wall: float = 1.2
    step: float = 300.0
    layers: int = 5
    thickness: float = 0.05
    conductivity: float = 1.0
    capacity: float = 1.6e6


@dataclass(frozen=True)
class Shape:
    width: float
    aspect: float
    road_view: float
    wall_view: float
    z0: float
    displacement: float


def shape(c: Canyon) -> Shape:
    """Street width, view factors and roughness of a regular grid of blocks."""
    block = 4 * c.height * c.density / c.facade
    width = block / np.sqrt(c.density) - block
    a = c.height / width
    frontal = c.facade / 4
    d = 3 * frontal if frontal < 0.05 else 0.15 + 5.5 * (frontal - 0.05) if frontal < 0.15 else 0.7 + 0.35 * (frontal - 0.15) if frontal < 1 else 0.5
    return Shape(width, a, np.sqrt(a * a + 1) - a, 0.5 * (a + 1 - np.sqrt(a * a + 1)) / a, min(frontal, 0.15) * c.height, d * c.height)


def tridiagonal(low: np.ndarray, mid: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves tridiagonal systems along the last axis (Thomas)."""
    n = mid.shape[-1]
    c, d = np.empty_like(mid), np.empty_like(right)
    c[..., 0], d[..., 0] = high[..., 0] / mid[..., 0], right[..., 0] / mid[..., 0]
    for i in range(1, n):
        m = mid[..., i] - low[..., i] * c[..., i - 1]
        c[..., i] = high[..., i] / m
        d[..., i] = (right[..., i] - low[..., i] * d[..., i - 1]) / m
    for i in range(n - 2, -1, -1):
        d[..., i] -= c[..., i] * d[..., i + 1]
    return d


def conduct(t: np.ndarray, flux: np.ndarray, c: Canyon) -> np.ndarray:
    """Layer temperatures one step on: a flux at the surface, none below (Crank-Nicolson)."""
    n = t.shape[-1]
    r = c.conductivity * c.step / (c.capacity * c.thickness**2) / 2
    low, high = np.full_like(t, -r), np.full_like(t, -r)
    mid = np.full_like(t, 1 + 2 * r)
    low[..., 0] = high[..., -1] = 0
    mid[..., 0] = mid[..., -1] = 1 + r
    right = t.copy()
    right[..., 1:] += r * (t[..., :-1] - t[..., 1:])
    right[..., :-1] += r * (t[..., 1:] - t[..., :-1])
    right[..., 0] += flux * c.step / (c.capacity * c.thickness)
    return tridiagonal(low, mid, high, right) if n > 1 else right


def surface_flux(sun: np.ndarray, albedo: float, sky: np.ndarray, t_surface: np.ndarray, t_air: np.ndarray, wind: np.ndarray, view: float) -> np.ndarray:
    """Net flux into a surface, W/m²: sun, long wave, convection."""
    return (1 - albedo) * sun + view * (sky - SIGMA * t_surface**4) + (5.8 + 3.7 * wind) * (t_air - t_surface)


def building_heat(t_out: np.ndarray, t_wall: np.ndarray, c: Canyon) -> np.ndarray:
    """Heat that cooling and heating of rooms give off outdoors, W per m² of facade."""
    cool = np.maximum(c.u_wall * (t_wall - 273.15 - c.setpoint_cool), 0)
    heat = np.maximum(c.u_wall * (c.setpoint_heat - (t_wall - 273.15)), 0)
    return cool * (1 + 1 / 3.0) + heat * 0.2


def simulate(temperature: np.ndarray, wind: np.ndarray, sun: np.ndarray, sky: np.ndarray, c: Canyon, own: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Hourly canyon, road, wall and boundary-layer temperatures (°C) of hourly rural forcing (°C, m/s, W/m², W/m²), as (sites, hours); ``own`` overrides parts of the canyon by site."""
    own = own or {}
    n, hours = temperature.shape
    get = lambda k: own[k] if k in own else np.full(n, getattr(c, k))
    height, density, facade, green = (get(k) for k in ("height", "density", "facade", "green"))
    shapes = [shape(replace(c, height=h, density=d, facade=f)) for h, d, f in zip(height, density, facade, strict=True)]
    road_view, wall_view, z0, disp = (np.array([getattr(s, k) for s in shapes]) for k in ("road_view", "wall_view", "z0", "displacement"))
    slow = np.log((height - disp + z0) / z0) / np.log(10 * np.maximum(height, 10) / z0)
    t_rural = temperature + 273.15
    road, wall = (np.repeat(t_rural[:, :1], c.layers, 1) for _ in range(2))
    can, ubl = t_rural[:, 0].copy(), t_rural[:, 0].copy()
    steps = round(3600 / c.step)
    out = {k: np.empty((n, hours)) for k in ("canyon", "road", "wall", "ubl")}
    for h in range(hours):
        nxt = t_rural[:, min(h + 1, hours - 1)]
        depth = np.where(sun[:, h] > 150, 1000.0, 80.0)
        v = np.maximum(wind[:, h], 1.0)
        v_can = v * slow
        road_sun, wall_sun = sun[:, h] * road_view * (1 - green), sun[:, h] * wall_view
        hc, mix = 5.8 + 3.7 * v_can, 0.02 * v * 1.2 * CP
        up, side = (1 - density) * hc, facade * hc
        adv = 1.4 * v * c.step / 10000.0
        for k in range(steps):
            t = t_rural[:, h] + (nxt - t_rural[:, h]) * k / steps
            road = conduct(road, surface_flux(road_sun, c.albedo_road, sky[:, h], road[:, 0], can, v_can, road_view), c)
            wall = conduct(wall, surface_flux(wall_sun, c.albedo_wall, sky[:, h], wall[:, 0], can, v_can, road_view), c)
            waste = facade * building_heat(can, wall[:, -1], c) + c.traffic
            can = (up * road[:, 0] + side * wall[:, 0] + mix * ubl + waste) / (up + side + mix)
            ubl = (ubl + mix * (can - ubl) * c.step / (depth * 1.2 * CP) + adv * t) / (1 + adv)
        out["canyon"][:, h], out["road"][:, h], out["wall"][:, h], out["ubl"][:, h] = can - 273.15, road[:, 0] - 273.15, wall[:, 0] - 273.15, ubl - 273.15
    return out


def run_sites(forcing: DataFrame, site: str, canyon: Canyon = Canyon(), sites_per_task: int = 128) -> DataFrame:
    """(site, hour, rural, canyon, road, wall, ubl) of hourly forcing: ``site``, hour, t, wind, sun, sky. Missing values carry the last one on; columns named height, density, facade or green override the canyon's, by the site's first row.

    Sites are dealt to tasks by a hash, about ``sites_per_task`` to each, and stepped together as arrays.
    """
    kind = forcing.schema[site].dataType.simpleString()
    own = [n for n in ("height", "density", "facade", "green") if n in forcing.columns]
    tasks = max(1, -(-(forcing.select(F.approx_count_distinct(site)).first()[0] or 1) // sites_per_task))

    def kernel(t: pa.Table) -> pa.Table:
        _, at = np.unique(np.array([str(x) for x in t.column(site).to_pylist()]), return_inverse=True)
        order = np.lexsort((t.column("hour").to_numpy(), at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        n, longest = at[-1] + 1, place.max() + 1
        grids = {}
        for c in ("t", "wind", "sun", "sky"):
            g = np.full((n, longest), np.nan)
            g[at, place] = t.column(c).to_numpy().astype(float)[order]
            last = np.maximum.accumulate(np.where(np.isnan(g), 0, np.arange(longest)), axis=1)
            grids[c] = np.nan_to_num(np.take_along_axis(g, last, 1))
        first = np.searchsorted(at, np.arange(n))
        special = {c: t.column(c).to_numpy().astype(float)[order][first] for c in own}
        r = simulate(grids["t"], grids["wind"], grids["sun"], grids["sky"], canyon, special)
        hour = t.column("hour").to_numpy()[order]
        return pa.table({site: t.column(site).take(pa.array(order)), "hour": hour, "rural": grids["t"][at, place]} | {k: v[at, place] for k, v in r.items()})

    dealt = forcing.withColumn("task_", F.pmod(F.xxhash64(site), F.lit(tasks)))
    return dealt.groupBy("task_").applyInArrow(kernel, f"`{site}` {kind}, hour bigint, rural double, canyon double, road double, wall double, ubl double")
