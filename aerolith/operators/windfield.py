"""An initial wind field around obstacles, and its mass-consistent correction.

Obstacles are blocks in a frame in which the wind comes from the north: id, xmin, ymin, xmax, ymax, h. Each block has zones around it; a zone generates the
grid points in its bounds (no join with the grid), keeps those inside by the zone's shape, and knows where in the zone each lies. Levels are generated the same way
below each point's ceiling. Zones that meet at a cell are settled by one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.wind import zone_lengths
from ..session import cut
from .joins import merged

MESH, DZ = 5.0, 5.0
#: Priority of zones at a cell; wakes only weaken what others say.
PRIORITY = {"canyon": 1, "cavity": 2, "rooftop": 3, "vortex": 4, "displacement": 5}


def measured(blocks: DataFrame) -> DataFrame:
    """Blocks with the lengths of their zones; blocks without a height are none."""
    b = blocks.where("h IS NOT NULL AND h > 0 AND xmax > xmin AND ymax > ymin")
    return b.withColumns(zone_lengths(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.col("h")))


def _generated(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """Grid points (i, j, x, y at cell centres) inside bounds."""
    first, last = lambda v: F.ceil(v / MESH - 0.5), lambda v: F.floor(v / MESH - 0.5)
    some = df.withColumns({"i0": first(x0), "i1": last(x1), "j0": first(y0), "j1": last(y1)}).where("i0 <= i1 AND j0 <= j1")
    g = some.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1"))).drop("i0", "i1", "j0", "j1")
    return g.withColumns({"x": (F.col("i") + 0.5) * MESH, "y": (F.col("j") + 0.5) * MESH})


def _across() -> Column:
    """Place across the facade, -1 .. 1."""
    return (F.col("x") - (F.col("xmin") + F.col("xmax")) / 2) / ((F.col("xmax") - F.col("xmin")) / 2)


def upstream_zone(m: DataFrame, length: str) -> DataFrame:
    """Half ellipse before the north facade: points with ``r``, their squared distance from its middle, 0 .. 1."""
    g = _generated(m, F.col("xmin"), F.col("xmax"), F.col("ymax"), F.col("ymax") + F.col(length))
    r = F.pow(_across(), 2) + F.pow((F.col("y") - F.col("ymax")) / F.col(length), 2)
    return g.withColumns({"r": r, "y_wall": F.col("ymax"), "dy": F.col("y") - F.col("ymax")}).where("r <= 1")


def downstream_zone(m: DataFrame, length: str) -> DataFrame:
    """Half ellipse behind the south facade: points with ``dy``, the distance from the wall, and ``r``, its share of the zone's length there."""
    g = _generated(m, F.col("xmin"), F.col("xmax"), F.col("ymin") - F.col(length), F.col("ymin"))
    g = g.withColumns({"reach": F.col(length) * F.sqrt(F.greatest(1 - F.pow(_across(), 2), F.lit(0.0))), "dy": F.col("ymin") - F.col("y"), "y_wall": F.col("ymin")})
    return g.withColumn("r", F.try_divide("dy", "reach")).where("dy <= reach AND reach > 0")


def roof_zone(m: DataFrame) -> DataFrame:
    """Points on the roof within the perpendicular zone's length of the north edge."""
    g = _generated(m, F.col("xmin"), F.col("xmax"), F.greatest(F.col("ymin"), F.col("ymax") - F.col("roof_length")), F.col("ymax"))
    return g.withColumns({"y_wall": F.col("ymax"), "dy": F.col("ymax") - F.col("y"), "r": (F.col("ymax") - F.col("y")) / F.col("roof_length")})


def canyon_pairs(m: DataFrame) -> DataFrame:
    """(id, next_id, h, xmin, xmax, y0, y1): ground between a block and the next one inside its cavity."""
    size = 64.0
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    up = m.withColumn("cx", cells(F.col("xmin"), F.col("xmax"))).withColumn("cy", cells(F.col("ymin") - F.col("cavity"), F.col("ymin"))).alias("a")
    down = m.withColumn("cx", cells(F.col("xmin"), F.col("xmax"))).withColumn("cy", F.floor(F.col("ymax") / size)).alias("b")
    meet = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.id") != F.col("b.id")) & (F.col("a.xmin") < F.col("b.xmax")) & (F.col("b.xmin") < F.col("a.xmax"))
    gap = F.col("a.ymin") - F.col("b.ymax")
    x0, x1 = F.greatest("a.xmin", "b.xmin"), F.least("a.xmax", "b.xmax")
    here = F.floor(x0 / size) == F.col("a.cx")
    return up.join(merged(down), meet).where((gap > 0) & (gap < F.col("a.cavity")) & here).select(F.col("a.id").alias("id"), F.col("b.id").alias("next_id"), F.least("a.h", "b.h").alias("h"), x0.alias("xmin"), x1.alias("xmax"), F.col("b.ymax").alias("y0"), F.col("a.ymin").alias("y1"))


def canyon_zone(m: DataFrame) -> DataFrame:
    """Ground of canyons: points with ``r``, their place between the walls."""
    g = _generated(canyon_pairs(m), F.col("xmin"), F.col("xmax"), F.col("y0"), F.col("y1"))
    return g.withColumns({"y_wall": F.col("y1"), "dy": F.col("y1") - F.col("y"), "gap": F.col("y1") - F.col("y0")}).withColumn("r", F.col("dy") / F.col("gap"))


def levelled(points: DataFrame, ceiling: Column) -> DataFrame:
    """Points with every level (k, z at cell centres) below ``ceiling``."""
    p = points.withColumn("kmax", F.ceil(ceiling / DZ - 0.5) - 1).where("kmax >= 0")
    return p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "kmax"))).withColumn("z", (F.col("k") + 0.5) * DZ).drop("kmax")


def factors(m: DataFrame) -> DataFrame:
    """(i, j, k, zone, id, next_id, y_wall, h, u, v, w): the share of the reference speed that each zone gives each of its cells; ``v`` runs south. ``next_id`` is the block at a canyon's end."""
    h, z, r = F.col("h"), F.col("z"), F.col("r")
    disp = levelled(upstream_zone(m, "displacement"), 0.6 * h * F.sqrt(1 - r))
    vort = levelled(upstream_zone(m, "vortex"), 0.5 * h * F.sqrt(1 - r))
    cav = levelled(downstream_zone(m, "cavity"), h * F.sqrt(1 - r * r))
    can = levelled(canyon_zone(m), h)
    roof = levelled(roof_zone(m), h + F.col("roof_height")).where("z > h")
    edge = F.sqrt(F.greatest(1 - F.pow(z / h, 2), F.lit(1e-9)))
    zero = F.lit(0.0)
    parts = {
        "displacement": (disp, 0.4 * F.pow(z / h, 0.16), zero),
        "vortex": (vort, -(0.6 * F.cos(np.pi * z / (0.5 * h)) + 0.05) * 0.6 * F.sin(np.pi * r), -0.1 * F.cos(np.pi * r) - 0.05),
        "cavity": (cav, -F.pow(1 - F.least(r / edge, F.lit(1.0)), 2), zero),
        "canyon": (can, -4 * r * (1 - r), -(0.5 * F.abs(1 - 2 * r)) * (1 - 2 * (1 - r))),
        "rooftop": (roof, -F.pow((h + F.col("roof_height") - z) / 10.0, 0.16) * F.abs(h + F.col("roof_height") - z) / F.col("roof_height"), zero),
    }
    out = None
    for name, (df, v, w) in parts.items():
        end = F.col("next_id") if name == "canyon" else F.lit(None).cast(m.schema["id"].dataType)
        one = df.select("i", "j", "k", F.lit(name).alias("zone"), "id", end.alias("next_id"), "y_wall", "h", zero.alias("u"), v.alias("v"), w.alias("w"))
        out = one if out is None else out.unionByName(one)
    return out


def wake_factors(m: DataFrame) -> DataFrame:
    """(i, j, k, y_wall, h, v): how much of the speed is left in wakes, beyond the cavity."""
    x = downstream_zone(m, "wake").withColumn("near", F.col("reach") / 3).where("dy > near")
    x = levelled(x, F.col("h") * F.sqrt(1 - F.pow(F.col("r"), 2)))
    v = 1 - F.pow(F.col("near") / F.col("dy"), 1.5) * F.pow(F.sqrt(1 - F.pow(F.col("z") / F.col("h"), 2)), 1.5)
    return x.select("i", "j", "k", "y_wall", "h", v.alias("v"))


def superimposed(zones: DataFrame, wakes: DataFrame) -> DataFrame:
    """One row per cell: the zone most upstream, then highest, then by priority; times the least of the wakes that begin further upstream; where there is only a wake, that."""
    rank = F.lit(99)
    for name, p in PRIORITY.items():
        rank = F.when(F.col("zone") == name, p).otherwise(rank)
    best = F.max(F.struct("y_wall", "h", (-rank).alias("p"), "zone", "u", "v", "w")).alias("b")
    z = zones.groupBy("i", "j", "k").agg(best)
    wk = wakes.groupBy("i", "j", "k").agg(F.max(F.struct("y_wall", "h", "v")).alias("wk"))
    x = z.join(wk, ["i", "j", "k"], "full")
    weaker = F.col("b").isNotNull() & F.col("wk").isNotNull() & ((F.col("wk.y_wall") > F.col("b.y_wall")) | ((F.col("wk.y_wall") == F.col("b.y_wall")) & (F.col("wk.h") > F.col("b.h"))))
    f = F.when(weaker, F.col("wk.v")).otherwise(1.0)
    return x.select("i", "j", "k", F.coalesce("b.zone", F.lit("wake")).alias("zone"), F.coalesce(F.col("b.u") * f, F.lit(0.0)).alias("u"), F.coalesce(F.col("b.v") * f, "wk.v").alias("v"), F.coalesce(F.col("b.w"), F.lit(0.0)).alias("w"))


def backward_facades(m: DataFrame) -> DataFrame:
    """(id, next_id, i, j, k, gap, y_back, h_back): the last cells of canyons where the cavity of the block before stands above the block behind, and the level above that block's roof.
    The flow over the roof is then turned back."""
    last = canyon_zone(m).groupBy("id", "next_id", "i").agg(F.min("j").alias("j"), F.first("x").alias("x"), F.first("gap").alias("gap"))
    before = m.select("id", F.col("h").alias("above"), "cavity", "xmin", "xmax", "ymin")
    behind = m.select(F.col("id").alias("next_id"), F.col("h").alias("below"), F.col("ymax").alias("y_back"))
    x = last.join(merged(before), "id").join(merged(behind), "next_id")
    x = x.withColumns({"reach": F.col("cavity") * F.sqrt(F.greatest(1 - F.pow(_across(), 2), F.lit(0.0))), "dy": F.col("ymin") - (F.col("j") + 0.5) * MESH, "h_back": F.least("above", "below")})
    top = F.col("above") * F.sqrt(F.greatest(1 - F.pow(F.try_divide("dy", "reach"), 2), F.lit(0.0)))
    return x.where((F.col("dy") <= F.col("reach")) & (top > F.col("h_back"))).select("id", "next_id", "i", "j", F.floor(F.col("h_back") / DZ).alias("k"), "gap", "y_back", "h_back")


def without_turned(zones: DataFrame, facades: DataFrame) -> DataFrame:
    """``zones`` without the canyons, and the roofs behind them, over which the flow is turned back."""
    turned = facades.select("id", "next_id", "i").distinct()
    canyon = turned.select(F.lit("canyon").alias("zone"), "id", "next_id", "i")
    roof = turned.select(F.lit("rooftop").alias("zone"), F.col("next_id").alias("id"), F.lit(None).cast(turned.schema["id"].dataType).alias("next_id"), "i").distinct()
    gone = canyon.unionByName(roof).alias("g")
    z = zones.alias("z")
    same = (F.col("z.zone") == F.col("g.zone")) & (F.col("z.id") == F.col("g.id")) & (F.col("z.i") == F.col("g.i")) & F.col("z.next_id").eqNullSafe(F.col("g.next_id"))
    return z.join(merged(gone), same, "left_anti")


def backward(m: DataFrame, facades: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, j, k, zone, u, v, w): cavities and wakes of the blocks over which the flow is turned back, mirrored to their north walls, times the speed found above the roof's edge."""
    at = cells.select("i", "j", "k", F.abs("v").alias("weight"))
    f = facades.join(merged(at), ["i", "j", "k"]).select("next_id", "i", F.col("j").alias("j_wall"), "gap", "y_back", "h_back", "weight")

    def mirrored(points: DataFrame) -> DataFrame:
        p = points.select(F.col("id").alias("next_id"), "i", "dy", "r", "reach", "h").join(merged(f), ["next_id", "i"]).where(F.col("dy") < F.col("gap") + MESH)
        return p.withColumn("j", F.col("j_wall") + F.floor(F.col("dy") / MESH))

    h, z = F.col("h"), F.col("z")
    edge = F.sqrt(F.greatest(1 - F.pow(z / h, 2), F.lit(1e-9)))
    cav = levelled(mirrored(downstream_zone(m, "cavity")), h * F.sqrt(1 - F.pow("r", F.lit(2))))
    wake = mirrored(downstream_zone(m, "wake")).withColumn("near", F.col("reach") / 3).where("dy > near")
    wake = levelled(wake, h * F.sqrt(1 - F.pow("r", F.lit(2))))
    # upstream is south here, so walls and heights count the other way round
    key = [(-F.col("y_back")).alias("y_wall"), (-F.col("h_back")).alias("h")]
    zero = F.lit(0.0)
    c = cav.select("i", "j", "k", F.lit("cavity").alias("zone"), *key, zero.alias("u"), (F.pow(1 - F.least(F.col("r") / edge, F.lit(1.0)), 2) * F.col("weight")).alias("v"), zero.alias("w"))
    k = wake.select("i", "j", "k", *key, ((-1 + F.pow(F.col("near") / F.col("dy") * edge, 1.5)) * F.col("weight")).alias("v"))
    return superimposed(c, k).withColumn("zone", F.concat("zone", F.lit("_backward")))


def replaced(cells: DataFrame, back: DataFrame) -> DataFrame:
    """``cells``, those that ``back`` has too as it has them."""
    names = ("zone", "u", "v", "w")
    x = cells.join(merged(back.select("i", "j", "k", *[F.col(c).alias(f"{c}_b") for c in names])), ["i", "j", "k"], "left")
    return x.select("i", "j", "k", *[F.coalesce(f"{c}_b", c).alias(c) for c in names])


def vegetation(patches: DataFrame) -> DataFrame:
    """(i, j, k, f): what vegetation (xmin, ymin, xmax, ymax, top) leaves of the speed below its top, the least of overlapping patches."""
    g = levelled(_generated(patches, F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax")), F.col("top"))
    f = F.least(F.greatest(F.exp(0.5 * (F.col("z") / F.col("top") - 1)), F.lit(0.0)), F.lit(1.0))
    return g.groupBy("i", "j", "k").agg(F.min(f).alias("f"))


def weakened(cells: DataFrame, veg: DataFrame) -> DataFrame:
    """``cells`` times vegetation's factor; where there is only vegetation, the factor alone."""
    x = cells.join(veg, ["i", "j", "k"], "full")
    f = F.coalesce("f", F.lit(1.0))
    return x.select("i", "j", "k", F.coalesce("zone", F.lit("vegetation")).alias("zone"), F.coalesce(F.col("u") * f, F.lit(0.0)).alias("u"), F.coalesce(F.col("v") * f, "f").alias("v"), F.coalesce(F.col("w") * f, F.lit(0.0)).alias("w"))


def voxels(blocks: DataFrame) -> DataFrame:
    """(i, j, k) of cells whose centre lies in a block."""
    g = _generated(blocks.where("h IS NOT NULL"), F.col("xmin"), F.col("xmax"), F.col("ymin"), F.col("ymax"))
    return levelled(g, F.col("h")).select("i", "j", "k").distinct()


def full_field(cells: DataFrame, solid: DataFrame, i_cells: tuple[int, int], j_cells: tuple[int, int], k_cells: int, v_ref: float, z_ref: float = 10.0, alpha: float = 0.24) -> DataFrame:
    """(i, j, k, u, v, w, solid) on the whole grid: the power profile, times a zone's factor where there is one, nothing inside blocks."""
    spark = cells.sparkSession
    ni, nj = i_cells[1] - i_cells[0] + 1, j_cells[1] - j_cells[0] + 1
    n = spark.range(ni * nj * k_cells)
    grid = n.select((F.col("id") % ni + i_cells[0]).alias("i"), (F.floor(F.col("id") / ni) % nj + j_cells[0]).alias("j"), F.floor(F.col("id") / (ni * nj)).alias("k"))
    speed = v_ref * F.pow((F.col("k") + 0.5) * DZ / z_ref, alpha)
    x = grid.join(merged(cells.select("i", "j", "k", "u", "v", "w")), ["i", "j", "k"], "left").join(merged(solid.withColumn("s", F.lit(True))), ["i", "j", "k"], "left")
    free = F.col("s").isNull()
    part = lambda c, none: F.when(free, F.coalesce(F.col(c), F.lit(none)) * speed).otherwise(0.0)
    return x.select("i", "j", "k", part("u", 0.0).alias("u"), part("v", 1.0).alias("v"), part("w", 0.0).alias("w"), F.coalesce("s", F.lit(False)).alias("solid"))


def _walls(s: np.ndarray, axis: int) -> np.ndarray:
    """Faces along ``axis`` that touch a solid cell; outer faces take the edge cell's state."""
    return np.concatenate([np.take(s, [0], axis), np.maximum(np.delete(s, 0, axis), np.delete(s, -1, axis)), np.take(s, [-1], axis)], axis)


def _staggered(u: np.ndarray, v: np.ndarray, w: np.ndarray, solid: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Speeds on the faces between cells along each axis, none through walls or ground, and which faces are open (1.0)."""
    speeds, opened = [], []
    for axis, a in enumerate((u, v, w)):
        first, last = np.take(a, [0], axis), np.take(a, [-1], axis)
        f = np.concatenate([first, (np.delete(a, 0, axis) + np.delete(a, -1, axis)) / 2, last], axis)
        closed = _walls(solid, axis)
        if axis == 2:
            closed[:, :, 0] = True
            f[:, :, -1] = 0
        speeds.append(np.where(closed, 0.0, f))
        opened.append((~closed).astype(float))
    return speeds, opened


def _ends(a: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The faces before and after each cell."""
    return np.delete(a, -1, axis), np.delete(a, 0, axis)


def _divergence(speeds: list[np.ndarray]) -> np.ndarray:
    return sum(np.diff(f, axis=axis) for axis, f in enumerate(speeds))


#: Cells of one colour that are relaxed at once, so that what is in between stays in the cache.
_BLOCK = 32_768


def _relaxed(lam: np.ndarray, opened: list[np.ndarray], div: np.ndarray, free: np.ndarray, rounds: int, tolerance: float, omega: float, kind: type = float) -> tuple[np.ndarray, int, bool]:
    """The multiplier after red-black successive over-relaxation, the rounds, and whether the relative step came below ``tolerance``. ``lam`` has a border of one cell;
    only ``free`` cells change. ``kind`` is the precision of the arithmetic. Rows are padded to odd lengths, so that the two colours are the even and the odd places of the flat array, and each is an array of its own."""
    ni, nj, nk = free.shape
    pj, pk = (nj + 2) | 1, (nk + 2) | 1
    inner = (slice(1, ni + 1), slice(1, nj + 1), slice(1, nk + 1))

    def wide(a: np.ndarray) -> np.ndarray:
        z = np.zeros((ni + 2, pj, pk), kind)
        z[inner] = a
        return z.ravel()

    flat = np.zeros((ni + 2, pj, pk), kind)
    flat[:, : nj + 2, : nk + 2] = lam
    halves = [flat.ravel()[c::2].copy() for c in (0, 1)]
    before, after = zip(*(_ends(o, axis) for axis, o in enumerate(opened)))
    diag = sum(before) + sum(after)
    scale = omega * free / np.where(diag == 0, 1, diag)
    lo, hi = pj * pk, (ni + 1) * pj * pk
    plan = []
    for c in (1, 0):
        m0, m1 = (lo - c + 1) // 2, (hi - c + 1) // 2
        half = lambda x, c=c, m0=m0, m1=m1: wide(x)[c::2][m0:m1].copy()
        terms = []
        for axis, stride in enumerate((pj * pk, pk, 1)):
            for coef, s in ((before[axis], -stride), (after[axis], stride)):
                at = (c + s - (1 - c)) // 2
                terms.append((half(scale * coef), halves[1 - c][m0 + at : m1 + at]))
        plan.append((halves[c][m0:m1], half(scale * div), half(omega * free), terms))
    n, small = 0, False
    step, x = np.empty(_BLOCK, kind), np.empty(_BLOCK, kind)
    blocks = [[tuple(a[m : m + _BLOCK] for a in (own, fixed, weight)) + ([(c[m : m + _BLOCK], o[m : m + _BLOCK]) for c, o in terms],) for m in range(0, len(own), _BLOCK)] for own, fixed, weight, terms in plan]
    for n in range(1, rounds + 1):
        moved = total = 0.0
        for colour in blocks:
            for own, fixed, weight, terms in colour:
                d, y = step[: len(own)], x[: len(own)]
                np.multiply(weight, own, out=y)
                np.subtract(fixed, y, out=d)
                for coef, other in terms:
                    np.multiply(coef, other, out=y)
                    d += y
                own += d
                moved += float(np.abs(d, out=d).sum())
                total += float(np.abs(own, out=y).sum())
        if moved <= tolerance * max(total, 1e-12):
            small = True
            break
    for c in (0, 1):
        flat.ravel()[c::2] = halves[c]
    return flat[:, : nj + 2, : nk + 2], n, small


def _centred(speeds: list[np.ndarray], opened: list[np.ndarray], lam: np.ndarray) -> list[np.ndarray]:
    """Speeds at cell centres after the correction by the multiplier, which has a border of one cell."""
    out = []
    for axis in range(3):
        inside = tuple(slice(None) if a == axis else slice(1, -1) for a in range(3))
        before, after = _ends(speeds[axis] + opened[axis] * np.diff(lam[inside], axis=axis), axis)
        out.append((before + after) / 2)
    return out


def adjust(u: np.ndarray, v: np.ndarray, w: np.ndarray, solid: np.ndarray, rounds: int = 500, tolerance: float = 1e-4, omega: float = 1.78) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest field without divergence: faces of a staggered grid, a Poisson equation for the multiplier by red-black successive over-relaxation, walls closed."""
    speeds, opened = _staggered(u, v, w, solid)
    lam, n, _ = _relaxed(np.zeros(tuple(x + 2 for x in solid.shape)), opened, _divergence(speeds), ~solid, rounds, tolerance, omega)
    return *_centred(speeds, opened, lam), n


#: Columns of a piece's side, and how far it reaches into its neighbours.
PIECE, OVERLAP = 64, 12


class NotConverged(RuntimeError):
    """The multiplier still moves after all rounds."""


def _box(t: pa.Table, pi: int, pj: int) -> tuple[np.ndarray, np.ndarray, tuple[slice, slice, slice], np.ndarray]:
    """Of a piece's cells: first corner, places, the slices of its core, and which cells it may change (all but those that only its neighbours' multiplier fills)."""
    cells = np.stack([t.column(c).to_numpy() for c in "ijk"])
    low = cells.min(1)
    at = cells - low[:, None]
    shape = at.max(1) + 1
    core, own = [], np.ones(shape, bool)
    for axis, p in enumerate((pi, pj)):
        core.append(slice(max(p * PIECE - low[axis], 0), max(min((p + 1) * PIECE - low[axis], shape[axis]), 0)))
        ids = np.arange(shape[axis]) + low[axis]
        edge = (ids < p * PIECE - OVERLAP) | (ids >= (p + 1) * PIECE + OVERLAP)
        own[(slice(None),) * axis + (edge,)] = False
    return low, at, (core[0], core[1], slice(0, shape[2])), own


def solved(field: DataFrame, domain: str, rounds: int = 500, tolerance: float = 1e-4) -> DataFrame:
    """``field`` (i, j, k, u, v, w, solid; ``v`` runs with j) corrected, each ``domain`` (ground of any extent, or one case of a sweep) by itself: (domain, i, j, k, u, v, w, solid, rounds).
    Cells that a domain's box lacks are open and still.

    One Poisson problem per domain, by overlapping pieces: each relaxes its columns with the multiplier that its neighbours found beyond them, then all exchange, until the
    multiplier of the whole domain moves by less than ``tolerance`` between exchanges. Raises NotConverged if that takes more than ``rounds`` rounds of relaxation in all.
    """
    spark = field.sparkSession
    kind = field.schema[domain].dataType.simpleString()
    key = f"`{domain}` {kind}, pi bigint, pj bigint"
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - OVERLAP - 1) / PIECE), F.floor((F.col(c) + OVERLAP + 1) / PIECE)))
    rows = field.select(domain, "i", "j", "k", "u", "v", "w", "solid").withColumn("pi", near("i")).withColumn("pj", near("j"))
    names = (domain, "pi", "pj")
    dims, blobs = ("i0", "j0", "k0", "ni", "nj", "nk"), ("u", "v", "w", "solid")

    def packed(t: pa.Table) -> pa.Table:
        pi, pj = t.column("pi")[0].as_py(), t.column("pj")[0].as_py()
        low, at, core, _ = _box(t, pi, pj)
        shape = at.max(1) + 1
        if core[0].start >= core[0].stop or core[1].start >= core[1].stop:
            return empty
        out = {n: t.column(n).slice(0, 1) for n in names} | {n: pa.array([int(x)]) for n, x in zip(dims, (*low, *shape))}
        for c in blobs:
            a = np.zeros(shape, bool if c == "solid" else float)
            a[tuple(at)] = t.column(c).to_numpy(zero_copy_only=False)
            out[c] = pa.array([a.tobytes()], pa.binary())
        return pa.table(out)

    typed = to_arrow_type(field.schema[domain].dataType)
    empty = pa.table({domain: pa.array([], typed)} | {n: pa.array([], pa.int64()) for n in (*names[1:], *dims)} | {c: pa.array([], pa.binary()) for c in blobs})
    pieces = cut(rows.groupBy(*names).applyInArrow(packed, f"{key}, {', '.join(f'{n} bigint' for n in dims)}, {', '.join(f'{c} binary' for c in blobs)}"))

    def opened_box(t: pa.Table) -> tuple:
        one = {n: t.column(n)[0].as_py() for n in t.column_names}
        shape, low = tuple(one[n] for n in dims[3:]), np.array([one[n] for n in dims[:3]])
        u, v, w = (np.frombuffer(one[c]).reshape(shape) for c in "uvw")
        solid = np.frombuffer(one["solid"], bool).reshape(shape)
        cells = pa.table({c: pa.array(x.ravel() + low[n]) for n, (c, x) in enumerate(zip("ijk", np.indices(shape)))})
        _, _, core, own = _box(cells, one["pi"], one["pj"])
        return one, shape, low, _staggered(u, v, w, solid), solid, core, own

    def multiplier(shape: tuple, low: np.ndarray, parts: pa.Table) -> np.ndarray:
        lam = np.zeros(tuple(x + 2 for x in shape))
        for p in parts.to_pylist():
            at = tuple(slice(a - b + 1, a - b + 1 + n) for a, b, n in zip((p["i0"], p["j0"], p["k0"]), low, (p["ni"], p["nj"], p["nk"])))
            lam[at] = np.frombuffer(p["lam"]).reshape(p["ni"], p["nj"], p["nk"])
        return lam

    sent = f"{key}, {', '.join(f'{n} bigint' for n in dims)}, lam binary, moved double, total double, rounds int, small boolean"
    inner = tolerance / 10

    def relax(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def relaxed(t: pa.Table, parts: pa.Table) -> pa.Table:
            """The piece's new multiplier, sent to itself and to whichever neighbour reads a part of it."""
            out = {c: [] for c in (*names, *dims, "lam", "moved", "total", "rounds", "small")}
            if t.num_rows:
                one, shape, low, (speeds, opened), solid, core, own = opened_box(t)
                old = multiplier(shape, low, parts)
                lam, n, small = _relaxed(old, opened, _divergence(speeds), ~solid & own, most, inner, 1.78)
                inside = (slice(1, -1),) * 3
                mine, was = lam[inside][core], old[inside][core]
                first = [core[0].start + low[0], core[1].start + low[1], low[2]]
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        cutout, start = [], []
                        for axis, (p, d) in enumerate(((one["pi"], di), (one["pj"], dj))):
                            q = p + d
                            a, b = max(q * PIECE - OVERLAP - 1 - first[axis], 0), min((q + 1) * PIECE + OVERLAP + 1 - first[axis], mine.shape[axis])
                            cutout.append(slice(a, b))
                            start.append(first[axis] + a)
                        part = np.ascontiguousarray(mine[cutout[0], cutout[1]])
                        if not part.size:
                            continue
                        self_ = di == dj == 0
                        values = (one[domain], one["pi"] + di, one["pj"] + dj, *map(int, start), int(low[2]), *part.shape, part.tobytes(), float(np.abs(mine - was).sum()) if self_ else 0.0, float(np.abs(mine).sum()) if self_ else 0.0, n, small)
                        for c, x in zip(out, values):
                            out[c].append(x)
            types = {domain: typed, "lam": pa.binary(), "moved": pa.float64(), "total": pa.float64(), "rounds": pa.int32(), "small": pa.bool_()}
            return pa.table({c: pa.array(x, types.get(c, pa.int64())) for c, x in out.items()})

        return relaxed

    parts, used = spark.createDataFrame([], sent), 0
    while True:
        most = rounds - used
        if most <= 0:
            raise NotConverged(f"the multiplier moves by more than {tolerance} of itself after {used} rounds")
        parts = cut(pieces.groupBy(*names).cogroup(parts.groupBy(*names)).applyInArrow(relax(most), sent))
        state = parts.groupBy(domain).agg(F.sum("moved").alias("m"), F.sum("total").alias("t"), F.max("rounds").alias("n"), F.bool_and("small").alias("s"))
        worst = state.agg(F.max(F.col("m") / F.greatest("t", F.lit(1e-12))), F.max("n"), F.bool_and("s")).first()
        if worst[0] is None:
            break
        used += worst[1]
        if worst[2] and worst[0] <= tolerance:
            break

    def corrected(t: pa.Table, p: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({domain: pa.array([], typed)} | {c: pa.array([], pa.int64()) for c in "ijk"} | {c: pa.array([], pa.float64()) for c in "uvw"} | {"solid": pa.array([], pa.bool_()), "rounds": pa.array([], pa.int32())})
        one, shape, low, (speeds, opened), solid, core, _ = opened_box(t)
        mid = _centred(speeds, opened, multiplier(shape, low, p))
        at = [x[core].ravel() + low[n] for n, x in enumerate(np.indices(shape))]
        out = {domain: pa.array([one[domain]] * len(at[0]), typed)} | dict(zip("ijk", at)) | {c: x[core].ravel() for c, x in zip("uvw", mid)}
        return pa.table(out | {"solid": solid[core].ravel(), "rounds": pa.array(np.full(len(at[0]), used, np.int32))})

    return pieces.groupBy(*names).cogroup(parts.groupBy(*names)).applyInArrow(corrected, f"`{domain}` {kind}, i bigint, j bigint, k bigint, u double, v double, w double, solid boolean, rounds int")
