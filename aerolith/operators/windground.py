"""The corrected wind field of large grounds: each piece of the grid makes its own cells.

The rows of a field are many gigabytes where its blocks are a few megabytes, so what is sent to a piece are the blocks, canyons and patches whose zones may reach it. It makes its field from
them in arrays, as ``windfield`` does in rows, solves it in single precision with an overlap in which the influence of the cut fades, and gives only what ``summary`` keeps. Neighbours compare both sides of
their border; while these differ, they exchange and solve again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import merged
from .windfield import DZ, MESH, PRIORITY, NotConverged, _centred, _divergence, _relaxed, _staggered, canyon_pairs, measured

#: Cells of a piece with its overlap, about; levels times this are the overlap's columns (a cut's influence falls to a thirty-thousandth), but no more than so many.
CELLS, FADES, WIDEST = 2_000_000, 7, 72
_BLOCK = ("xmin", "ymin", "xmax", "ymax", "h", "displacement", "vortex", "cavity", "wake", "roof_length", "roof_height")
_PAIR = ("xmin", "y0", "xmax", "y1", "h", "above", "a_cavity", "a_xmin", "a_xmax", "below", "b_xmin", "b_xmax", "b_ymin", "b_cavity", "b_wake")
_PATCH = ("xmin", "ymin", "xmax", "ymax", "top")
_NUMBERS = tuple(f"c{n}" for n in range(max(map(len, (_BLOCK, _PAIR, _PATCH)))))
_RING, _FACE, _OUT = 0, 1, 3  # 1 and 2: faces across each axis


@dataclass(frozen=True)
class Ground:
    """The grid of one case and its pieces: bounds of cells, levels, overlap, columns of a piece, how far south of a piece lie speeds that it needs."""

    low: tuple[int, int]
    high: tuple[int, int]
    levels: int
    overlap: int
    side: tuple[int, int]
    south: int

    @staticmethod
    def of(i: tuple[int, int], j: tuple[int, int], levels: int, south: int, cells: int) -> Ground:
        overlap = min(FADES * levels, WIDEST)
        size, area, least = (i[1] - i[0] + 1, j[1] - j[0] + 1), cells / levels, overlap + 2
        side = list(size)
        for a, b in ((0, 1), (1, 0)):  # a narrow ground is cut across its length only
            if size[a] ** 2 <= area:
                side[b] = min(size[b], max(int(area / size[a]) - 2 * overlap - 2, least))
                break
        else:
            side = [min(n, max(int(area**0.5) - 2 * overlap - 2, least)) for n in size]
        return Ground((i[0], j[0]), (i[1], j[1]), levels, overlap, tuple(side), south)

    def pieces(self, axis: int) -> int:
        return -(-(self.high[axis] - self.low[axis] + 1) // self.side[axis])

    def core(self, piece: tuple[int, int], more: int = 0) -> list[tuple[int, int]]:
        """First cell and the one after the last along each axis, of the piece with ``more`` columns around it."""
        first = [self.low[a] + p * self.side[a] for a, p in enumerate(piece)]
        return [(max(f - more, self.low[a]), min(f + self.side[a] + more, self.high[a] + 1)) for a, f in enumerate(first)]


def _items(ground: Ground, blocks: DataFrame, patches: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pi, pj, kind, id, next_id, c0 ..) for every piece that an item's zones may reach; one row of kind -1 for each piece."""
    spark, size = blocks.sparkSession, [ground.pieces(a) for a in (0, 1)]
    none = F.lit(None).cast("bigint")

    def sent(df: DataFrame, kind: int, names: tuple[str, ...], ids: tuple[Column, Column], y0: Column, y1: Column) -> DataFrame:
        ends = []
        for axis, (a, b, more) in enumerate(((F.col("xmin"), F.col("xmax"), 0), (y0, y1, ground.south))):
            side, low, near = ground.side[axis], ground.low[axis], ground.overlap + 2
            first = F.greatest(F.ceil((F.floor(a / MESH) - near - low + 1) / side) - 1, F.lit(0))
            last = F.least(F.floor((F.floor(b / MESH) + near + more - low) / side), F.lit(size[axis] - 1))
            ends.append(F.sequence(first.cast("bigint"), F.greatest(last, first).cast("bigint")))
        numbers = [(F.col(names[n]).cast("double") if n < len(names) else F.lit(None).cast("double")).alias(c) for n, c in enumerate(_NUMBERS)]
        x = df.select(*[e.alias(n) for e, n in zip(ends, ("pis", "pjs"))], F.lit(kind).alias("kind"), ids[0].alias("id"), ids[1].alias("next_id"), *numbers)
        x = x.withColumn("pi", F.explode("pis")).withColumn("pj", F.explode("pjs")).where(f"pi < {size[0]} AND pj < {size[1]}")
        return x.select("pi", "pj", "kind", "id", "next_id", *_NUMBERS)

    up, down = (F.coalesce(F.greatest(*c), F.lit(0.0)) for c in (("displacement", "vortex"), ("cavity", "wake")))
    m = measured(blocks).select("id", *_BLOCK)
    flat = blocks.where("h IS NOT NULL AND NOT (h > 0 AND xmax > xmin AND ymax > ymin)").select("id", *_BLOCK[:5], *[F.lit(None).cast("double").alias(c) for c in _BLOCK[5:]])
    all_ = spark.range(size[0] * size[1]).select((F.col("id") % size[0]).alias("pi"), F.floor(F.col("id") / size[0]).alias("pj"), F.lit(-1).alias("kind"), none.alias("id"), none.alias("next_id"), *[F.lit(None).cast("double").alias(c) for c in _NUMBERS])
    parts = [
        sent(m.unionByName(flat), 0, _BLOCK, (F.col("id").cast("bigint"), none), F.col("ymin") - down, F.col("ymax") + up),
        sent(pairs, 1, _PAIR, (F.col("id").cast("bigint"), F.col("next_id").cast("bigint")), F.col("b_ymin") - MESH, F.col("y1") + 3 * MESH),
        sent(patches, 2, _PATCH, (none, none), F.col("ymin"), F.col("ymax")),
    ]
    for p in parts:
        all_ = all_.unionByName(p)
    return all_


def _pairs(blocks: DataFrame) -> DataFrame:
    """Canyons with what tells where the flow over the roof behind is turned back."""
    m = measured(blocks)
    a = m.select("id", F.col("h").alias("above"), F.col("cavity").alias("a_cavity"), F.col("xmin").alias("a_xmin"), F.col("xmax").alias("a_xmax"))
    b = m.select(F.col("id").alias("next_id"), F.col("h").alias("below"), F.col("xmin").alias("b_xmin"), F.col("xmax").alias("b_xmax"), F.col("ymin").alias("b_ymin"), F.col("cavity").alias("b_cavity"), F.col("wake").alias("b_wake"))
    return canyon_pairs(m).join(merged(a), "id").join(merged(b), "next_id")


# A piece's field in arrays ------------------------------------------------------------------------------------------------------------------

_Box = tuple[tuple[int, int], tuple[int, int], int]  # cells along each axis as Ground.core has them, levels


def _repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as ``n`` says, and 0 .. within each."""
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)


def _points(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, box: _Box) -> tuple[np.ndarray, ...]:
    """(item, i, j, x, y) of grid points inside bounds and the box."""
    (a, b), (c, d), _ = box
    first, last = lambda v: np.ceil(v / MESH - 0.5), lambda v: np.floor(v / MESH - 0.5)
    known = np.isfinite(x0 + x1 + y0 + y1)
    x0, x1, y0, y1 = (np.where(known, v, e) for v, e in ((x0, 1.0), (x1, 0.0), (y0, 1.0), (y1, 0.0)))
    i0, i1, j0, j1 = (f(v, e).astype(np.int64) for f, v, e in ((np.maximum, first(x0), a), (np.minimum, last(x1), b - 1), (np.maximum, first(y0), c), (np.minimum, last(y1), d - 1)))
    nj = np.maximum(j1 - j0 + 1, 0)
    item, at = _repeated(np.maximum(i1 - i0 + 1, 0) * nj)
    i, j = i0[item] + at // np.maximum(nj[item], 1), j0[item] + at % np.maximum(nj[item], 1)
    return item, i, j, (i + 0.5) * MESH, (j + 0.5) * MESH


def _levels(ceiling: np.ndarray, box: _Box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, k, z) of levels below each point's ceiling."""
    n = np.clip(np.ceil(np.nan_to_num(ceiling) / DZ - 0.5), 0, box[2]).astype(np.int64)
    point, k = _repeated(n)
    return point, k, (k + 0.5) * DZ


class _Zones:
    """Rows (cell, order, v, w) of zones; the order is an item's rank by wall, height and zone."""

    def __init__(self, box: _Box) -> None:
        self.box, self.rows, self.keys, self.n = box, [], [], 0

    def cell(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        (a, _), (c, d), nk = self.box
        return ((i - a) * (d - c) + (j - c)) * nk + k

    def add(self, y_wall: np.ndarray, h: np.ndarray, p: int, item: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, v: np.ndarray, w: np.ndarray | float = 0.0) -> None:
        """Walls and heights are those of items."""
        self.keys.append(np.stack([y_wall, h, np.full(len(h), -p, float)], 1))
        self.rows.append((self.cell(i, j, k), item + self.n, v, np.broadcast_to(w, v.shape)))
        self.n += len(h)

    def best(self) -> tuple[np.ndarray, ...]:
        """(cell, y_wall, h, v, w): of each cell that has any, the row of the highest order, then speed."""
        size = (self.box[0][1] - self.box[0][0]) * (self.box[1][1] - self.box[1][0]) * self.box[2]
        cell, item, v, w = (np.concatenate(x) for x in zip(*self.rows))
        keys, rank = np.unique(np.vstack(self.keys), axis=0, return_inverse=True)
        order, top = rank.ravel()[item], np.full(size, -1)
        np.maximum.at(top, cell, order)
        some = np.flatnonzero(order == top[cell])
        some = some[np.lexsort((w[some], v[some], cell[some]))]
        c = cell[some]
        some = some[np.concatenate([c[1:] != c[:-1], [True]])] if len(c) else some
        key = keys[order[some]]
        return cell[some], key[:, 0], key[:, 1], v[some], w[some]


def _superimposed(zones: _Zones, wakes: _Zones) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(there, v, w) of every cell of the box, as ``windfield.superimposed`` has them."""
    size = (zones.box[0][1] - zones.box[0][0]) * (zones.box[1][1] - zones.box[1][0]) * zones.box[2]
    none = -np.inf
    y, h, v, w = np.full(size, none), np.full(size, none), np.zeros(size), np.zeros(size)
    c, *of = zones.best()
    y[c], h[c], v[c], w[c] = of
    c, wy, wh, wv, _ = wakes.best()
    zone = y[c] > none
    weaker = zone & ((wy > y[c]) | ((wy == y[c]) & (wh > h[c])))
    v[c] = np.where(zone, v[c] * np.where(weaker, wv, 1.0), wv)
    y[c] = np.maximum(y[c], 0)
    return y > none, v, w


def _across(x: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    return (x - (x0 + x1) / 2) / ((x1 - x0) / 2)


def _reach(length: np.ndarray, across: np.ndarray) -> np.ndarray:
    return length * np.sqrt(np.maximum(1 - across**2, 0.0))


def factors(box: _Box, items: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, w, solid) of the box: shares of the reference speed, ``v`` to the south, as ``windfield`` and the combined zones have them. Items: kind, id, next_id and numbers of blocks, canyons
    and patches."""
    shape = (box[0][1] - box[0][0], box[1][1] - box[1][0], box[2])
    of = lambda kind, names: {n: items[c][items["kind"] == kind] for n, c in zip((*names, "id", "next_id"), (*_NUMBERS[: len(names)], "id", "next_id"))}
    all_, p, veg = of(0, _BLOCK), of(1, _PAIR), of(2, _PATCH)
    b = {n: c[~np.isnan(all_["displacement"])] for n, c in all_.items()}
    zones, wakes = _Zones(box), _Zones(box)
    h = b["h"]
    with np.errstate(divide="ignore", invalid="ignore"):
        # where the flow is turned back
        whole = (box[0], (np.iinfo(np.int32).min, np.iinfo(np.int32).max), box[2])
        wall = np.ceil(p["y0"] / MESH - 0.5)
        open_ = wall <= np.floor(p["y1"] / MESH - 0.5)
        mid = (wall + 0.5) * MESH
        t, ti, _, tx, ty = _points(p["xmin"], p["xmax"], np.where(open_, mid, 1.0), np.where(open_, mid, 0.0), whole)
        reach = _reach(p["a_cavity"][t], _across(tx, p["a_xmin"][t], p["a_xmax"][t]))
        dy = p["y1"][t] - ty
        low = np.minimum(p["above"], p["below"])[t]
        back = (dy <= reach) & (reach > 0) & (p["above"][t] * np.sqrt(np.maximum(1 - (dy / reach) ** 2, 0.0)) > low)
        t, ti, low, tj = t[back], ti[back], low[back], wall[t[back]].astype(np.int64)
        _, ids = np.unique(np.concatenate([b["id"], p["next_id"]]), return_inverse=True)
        wide = max(shape[0], 1)
        gone = np.unique(ids[len(h) :][t] * wide + ti - box[0][0])

        for name, share in (("displacement", 0.6), ("vortex", 0.5)):
            n, i, j, x, y = _points(b["xmin"], b["xmax"], b["ymax"], b["ymax"] + b[name], box)
            r = _across(x, b["xmin"][n], b["xmax"][n]) ** 2 + ((y - b["ymax"][n]) / b[name][n]) ** 2
            n, i, j, r = (a[r <= 1] for a in (n, i, j, r))
            q, k, z = _levels(share * h[n] * np.sqrt(1 - r), box)
            n, r = n[q], r[q]
            if name == "displacement":
                v, w = 0.4 * (z / h[n]) ** 0.16, 0.0
            else:
                v, w = -(0.6 * np.cos(np.pi * z / (0.5 * h[n])) + 0.05) * 0.6 * np.sin(np.pi * r), -0.1 * np.cos(np.pi * r) - 0.05
            zones.add(b["ymax"], h, PRIORITY[name], n, i[q], j[q], k, v, w)
        for name in ("cavity", "wake"):
            n, i, j, x, y = _points(b["xmin"], b["xmax"], b["ymin"] - b[name], b["ymin"], box)
            reach, dy = _reach(b[name][n], _across(x, b["xmin"][n], b["xmax"][n])), b["ymin"][n] - y
            in_ = (dy <= reach) & (reach > 0) & ((dy > reach / 3) | (name == "cavity"))
            n, i, j, reach, dy = (a[in_] for a in (n, i, j, reach, dy))
            r = dy / reach
            q, k, z = _levels(h[n] * np.sqrt(1 - r * r), box)
            n, r = n[q], r[q]
            edge = np.sqrt(np.maximum(1 - (z / h[n]) ** 2, 1e-9))
            if name == "cavity":
                zones.add(b["ymin"], h, PRIORITY[name], n, i[q], j[q], k, -((1 - np.minimum(r / edge, 1.0)) ** 2))
            else:
                wakes.add(b["ymin"], h, 0, n, i[q], j[q], k, 1 - (reach[q] / 3 / dy[q]) ** 1.5 * np.sqrt(1 - (z / h[n]) ** 2) ** 1.5)
        n, i, j, x, y = _points(p["xmin"], p["xmax"], p["y0"], p["y1"], box)
        stay = ~np.isin(n * wide + i - box[0][0], t * wide + ti - box[0][0])
        n, i, j, y = (a[stay] for a in (n, i, j, y))
        r = (p["y1"][n] - y) / (p["y1"] - p["y0"])[n]
        q, k, z = _levels(p["h"][n], box)
        r = r[q]
        zones.add(p["y1"], p["h"], PRIORITY["canyon"], n[q], i[q], j[q], k, -4 * r * (1 - r), -(0.5 * np.abs(1 - 2 * r)) * (1 - 2 * (1 - r)))
        n, i, j, x, y = _points(b["xmin"], b["xmax"], np.maximum(b["ymin"], b["ymax"] - b["roof_length"]), b["ymax"], box)
        stay = ~np.isin(ids[: len(h)][n] * wide + i - box[0][0], gone)
        n, i, j = (a[stay] for a in (n, i, j))
        q, k, z = _levels(h[n] + b["roof_height"][n], box)
        on = z > h[n[q]]
        q, k, z = q[on], k[on], z[on]
        n = n[q]
        up = h[n] + b["roof_height"][n] - z
        zones.add(b["ymax"], h, PRIORITY["rooftop"], n, i[q], j[q], k, -((up / 10.0) ** 0.16) * np.abs(up) / b["roof_height"][n])

        there, v, w = _superimposed(zones, wakes)

        # backward zones, in place of cells that are there
        tk = np.floor(low / DZ).astype(np.int64)
        near = (tj >= box[1][0]) & (tj < box[1][1]) & (tk >= 0) & (tk < box[2])
        t, ti, tj, low, tk = (a[near] for a in (t, ti, tj, low, tk))
        at = zones.cell(ti, tj, tk)
        t, ti, tj, low, at = (a[there[at]] for a in (t, ti, tj, low, at))
        weight = np.abs(v[at])
        f = {c: p[c][t] for c in ("below", "b_xmin", "b_xmax", "b_ymin", "b_cavity", "b_wake")} | {"gap": (p["y1"] - p["y0"])[t], "y_back": p["y0"][t]}
        across = _across((ti + 0.5) * MESH, f["b_xmin"], f["b_xmax"])
        turned = {name: _Zones(box) for name in ("cavity", "wake")}
        for name, zone in turned.items():
            first, last = np.ceil((f["b_ymin"] - f[f"b_{name}"]) / MESH - 0.5).astype(np.int64), np.floor(f["b_ymin"] / MESH - 0.5).astype(np.int64)
            n, j = _repeated(np.maximum(last - first + 1, 0))
            dy, reach = f["b_ymin"][n] - (first[n] + j + 0.5) * MESH, _reach(f[f"b_{name}"], across)[n]
            j = tj[n] + np.floor(dy / MESH).astype(np.int64)
            in_ = (dy <= reach) & (reach > 0) & (dy < f["gap"][n] + MESH) & (j >= box[1][0]) & (j < box[1][1]) & ((dy > reach / 3) | (name == "cavity"))
            n, j, dy, reach = (a[in_] for a in (n, j, dy, reach))
            r, hb = dy / reach, f["below"][n]
            q, k, z = _levels(hb * np.sqrt(1 - r**2), box)
            n, r, hb = n[q], r[q], hb[q]
            edge = np.sqrt(np.maximum(1 - (z / hb) ** 2, 1e-9))
            share = (1 - np.minimum(r / edge, 1.0)) ** 2 if name == "cavity" else -1 + (reach[q] / 3 / dy[q] * edge) ** 1.5
            zone.add(-f["y_back"], -low, 0, n, ti[n], j[q], k, share * weight[n])
        has, bv, bw = _superimposed(turned["cavity"], turned["wake"])
        has &= there
        v, w = np.where(there, v, 1.0), np.where(there, w, 0.0)
        v[has], w[has] = bv[has], bw[has]

        n, i, j, _, _ = _points(veg["xmin"], veg["xmax"], veg["ymin"], veg["ymax"], box)
        q, k, z = _levels(veg["top"][n], box)
        leaves = np.ones(len(v))
        np.minimum.at(leaves, zones.cell(i[q], j[q], k), np.clip(np.exp(0.5 * (z / veg["top"][n[q]] - 1)), 0.0, 1.0))
        v *= leaves
        w *= leaves

    n, i, j, _, _ = _points(all_["xmin"], all_["xmax"], all_["ymin"], all_["ymax"], box)
    q, k, _ = _levels(all_["h"][n], box)
    solid = np.zeros(len(v), bool)
    solid[zones.cell(i[q], j[q], k)] = True
    return v.reshape(shape), w.reshape(shape), solid.reshape(shape)


# Pieces -------------------------------------------------------------------------------------------------------------------------------------

#: Of a piece's core: first cell, speeds to the east, to the north and up, which cells are solid -> rows to keep.
Summary = Callable[[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def solved(cases: dict[int, tuple[DataFrame, DataFrame, tuple[tuple[int, int], tuple[int, int], int]]], v_ref: float, summary: Summary, schema: str, rounds: int = 500, tolerance: float = 1e-4, cells: int = CELLS) -> DataFrame:
    """(case, rounds, and the columns of ``schema``, without nulls): what ``summary`` keeps of the corrected field of each case: blocks (id, xmin, ymin, xmax, ymax, h), vegetation (xmin, ymin, xmax,
    ymax, top) and bounds of the grid as ``windfield.full_field`` has them. Solved until both sides of all borders between pieces agree on the multiplier, in each case, within ``tolerance`` of
    itself there. Raises NotConverged if that takes more than ``rounds`` rounds of relaxation in all."""
    spark = next(iter(cases.values()))[0].sparkSession
    grounds, all_ = {}, None
    for case, (blocks, patches, (i, j, levels)) in cases.items():
        pairs = cut(_pairs(blocks))
        gap = pairs.agg(F.max(F.col("y1") - F.col("y0"))).first()[0] or 0.0
        g = grounds[case] = Ground.of(i, j, levels, int(gap / MESH) + 4, cells)
        x = _items(g, blocks, patches, pairs).withColumn("case", F.lit(case))
        all_ = x if all_ is None else all_.unionByName(x)
    names = ("case", "pi", "pj")
    many = sum(g.pieces(0) * g.pieces(1) for g in grounds.values())
    tasks = min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism))
    by_piece = lambda df: df.repartition(tasks, *names)  # noqa: E731 - pieces cost time and not bytes, so partitions must not be put together for being small
    items = cut(all_)
    inner = tolerance / 10
    sent = "case int, pi bigint, pj bigint, kind int, i bigint, j bigint, ni bigint, nj bigint, blob binary, n int, small boolean"

    def relax(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def relaxed(t: pa.Table, rings: pa.Table) -> pa.Table:
            case, *piece = (t.column(c)[0].as_py() for c in names)
            g = grounds[case]
            core, box = g.core(piece), g.core(piece, g.overlap + 1)
            nk = g.levels
            south = max(box[1][0] - g.south, g.low[1])
            values = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("kind", *_NUMBERS)} | {c: t.column(c).fill_null(0).to_numpy() for c in ("id", "next_id")}
            v, w, solid = (a[:, box[1][0] - south :] for a in factors((box[0], (south, box[1][1]), nk), values))
            speed = np.where(solid, 0.0, v_ref * (((np.arange(nk) + 0.5) * DZ) / 10.0) ** 0.24)
            speeds, opened = _staggered(np.zeros(solid.shape), -v * speed, w * speed, solid)
            lam = np.zeros(tuple(n + 2 for n in solid.shape))
            for x in rings.to_pylist():
                a, b = x["i"] - box[0][0] + 1, x["j"] - box[1][0] + 1
                lam[a : a + x["ni"], b : b + x["nj"], 1:-1] = np.frombuffer(x["blob"], np.float32).reshape(x["ni"], x["nj"], nk)
            own = ~solid
            for axis, (near, far) in enumerate(zip(g.core(piece, g.overlap), box)):
                edge = np.ones(far[1] - far[0], bool)
                edge[near[0] - far[0] : near[1] - far[0]] = False
                own[(slice(None),) * axis + (edge,)] = False
            lam, n, small = _relaxed(lam, opened, _divergence(speeds), own, most, inner, 1.78, np.float32)

            def part(ends: list[tuple[int, int]]) -> np.ndarray:
                (a, b), (c, d) = ((lo - box[x][0] + 1, hi - box[x][0] + 1) for x, (lo, hi) in enumerate(ends))
                return np.ascontiguousarray(lam[a:b, c:d, 1:-1])

            out = []
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    other = (piece[0] + di, piece[1] + dj)
                    if (di, dj) == (0, 0) or not all(0 <= q < g.pieces(a) for a, q in enumerate(other)):
                        continue
                    near, far = g.core(other, g.overlap), g.core(other, g.overlap + 1)
                    for axis in (0, 1):
                        for lo, hi in ((far[axis][0], near[axis][0]), (near[axis][1], far[axis][1])):
                            ends = [(max(a, c), min(b, d)) for (a, b), (c, d) in zip(core, [(lo, hi) if x == axis else far[x] for x in (0, 1)])]
                            if all(a < b for a, b in ends):
                                out.append((*other, _RING, ends, part(ends).tobytes()))
            for axis in (0, 1):
                for low, at in ((piece[axis], core[axis][1]), (piece[axis] - 1, core[axis][0])):
                    if 0 <= low < g.pieces(axis) - 1:
                        ends = [(at - 1, at + 1) if x == axis else core[x] for x in (0, 1)]
                        out.append((*((low if x == axis else piece[x]) for x in (0, 1)), _FACE + axis, ends, part(ends).tobytes()))
            inside = tuple(slice(lo - far[0], hi - far[0]) for (lo, hi), far in zip(core, box))
            kept = pa.table(summary((core[0][0], core[1][0]), *(a[inside] for a in _centred(speeds, opened, lam.astype(float))), solid[inside]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(kept)
            out.append((*piece, _OUT, core, sink.getvalue().to_pybytes()))
            pi, pj, kind, ends, blobs = zip(*out)
            whole = lambda x: pa.array(x, pa.int64())
            first, size = ([[e[a][0] for e in ends] for a in (0, 1)], [[e[a][1] - e[a][0] for e in ends] for a in (0, 1)])
            m = len(out)
            return pa.table([pa.array([case] * m, pa.int32()), whole(pi), whole(pj), pa.array(kind, pa.int32()), *map(whole, first), *map(whole, size), pa.array(blobs, pa.binary()), pa.array([n] * m, pa.int32()), pa.array([small] * m)], names=[c.split()[0] for c in sent.split(", ")])

        return relaxed

    def differ(t: pa.Table) -> pa.Table:
        a, b = (np.frombuffer(x, np.float32).astype(float) for x in t.column("blob").to_pylist())
        return pa.table({"case": t.column("case").slice(0, 1), "moved": [float(np.abs(a - b).sum())], "total": [float((np.abs(a) + np.abs(b)).sum() / 2)]})

    rings, used = spark.createDataFrame([], sent), 0
    while True:
        most = rounds - used
        if most <= 0:
            raise NotConverged(f"the multiplier differs by more than {tolerance} of itself at the borders of pieces after {used} rounds")
        found = cut(by_piece(items).groupBy(*names).cogroup(by_piece(rings).groupBy(*names)).applyInArrow(relax(most), sent), "kind")
        n, small = found.where(f"kind = {_OUT}").agg(F.max("n"), F.bool_and("small")).first()
        used += n
        faces = found.where(f"kind IN ({_FACE}, {_FACE + 1})").groupBy("case", "kind", "pi", "pj").applyInArrow(differ, "case int, moved double, total double")
        worst = faces.groupBy("case").agg((F.sum("moved") / F.greatest(F.sum("total"), F.lit(1e-12))).alias("d")).agg(F.max("d")).first()[0]
        if small and (worst or 0.0) <= tolerance:
            break
        rings = found.where(f"kind = {_RING}")

    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches):
        for t in batches:
            for case, blob in zip(t.column("case"), t.column("blob")):
                for x in pa.ipc.open_stream(blob.as_buffer()):
                    yield pa.RecordBatch.from_arrays([pa.array([case.as_py()] * x.num_rows, pa.int32()), pa.array(np.full(x.num_rows, used, np.int32)), *[x.column(c) for c in columns]], names=["case", "rounds", *columns])

    return found.where(f"kind = {_OUT}").select("case", "blob").mapInArrow(read, f"case int, rounds int, {schema}")
