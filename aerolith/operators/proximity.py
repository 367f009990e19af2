"""Points near other points, and regions that contain points: dual-tree joins.

Both sides are trees of bounding boxes. Points are sorted along a space-filling curve, over the whole table, and cut into leaves of ``LEAF`` points; ``FAN`` successive leaves make a node, ``FAN`` successive
nodes one of the next level, up to one root. A node's box is that of its points on the sphere (as points of the unit ball, so the date line and the poles are no borders) and in degrees. Regions are cut into cells
of a grid, those wholly inside and those on the border, and the cells are the leaves of a tree of the same kind.

A join starts with the pair of roots. Each round holds the pairs of the children of what is left: pairs of boxes that are too far apart (or do not meet) are discarded with all below them, pairs that are
certain (all of whose points are within the radius, or whose points are all in a cell wholly inside) are accepted and only spread to their leaves, the others are split again. What is uncertain at the
leaves is refined point by point. Rounds are equi-joins on the parent, so they run as distributed tasks, each of bounded work: a pair has at most ``FAN`` squared children, a pair of leaves ``LEAF`` squared points.
However many points stand on one spot, their leaves are split among tasks and accepted without a distance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

EARTH = 6_371_008.8
#: Points in a leaf, children of a node (two to the power of FAN_BITS).
LEAF, FAN_BITS = 32, 6
FAN = 1 << FAN_BITS
#: Region cells in one degree; a power of two, so that cell borders are exact.
REGION_CELLS = 32
BALL, FLAT = ("x", "y", "z"), ("lon", "lat")


def located(points: DataFrame, point_id: str, lon: str, lat: str) -> DataFrame:
    """(id, lon, lat), one row per id, of the positions that count: no null or NaN, not 0/0, within ±180/±90. Of several positions of one id the smallest counts."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    p = points.select(F.col(point_id).alias("id"), x.alias("lon"), y.alias("lat")).where("id is not null and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)")
    p = p.groupBy("id").agg(F.min(F.struct("lon", "lat")).alias("at"))
    return p.select("id", F.col("at.lon").alias("lon"), F.col("at.lat").alias("lat"))


def _spread(v: Column, steps: list[tuple[int, int]]) -> Column:
    for shift, mask in steps:
        v = F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask))
    return v


def curve(*axes: Column) -> Column:
    """The place of 20-bit coordinates (three, or two) along a curve that keeps near what is near: their bits in turn."""
    if len(axes) == 3:
        steps = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]
    else:
        steps = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
    out = None
    for i, a in enumerate(axes):
        bits = F.shiftleft(_spread(a.cast("long"), steps), i)
        out = bits if out is None else out.bitwiseOR(bits)
    return out


@dataclass
class Tree:
    """``leaves`` (a written table): ``part`` and ``at`` (their order), boxes as ``x_lo``, ``x_hi`` ... and what they hold."""

    leaves: DataFrame
    axes: tuple[str, ...]

    def __post_init__(self) -> None:
        most, parts = self.leaves.agg(F.max("at"), F.max("part")).first()
        self.inner = 0  # levels within a part
        while most is not None and FAN**self.inner <= most:
            self.inner += 1
        self.height = self.inner
        while parts is not None and FAN ** (self.height - self.inner) <= parts:
            self.height += 1
        if FAN_BITS * self.height > 62:
            raise ValueError("more leaves than keys")
        self.keyed = self.leaves.withColumn("key", F.col("part").cast("long") * FAN**self.inner + F.col("at"))

    def level(self, k: int) -> DataFrame:
        """The nodes ``k`` levels above the leaves: ``key``, ``up`` (the parent's key) and boxes."""
        ends = [(f"{c}_{e}", f) for c in self.axes for e, f in (("lo", F.min), ("hi", F.max))]
        nodes = self.keyed.select(F.shiftright("key", FAN_BITS * k).alias("key"), *[e for e, _ in ends])
        if k:
            nodes = nodes.groupBy("key").agg(*[f(e).alias(e) for e, f in ends])
        return nodes.withColumn("up", F.shiftright("key", FAN_BITS))


def _leaves(rows: DataFrame, place: Column, kernel_of, shape: str) -> DataFrame:
    """``rows`` in order of ``place`` through a kernel that numbers leaves from 0 within its part; parts follow the order too."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for columns in kernel_of(batches):
            n = len(columns[next(iter(columns))])
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part, np.int32)), "at": pa.array(np.arange(at, at + n, dtype=np.int64)), **columns})
            at += n

    rows = rows.withColumn("place_", place).repartitionByRange("place_").sortWithinPartitions("place_").drop("place_")
    return cut(rows.mapInArrow(kernel, f"part int, at bigint, {shape}"))


def point_tree(points: DataFrame) -> Tree:
    """The tree of ``points`` (id, lon, lat; one row per id, ids BIGINT)."""
    lon, lat = F.radians("lon"), F.radians("lat")
    rows = points.select("id", "lon", "lat", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    grid = [F.least(F.floor((F.col(c) + 1) * (1 << 19)), F.lit((1 << 20) - 1)) for c in BALL]
    axes = (*BALL, *FLAT)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        rest: pa.Table | None = None

        def cut_up(t: pa.Table) -> dict[str, pa.Array]:
            starts = np.arange(0, t.num_rows, LEAF)
            v = {c: t.column(c).to_numpy() for c in axes}
            pts = pa.StructArray.from_arrays([t.column(c).combine_chunks() for c in ("id", "lon", "lat")], names=["id", "lon", "lat"])
            out = {"pts": pa.ListArray.from_arrays(pa.array(np.append(starts, t.num_rows).astype(np.int32)), pts)}
            for c in axes:
                out |= {f"{c}_lo": pa.array(np.minimum.reduceat(v[c], starts)), f"{c}_hi": pa.array(np.maximum.reduceat(v[c], starts))}
            return out

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            whole = t.num_rows // LEAF * LEAF
            if whole:
                yield cut_up(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            yield cut_up(rest)

    boxes = ", ".join(f"{c}_lo double, {c}_hi double" for c in axes)
    return Tree(_leaves(rows, curve(*grid), leaves, f"pts array<struct<id:bigint,lon:double,lat:double>>, {boxes}"), axes)


def _gap(axis: str) -> Column:
    """Distance between two boxes along one axis; 0 where they meet."""
    return F.greatest(F.col(f"a_{axis}_lo") - F.col(f"b_{axis}_hi"), F.col(f"b_{axis}_lo") - F.col(f"a_{axis}_hi"), F.lit(0.0))


def _span(axis: str) -> Column:
    """The most that two points of the boxes can be apart along one axis."""
    return F.greatest(F.col(f"a_{axis}_hi") - F.col(f"b_{axis}_lo"), F.col(f"b_{axis}_hi") - F.col(f"a_{axis}_lo"))


def dual(a: Tree, b: Tree, axes: tuple[str, ...], apart: Column, certain: Column, own: bool = False) -> DataFrame:
    """(a_key, b_key, certain) of the pairs of leaves that are left when pairs of nodes that are ``apart`` are discarded with all below them, and ``certain`` ones split no more than to their leaves. ``own``: both trees are one, each pair once."""
    height = max(a.height, b.height)
    pairs = a.leaves.sparkSession.range(1).select(F.col("id").alias("a_key"), F.col("id").alias("b_key"), F.lit(False).alias("certain"))
    for k in range(height - 1, -1, -1) if height else [0]:
        side = {n: t.level(k).select(F.col("key").alias(f"{n}_child"), F.col("up").alias(f"{n}_key"), *[F.col(f"{c}_{e}").alias(f"{n}_{c}_{e}") for c in axes for e in ("lo", "hi")]) for n, t in (("a", a), ("b", b))}
        pairs = pairs.join(side["a"], "a_key").join(side["b"], "b_key").where(F.col("certain") | ~apart)
        if own:
            pairs = pairs.where("a_child <= b_child")
        pairs = pairs.select(F.col("a_child").alias("a_key"), F.col("b_child").alias("b_key"), (F.col("certain") | certain).alias("certain"))
    return pairs


def _refine(radius: float):
    """Pairs of points of pairs of leaves: ``pts_a``, ``pts_b``, ``own`` (both are one leaf), ``certain``."""
    chord2 = (2 * math.sin(min(radius / (2 * EARTH), math.pi / 2))) ** 2 * (1 + 1e-6) + 1e-30

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, certain = batch.column("own").to_numpy(zero_copy_only=False), batch.column("certain").to_numpy(zero_copy_only=False)
            side = []
            for name in ("pts_a", "pts_b"):
                flat, n = batch.column(name).flatten(), batch.column(name).value_lengths().to_numpy()
                lon, lat = (np.radians(flat.field(c).to_numpy()) for c in FLAT)
                ball = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
                start = np.cumsum(n) - n
                side.append({"id": flat.field("id").to_numpy(), "lon": lon, "lat": lat, "ball": ball, "pair": np.repeat(np.arange(len(n)), n), "lo": np.minimum.reduceat(ball, start, axis=1), "hi": np.maximum.reduceat(ball, start, axis=1)})
            # Of uncertain pairs only the points that can reach the other leaf's box.
            for one, two in (side, side[::-1]):
                p = one["pair"]
                off = np.maximum(np.maximum(two["lo"][:, p] - one["ball"], one["ball"] - two["hi"][:, p]), 0)
                one["keep"] = np.flatnonzero(certain[p] | own[p] | ((off**2).sum(0) <= chord2))
            a, b = side
            size = [np.bincount(s["pair"][s["keep"]], minlength=len(own)) for s in side]
            first = [np.cumsum(n) - n for n in size]
            total = size[0].astype(np.int64) * size[1]
            at = 0
            while at < len(total):  # so many pairs of leaves at a time that their points stay within a few million
                end = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), 2_000_000)))
                n = total[at:end]
                pair = np.repeat(np.arange(at, end), n)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                i, j = k // np.maximum(size[1][pair], 1), k % np.maximum(size[1][pair], 1)
                keep = ~own[pair] | (i < j)
                pair, i, j = pair[keep], i[keep], j[keep]
                i, j = a["keep"][first[0][pair] + i], b["keep"][first[1][pair] + j]
                ok = certain[pair].copy()
                open_ = np.flatnonzero(~ok)
                u, v = i[open_], j[open_]
                h = np.sin((b["lat"][v] - a["lat"][u]) / 2) ** 2 + np.cos(a["lat"][u]) * np.cos(b["lat"][v]) * np.sin((b["lon"][v] - a["lon"][u]) / 2) ** 2
                ok[open_] = 2 * EARTH * np.arcsin(np.sqrt(np.minimum(h, 1))) <= radius
                x, y = a["id"][i[ok]], b["id"][j[ok]]
                if len(x):
                    yield pa.RecordBatch.from_pydict({"a_id": np.minimum(x, y), "b_id": np.maximum(x, y)})
                at = end

    return kernel


def near_leaves(tree: Tree, radius: float) -> DataFrame:
    """(a_key, b_key, certain) of the pairs of leaves of which points may be, or certainly all are, at most ``radius`` metres apart."""
    chord = 2 * math.sin(min(radius / (2 * EARTH), math.pi / 2))
    gap2, span2 = sum((_gap(c) * _gap(c) for c in BALL[1:]), _gap("x") * _gap("x")), sum((_span(c) * _span(c) for c in BALL[1:]), _span("x") * _span("x"))
    return dual(tree, tree, BALL, gap2 > chord**2 * (1 + 1e-6), span2 < chord**2 * (1 - 1e-6), own=True)


def near_pairs(points: DataFrame | Tree, radius: float) -> DataFrame:
    """(a_id, b_id), a_id < b_id, of each two points of ``points`` (id, lon, lat; one row per id) at most ``radius`` metres apart on the sphere, once.

    Ids are BIGINT. The date line and the poles are no borders. Points on one spot are paired like any others. Fewer than two points give an empty result.
    """
    tree = points if isinstance(points, Tree) else point_tree(points)
    pts = tree.keyed.select("key", "pts")
    work = near_leaves(tree, radius).withColumn("own", F.col("a_key") == F.col("b_key"))
    work = work.join(pts.select(F.col("key").alias("a_key"), F.col("pts").alias("pts_a")), "a_key").join(pts.select(F.col("key").alias("b_key"), F.col("pts").alias("pts_b")), "b_key")
    return work.select("own", "certain", "pts_a", "pts_b").mapInArrow(_refine(radius), "a_id bigint, b_id bigint")


_NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"
_RING = re.compile(r"\(\s*(" + _NUMBER + r"[^()]*)\)")
_XY = re.compile(rf"({_NUMBER})\s+({_NUMBER})")


def rings_of_wkt(wkt: str | None) -> list[np.ndarray]:
    """All rings of a POLYGON or MULTIPOLYGON (holes too: with the even-odd rule they need no mark). None or other text gives none."""
    if not wkt or not re.match(r"\s*(?:SRID=\d+;)?\s*(MULTI)?POLYGON", wkt, re.IGNORECASE):
        return []
    out = []
    for m in _RING.finditer(wkt):
        r = np.array([(float(x), float(y)) for x, y in _XY.findall(m[1])])
        if len(r) >= 3:
            out.append(r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]))
    return out


def cover(rings: list[np.ndarray], per_degree: int) -> Iterator[tuple[int, int, bool, bool, np.ndarray]]:
    """Cells (x, y) that a region touches: wholly inside or not, and if not what a point of the cell has to its right: an odd number of edges that span the cell's band beyond the cell, and the other edges (n, 4)."""
    e = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings])
    e = e[(e[:, :2] != e[:, 2:]).any(1)]
    g, tiny = per_degree, 1e-9
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    x_first, x_last = int(np.floor((e[:, [0, 2]].min() - tiny) * g)), int(np.floor((e[:, [0, 2]].max() + tiny) * g))
    for y in range(int(np.floor((low.min() - tiny) * g)), int(np.floor((high.max() + tiny) * g)) + 1):
        south, north = y / g, (y + 1) / g
        band = e[(high >= south - tiny) & (low <= north + tiny)]
        if not len(band):
            continue
        slope = (band[:, 2] - band[:, 0]) / np.where(band[:, 3] == band[:, 1], 1, band[:, 3] - band[:, 1])
        level = band[:, 3] == band[:, 1]
        ends = [np.where(level, band[:, c], band[:, 0] + np.clip((edge - band[:, 1]) * slope, *np.sort([np.zeros(len(band)), band[:, 2] - band[:, 0]], axis=0))) for c, edge in ((0, south), (2, north))]
        left, right = np.minimum(*ends) - tiny, np.maximum(*ends) + tiny
        border = {x for a, b in zip(np.floor(left * g).astype(int), np.floor(right * g).astype(int), strict=True) for x in range(a, b + 1)}
        spans = (np.minimum(band[:, 1], band[:, 3]) <= south) & (np.maximum(band[:, 1], band[:, 3]) >= north)
        mid = (y + 0.5) / g
        cut_ = band[(band[:, 1] > mid) != (band[:, 3] > mid)]
        hits = np.sort(cut_[:, 0] + (mid - cut_[:, 1]) * (cut_[:, 2] - cut_[:, 0]) / (cut_[:, 3] - cut_[:, 1]))
        for x in range(x_first, x_last + 1):
            if x in border:
                beyond = spans & (left > (x + 1) / g)
                yield x, y, False, bool(beyond.sum() % 2), band[~beyond & (right >= x / g)]
            elif (len(hits) - np.searchsorted(hits, (x + 0.5) / g, "right")) % 2:
                yield x, y, True, False, band[:0]


def region_cells(regions: DataFrame, region_id: str, wkt: str, per_degree: int = REGION_CELLS) -> DataFrame:
    """(cell_x, cell_y, region, whole, odd, edges) of each region. A null or unreadable geometry covers nothing; of repeated region ids the least geometry counts."""
    kind = regions.schema[region_id].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, text in zip(b.column("rid"), b.column("wkt"), strict=True):
                rings = rings_of_wkt(text.as_py())
                rows = list(cover(rings, per_degree)) if rings else []
                for i in range(0, len(rows), 2000):
                    some = rows[i : i + 2000]
                    flat = np.concatenate([r[4].ravel() for r in some])
                    edges = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [r[4].size for r in some]).astype(np.int32)), pa.array(flat))
                    column = lambda k, t, some=some: pa.array([r[k] for r in some], t)
                    yield pa.RecordBatch.from_pydict(
                        {"cell_x": column(0, pa.int32()), "cell_y": column(1, pa.int32()), "region": pa.array([rid.as_py()] * len(some), b.schema.field("rid").type), "whole": column(2, pa.bool_()), "odd": column(3, pa.bool_()), "edges": edges}
                    )

    shape = f"cell_x int, cell_y int, region {kind}, whole boolean, odd boolean, edges array<double>"
    one = regions.select(F.col(region_id).alias("rid"), F.col(wkt).cast("string").alias("wkt")).where("rid is not null and wkt is not null").groupBy("rid").agg(F.min("wkt").alias("wkt"))
    return one.mapInArrow(kernel, shape)


def region_tree(cells: DataFrame, per_degree: int) -> Tree:
    """The tree of ``region_cells``."""
    kind = cells.schema["region"].dataType.simpleString()

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).to_numpy() / per_degree for c in ("cell_x", "cell_y"))
                yield {c: b.column(c) for c in b.schema.names} | {"lon_lo": pa.array(x), "lon_hi": pa.array(x + 1 / per_degree), "lat_lo": pa.array(y), "lat_hi": pa.array(y + 1 / per_degree)}

    shape = f"cell_x int, cell_y int, region {kind}, whole boolean, odd boolean, edges array<double>, lon_lo double, lon_hi double, lat_lo double, lat_hi double"
    grid = [F.pmod(F.col(c) + (1 << 19), F.lit(1 << 20)) for c in ("cell_x", "cell_y")]
    return Tree(_leaves(cells, curve(*grid), leaves, shape), FLAT)


def _inside(per_degree: int):
    """(id, region) of the points ``pts`` of a leaf that lie in a region's cell and, unless it is wholly inside, to the left of an odd number of edges."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, n = b.column("pts").flatten(), b.column("pts").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            ids, lon, lat = (flat.field(c).to_numpy() for c in ("id", *FLAT))
            cell = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("cell_x", "cell_y", "certain", "whole", "odd")}
            keep = cell["certain"][row] | ((np.floor(lon * per_degree) == cell["cell_x"][row]) & (np.floor(lat * per_degree) == cell["cell_y"][row]))
            row, ids, lon, lat = row[keep], ids[keep], lon[keep], lat[keep]
            inside = cell["whole"][row] ^ cell["odd"][row]
            edges, m = b.column("edges").flatten().to_numpy().reshape(-1, 4), b.column("edges").value_lengths().to_numpy() // 4
            first = np.cumsum(m) - m
            at = 0
            while at < len(row):  # so many points at a time that their edges stay within a few million
                end = at + max(1, int(np.searchsorted(np.cumsum(m[row[at:]]), 2_000_000)))
                k = m[row[at:end]]
                point = np.repeat(np.arange(at, end), k)
                e = edges[np.repeat(first[row[at:end]] - (np.cumsum(k) - k), k) + np.arange(len(point))]
                cross = (e[:, 1] > lat[point]) != (e[:, 3] > lat[point])
                point, e = point[cross], e[cross]
                left = lon[point] < e[:, 0] + (lat[point] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
                inside[at:end] ^= np.bincount(point[left] - at, minlength=end - at) % 2 == 1
                at = end
            if inside.any():
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[inside]), "region": b.column("region").take(pa.array(row[inside]))})

    return kernel


def contained(points: DataFrame | Tree, regions: DataFrame, region_id: str, wkt: str, per_degree: int = REGION_CELLS) -> DataFrame:
    """(id, region) of each point of ``points`` (id, lon, lat) and region that contains it: edges straight in lon/lat, even-odd rule, so holes are out.

    A point on a border belongs to the side that the half-open crossing rule gives it, so of two regions with a common border to one of them.
    Of repeated region ids the least geometry counts.
    """
    tree = points if isinstance(points, Tree) else point_tree(points)
    cells = region_tree(region_cells(regions, region_id, wkt, per_degree), per_degree)
    apart = (_gap("lon") > 0) | (_gap("lat") > 0)
    pairs = dual(tree, cells, FLAT, apart, F.lit(False))
    work = pairs.join(tree.keyed.select(F.col("key").alias("a_key"), "pts", *[F.col(f"{c}_{e}").alias(f"p_{c}_{e}") for c in FLAT for e in ("lo", "hi")]), "a_key")
    work = work.join(cells.keyed.withColumnRenamed("key", "b_key"), "b_key")
    within = (F.col("p_lon_lo") >= F.col("lon_lo")) & (F.col("p_lon_hi") < F.col("lon_hi")) & (F.col("p_lat_lo") >= F.col("lat_lo")) & (F.col("p_lat_hi") < F.col("lat_hi"))
    work = work.select("pts", "cell_x", "cell_y", (F.col("whole") & within).alias("certain"), "whole", "odd", "edges", "region")
    return work.mapInArrow(_inside(per_degree), f"id bigint, region {cells.leaves.schema['region'].dataType.simpleString()}")
