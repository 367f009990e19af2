"""Set operations of polygons of any shape: concave, with holes, in several parts, overlapping themselves.

A region is a list of rings under the even-odd rule. Two regions are laid over each other as an arrangement: all edges are split where they meet, pieces that coincide become one, and each piece
knows whether either region lies to its left and to its right. Pieces whose two sides differ in the wanted combination are its border; they are joined into rings, outer ones counter-clockwise, holes
clockwise. Coordinates are rounded to ``GRID``, so what touches within that is one point.

Layers are overlaid as joins: candidate pairs by the cells their bounds touch, the kernel in Arrow batches. What several shapes take from one is subtracted one after the other in the group of that one, and a
dissolve unites by key and cell first, so that only outlines meet in one task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

from . import joins as J

GRID = 2.0**-20
RINGS = "array<array<struct<x:double,y:double>>>"
_RINGS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))
Region = list[np.ndarray]
OPERATIONS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "minus": lambda a, b: a & ~b, "xor": lambda a, b: a ^ b}


def _sweep(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (q, p) of one group with ``lo[q] <= at[p] <= hi[q]``, some at a time. ``group`` holds the groups of the spans and then of the places; found by sorting, so pairs that lie apart are never looked at."""
    n, m = len(lo), len(at)
    rank = np.lexsort((np.concatenate([np.zeros(n, np.int8), np.full(n, 2, np.int8), np.ones(m, np.int8)]), np.concatenate([lo, hi, at]), np.concatenate([group[:n], group])))
    place = rank >= 2 * n
    seen = np.empty(2 * n + m, np.int64)
    seen[rank] = np.cumsum(place) - place
    first, last, order = seen[:n], seen[n : 2 * n], rank[place] - 2 * n
    total = np.cumsum(np.maximum(last - first, 0))
    q0 = 0
    while q0 < n:
        before = total[q0 - 1] if q0 else 0
        q1 = max(int(np.searchsorted(total, before + most, "right")), q0 + 1)
        each = np.maximum(last[q0:q1] - first[q0:q1], 0)
        q = np.repeat(np.arange(q0, q1), each)
        p = np.arange(len(q)) - np.repeat(np.cumsum(each) - each - first[q0:q1], each)
        yield q, order[p]
        q0 = q1


def _edges(xy: np.ndarray, ring: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4), in units of the grid, and each edge's owner. ``ring``: where rings begin and the last ends; ``owner``: of each ring."""
    n = np.diff(ring)
    xy = np.rint(xy / GRID)
    follow = np.arange(1, len(xy) + 1)
    follow[ring[1:][n > 0] - 1] = ring[:-1][n > 0]
    e, of = np.hstack([xy, xy[follow]]) if len(xy) else np.empty((0, 4)), np.repeat(owner, n)
    real = (e[:, :2] != e[:, 2:]).any(1) & np.repeat(n >= 3, n)
    return e[real], of[real]


def _split(e: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges split where they meet others of their group, and which edge each piece is of."""
    n = len(e)
    lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    edge, at = [], []
    axis = int(np.ptp(lo[:, 1]) > np.ptp(lo[:, 0])) if n else 0
    for a, b in _sweep(np.concatenate([group, group]), lo[:, axis], hi[:, axis], lo[:, axis]):
        other = 1 - axis
        # Of two that begin at once each finds the other: once is enough.
        near = (lo[a, other] <= hi[b, other]) & (hi[a, other] >= lo[b, other]) & ((lo[a, axis] < lo[b, axis]) | (a < b))
        i, j = np.minimum(a[near], b[near]), np.maximum(a[near], b[near])
        p, r, q, s = e[i, :2], e[i, 2:] - e[i, :2], e[j, :2], e[j, 2:] - e[j, :2]
        d, den = q - p, r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / den, (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / den
        k = np.flatnonzero((den != 0) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12))
        cut = np.rint(p[k] + t[k, None] * r[k])
        edge += [i[k], j[k]]
        at += [cut, cut]
        k = np.flatnonzero((den == 0) & (d[:, 0] * r[:, 1] == d[:, 1] * r[:, 0]))  # on one line: either's ends may cut the other
        for one, two in ((i[k], j[k]), (j[k], i[k])):
            for ends in (e[two, :2], e[two, 2:]):
                within = ((ends >= lo[one]) & (ends <= hi[one])).all(1)
                edge.append(one[within])
                at.append(ends[within])
    own = np.arange(n)
    edge, at = np.concatenate([own, own, *edge]), np.vstack([e[:, :2], e[:, 2:], *at])
    way = ((at - e[edge, :2]) * (e[edge, 2:] - e[edge, :2])).sum(1)
    order = np.lexsort((way, edge))
    edge, at = edge[order], at[order]
    go = (edge[1:] == edge[:-1]) & (at[1:] != at[:-1]).any(1)
    return np.hstack([at[:-1][go], at[1:][go]]), edge[1:][go]


class Arrangement:
    """Of many groups at once: edges (n, 4) of the grid, the group of each, and which of the group's regions it bounds.

    ``here`` and ``there`` tell of each piece in which regions (columns) its right and left side lie, of level pieces the upper and lower one. Without ``regions``, their number, there is one column, which counts:
    regions are then rings that do not cross, outer ones counter-clockwise and holes clockwise, as arrangements give them, any number to a group.
    """

    def __init__(self, edges: np.ndarray, group: np.ndarray, region: np.ndarray, groups: int, regions: int):
        self.groups, winding = groups, not regions
        pieces, of = _split(edges, group)
        g, region = group[of], region[of]
        turned = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
        e = np.where(turned[:, None], pieces[:, [2, 3, 0, 1]], pieces)
        order = np.lexsort((e[:, 3], e[:, 2], e[:, 1], e[:, 0], g))
        e, g, region, sign = e[order], g[order], region[order], np.where(turned[order], -1, 1)
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]).any(1) | (g[1:] != g[:-1])
        which = np.cumsum(new) - 1
        columns = regions or 1
        step = np.zeros((int(new.sum()), columns), np.int64)
        np.add.at(step, (which, 0 if winding else region), sign if winding else 1)
        step = step if winding else step % 2
        real = step.any(1)
        e, g, step = e[new][real], g[new][real], step[real]
        # A ray to the right from just above each piece's middle: of level pieces that is their upper side, of the others the right one.
        mx, my = (e[:, 0] + e[:, 2]) / 2, (e[:, 1] + e[:, 3]) / 2
        steep = np.flatnonzero(e[:, 1] != e[:, 3])
        q = e[steep]
        up = np.where(q[:, 3] > q[:, 1], 1, -1)
        low, high, slope = np.minimum(q[:, 1], q[:, 3]), np.maximum(q[:, 1], q[:, 3]), (q[:, 2] - q[:, 0]) / (q[:, 3] - q[:, 1])
        here = np.zeros((len(e), columns))
        for a, p in _sweep(np.concatenate([g[steep], g]), low, high, my):
            hit = (my[p] < high[a]) & (steep[a] != p)
            a, p = a[hit], p[hit]
            beyond = q[a, 0] + (my[p] - q[a, 1]) * slope[a] > mx[p]
            a, p = a[beyond], p[beyond]
            for c in range(columns):
                here[:, c] += np.bincount(p, step[steep[a], c] * (up[a] if winding else 1), len(e))
        here = np.rint(here).astype(np.int64)
        if winding:
            left = np.where(e[:, 1] == e[:, 3], -1, np.where(e[:, 3] > e[:, 1], 1, -1))[:, None] * step
            self.here, self.there = here > 0, here + left > 0
        else:
            self.here = here % 2 == 1
            self.there = self.here ^ (step == 1)
        self.e, self.g = e, g

    def regions(self, keep: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The part of the plane that ``keep`` takes, told of places (rows) in which of the regions (columns) they lie, as rings: outer ones counter-clockwise, holes clockwise.
        Points, where rings begin and the last ends, and how many rings each group has."""
        here = keep(self.here)
        border = here != keep(self.there)
        e, g, here = self.e[border], self.g[border], here[border]
        # Pieces go from the lower left: the right side is on the right hand of a rising piece, on the left hand of a falling or level one.
        inside_left = np.where(e[:, 3] > e[:, 1], ~here, here)
        return _join(np.where(inside_left[:, None], e, e[:, [2, 3, 0, 1]]), g, self.groups)


def _following(e: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The piece that goes on after each; where several do, the one that turns back most, so that rings only touch."""
    n = len(e)
    ends = np.vstack([e[:, :2], e[:, 2:]])
    order = np.lexsort((ends[:, 1], ends[:, 0], np.concatenate([g, g])))
    gg, pp = np.concatenate([g, g])[order], ends[order]
    new = np.ones(2 * n, bool)
    new[1:] = (gg[1:] != gg[:-1]) | (pp[1:] != pp[:-1]).any(1)
    corner = np.empty(2 * n, np.int64)
    corner[order] = np.cumsum(new) - 1
    starts, ends = corner[:n], corner[n:]
    by = np.argsort(starts, kind="stable")
    out = np.bincount(starts, minlength=corner.max(initial=0) + 1)
    begin = np.cumsum(out) - out
    follow = np.full(n, -1)
    single = out[ends] == 1
    follow[single] = by[begin[ends[single]]]
    several = np.flatnonzero(out[ends] > 1)
    if len(several):
        each = out[ends[several]]
        one = np.repeat(several, each)
        two = by[np.arange(len(one)) - np.repeat(np.cumsum(each) - each - begin[ends[several]], each)]
        angle = np.arctan2(e[:, 3] - e[:, 1], e[:, 2] - e[:, 0])
        back = (angle[one] + math.pi - angle[two]) % (2 * math.pi)
        back[back == 0] = 2 * math.pi
        o = np.lexsort((back, one))
        one, two = one[o], two[o]
        least = np.ones(len(one), bool)
        least[1:] = one[1:] != one[:-1]
        follow[one[least]] = two[least]
    return follow


def _walked(e: np.ndarray, g: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """``follow`` where it leaves pieces out or takes one twice (corners that rounding moved): one after the other, each piece once, whatever is left over going back to where its ring began."""
    taken = np.bincount(follow[follow >= 0], minlength=len(e))
    bad = np.unique(g[(follow < 0) | (taken != 1)])
    for k in bad.tolist():
        own = np.flatnonzero(g == k)
        angle = np.arctan2(e[own, 3] - e[own, 1], e[own, 2] - e[own, 0]).tolist()
        starts, ends = list(map(tuple, e[own, :2].tolist())), list(map(tuple, e[own, 2:].tolist()))
        out_of: dict[tuple, list[int]] = defaultdict(list)
        for i, p in enumerate(starts):
            out_of[p].append(i)
        used = [False] * len(own)
        for first in range(len(own)):
            i = first
            while not used[i]:
                used[i] = True
                back = angle[i] + math.pi
                ways = [x for x in out_of[ends[i]] if not used[x]]
                j = min(ways, key=lambda x: (back - angle[x]) % (2 * math.pi) or 2 * math.pi) if ways else first
                follow[own[i]] = own[j]
                i = j
    return follow


def _join(e: np.ndarray, g: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed pieces, the inside to their left, joined into rings, those of each group one after the other: points, where rings begin and the last ends, rings of each group."""
    n = len(e)
    follow = _walked(e, g, _following(e, g))
    # Every ring by its least piece, and each piece's steps to the ring's end, by doubling.
    root, jump = np.arange(n), follow
    while True:
        less = np.minimum(root, root[jump])
        if (less == root).all():
            break
        root, jump = less, jump[jump]
    last = follow == root
    left, jump = np.where(last, 0, 1), np.where(last, np.arange(n), follow)
    while (jump[jump] != jump).any():
        left, jump = left + left[jump], jump[jump]
    order = np.lexsort((-left, root))
    r, ring = e[order, :2], root[order]
    begin = np.flatnonzero(np.concatenate([[True], ring[1:] != ring[:-1]])) if n else np.empty(0, np.int64)
    # Corners on a straight line go.
    stop = np.append(begin[1:], n)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    if n:
        before[begin], after[stop - 1] = stop - 1, begin
    d, f = r - r[before], r[after] - r
    turn = d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0] != 0
    number = np.repeat(np.arange(len(begin)), stop - begin)
    corners = np.bincount(number[turn], minlength=len(begin))
    good = corners >= 3
    stay = turn & good[number]
    points, corners, owner = r[stay] * GRID, corners[good], g[order][begin][good]
    at = np.cumsum(corners) - corners
    closed = np.insert(points, at + corners, points[at], axis=0) if len(at) else np.empty((0, 2))
    return closed, np.concatenate([[0], np.cumsum(corners + 1)]).astype(np.int64), np.bincount(owner, minlength=groups)


def _flat(regions: list[Region]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, where rings begin and the last ends, and how many rings each region has."""
    rings = [r for g in regions for r in g]
    return np.vstack(rings) if rings else np.empty((0, 2)), np.cumsum([0] + [len(r) for r in rings]), np.array([len(g) for g in regions], np.int64)


def _nested(xy: np.ndarray, ring: np.ndarray, per: np.ndarray) -> list[Region]:
    each = np.concatenate([[0], np.cumsum(per)]).tolist()
    ring = ring.tolist()
    return [[xy[ring[k] : ring[k + 1]] for k in range(a, b)] for a, b in zip(each[:-1], each[1:], strict=True)]


def arrange(regions: list[Region], keep: Callable[[np.ndarray], np.ndarray]) -> Region:
    """One group of regions, see ``Arrangement.regions``."""
    xy, ring, per = _flat(regions)
    e, of = _edges(xy, ring, np.repeat(np.arange(len(regions)), per))
    return _nested(*Arrangement(e, np.zeros(len(e), np.int64), of, 1, len(regions)).regions(keep))[0]


def overlay(a: Region, b: Region, how: str) -> Region:
    """``a`` and / or / minus / xor ``b`` as rings; an empty list where nothing is left."""
    return arrange([a, b], lambda in_: OPERATIONS[how](in_[:, 0], in_[:, 1]))


def minus_all(a: Region, others: list[Region], at_once: int = 24) -> Region:
    """What all the others leave of ``a``."""
    for k in range(0, len(others), at_once):
        if not a:
            break
        a = arrange([a, *others[k : k + at_once]], lambda in_: in_[:, 0] & ~in_[:, 1:].any(1))
    return a


def ring_area(r: np.ndarray) -> float:
    """Positive counter-clockwise."""
    r = r - r[0]
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def area(region: Region) -> float:
    """Of rings as ``overlay`` gives them."""
    return sum(map(ring_area, region))


def valid(region: Region) -> Region:
    """The same even-odd region as rings that do not cross: a bow tie becomes two triangles."""
    return overlay(region, [], "or")


def union(regions: list[Region]) -> Region:
    """Everything that any of the regions covers."""
    return regions_of(_united(valid_column(as_column(regions))))[0]


def holds(region: Region, x: float, y: float) -> bool:
    """Even-odd, half-open: of two regions with a common border one holds a point on it."""
    odd = False
    for r in region:
        span = (r[:-1, 1] > y) != (r[1:, 1] > y)
        a, b = r[:-1][span], r[1:][span]
        odd ^= bool((x < a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)
    return odd


def polygons(region: Region) -> list[Region]:
    """Parts: each outer ring with its holes."""
    outer = [r for r in region if ring_area(r) > 0]
    out = [[r] for r in outer]
    for h in (r for r in region if ring_area(r) < 0):
        # A point just inside the hole's edge, on the region's side, lies in the outer ring it belongs to; the smallest such.
        mid, way = (h[0] + h[1]) / 2, h[1] - h[0]
        x, y = mid + np.array([-way[1], way[0]]) * 1e-6
        around = [k for k, r in enumerate(outer) if holds([r], x, y)]
        if around:
            out[min(around, key=lambda k: ring_area(outer[k]))].append(h)
    return out


def meets(a: Region, b: Region) -> bool:
    """They share a point, be it on their borders."""
    ea, eb = (_edges(xy, ring, np.zeros(len(ring) - 1))[0] for xy, ring, _ in (_flat([a]), _flat([b])))
    if not len(ea) or not len(eb):
        return False
    p, r = ea[:, None, :2], (ea[:, 2:] - ea[:, :2])[:, None]
    q, s = eb[None, :, :2], (eb[:, 2:] - eb[:, :2])[None]
    side = lambda o, v, z: v[..., 0] * (z[..., 1] - o[..., 1]) - v[..., 1] * (z[..., 0] - o[..., 0])
    across = (side(p, r, q) * side(p, r, q + s) <= 0) & (side(q, s, p) * side(q, s, p + r) <= 0)
    lo, hi = (f(ea[:, :2], ea[:, 2:])[:, None] for f in (np.minimum, np.maximum))
    lo2, hi2 = (f(eb[:, :2], eb[:, 2:])[None] for f in (np.minimum, np.maximum))
    if (across & ((lo <= hi2) & (hi >= lo2)).all(2)).any():
        return True
    return holds(a, *b[0][0]) or holds(b, *a[0][0])


def covers(a: Region, b: Region) -> bool:
    """No part of ``b`` lies outside ``a``."""
    return abs(area(overlay(b, a, "minus"))) < 1e-6


# Columns ------------------------------------------------------------------------------------------------------------------------------------


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, where rings begin and the last ends, and how many rings each row has; null is an empty region."""
    rings = column.flatten()
    points = rings.flatten()
    xy = np.stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)], axis=1) if len(points) else np.empty((0, 2))
    ring = np.cumsum(np.concatenate([[0], rings.value_lengths().fill_null(0).to_numpy()])).astype(int)
    return xy, ring, column.value_lengths().fill_null(0).to_numpy().astype(int)


def _closed(xy: np.ndarray, ring: np.ndarray, per: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], names=["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(ring.astype(np.int32)), points)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), inner)


def _together(*columns: pa.Array) -> pa.Array:
    """One after the other; Spark names the parts of its types otherwise."""
    kind = _closed(np.empty((0, 2)), np.zeros(1), np.empty(0)).type
    return pa.concat_arrays([c.cast(kind) for c in columns])


def regions_of(column: pa.Array) -> list[Region]:
    """Of an array of rings; null is an empty region."""
    return _nested(*_opened(column))


def as_column(regions: list[Region]) -> pa.Array:
    return _closed(*_flat(regions))


def arranged(columns: list[tuple[pa.Array, np.ndarray, np.ndarray]], groups: int, regions: int) -> Arrangement:
    """Of rows of rings, with the group and the region of each row."""
    edges, group, region = [], [], []
    for column, g, r in columns:
        xy, ring, per = _opened(column)
        e, row = _edges(xy, ring, np.repeat(np.arange(len(per)), per))
        edges.append(e)
        group.append(g[row])
        region.append(r[row])
    return Arrangement(np.vstack(edges), np.concatenate(group), np.concatenate(region), groups, regions)


def _two(a: pa.Array, b: pa.Array) -> Arrangement:
    rows = np.arange(len(a))
    return arranged([(a, rows, np.zeros_like(rows)), (b, rows, np.ones_like(rows))], len(a), 2)


def _taken(how: str) -> Callable[[np.ndarray], np.ndarray]:
    return lambda in_: OPERATIONS[how](in_[:, 0], in_[:, 1])


def valid_column(rings: pa.Array) -> pa.Array:
    rows = np.arange(len(rings))
    return _closed(*arranged([(rings, rows, np.zeros_like(rows))], len(rings), 1).regions(lambda in_: in_[:, 0]))


def _united(rings: pa.Array, group: np.ndarray | None = None) -> pa.Array:
    """A row for each group (0 .. in order; without them, one): the union of its rows, which are valid."""
    none = np.zeros(len(rings), np.int64)
    group = none if group is None else group
    return _closed(*arranged([(rings, group, none)], int(group.max(initial=0)) + 1, 0).regions(lambda in_: in_[:, 0]))


def areas(xy: np.ndarray, ring: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each ring, positive counter-clockwise, and of each row's rings as overlays give them."""
    n = np.diff(ring)
    z = xy - np.repeat(xy[ring[:-1][n > 0]], n[n > 0], axis=0)
    cross = z[:-1, 0] * z[1:, 1] - z[1:, 0] * z[:-1, 1]
    number = np.repeat(np.arange(len(n)), n)
    inside = number[1:] == number[:-1]
    of_ring = np.bincount(number[:-1][inside], cross[inside], len(n)) / 2
    return of_ring, np.bincount(np.repeat(np.arange(len(per)), per), of_ring, len(per))


def binary(how: str) -> Callable[[Column, Column], Column]:
    """A column function of two columns of rings."""

    @F.arrow_udf(_RINGS)
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return _closed(*_two(a, b).regions(_taken(how)))

    return of


@F.arrow_udf(BooleanType())
def overlaps(a: pa.Array, b: pa.Array) -> pa.Array:
    """They share an area, and neither covers the other."""
    both = _two(a, b)
    of = lambda keep: areas(*both.regions(keep))[1]
    return pa.array((of(_taken("and")) > 1e-9) & (np.abs(of(_taken("minus"))) >= 1e-6) & (np.abs(of(lambda in_: in_[:, 1] & ~in_[:, 0])) >= 1e-6))


def predicate(test: Callable[[Region, Region], bool]) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(BooleanType())
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([bool(test(x, y)) for x, y in zip(regions_of(a), regions_of(b), strict=True)])

    return of


@F.arrow_udf(DoubleType())
def area_of(rings: pa.Array) -> pa.Array:
    """Of rings as overlays give them."""
    return pa.array(areas(*_opened(rings))[1], pa.float64())


@F.arrow_udf(_RINGS)
def valid_of(rings: pa.Array) -> pa.Array:
    return valid_column(rings)


@F.arrow_udf(ArrayType(_RINGS))
def parts_of(rings: pa.Array) -> pa.Array:
    """Parts of a region, each an outer ring and its holes."""
    xy, ring, per = _opened(rings)
    of_ring, _ = areas(xy, ring, per)
    row = np.repeat(np.arange(len(per)), per)
    plain = np.bincount(row, of_ring <= 0, len(per)) == 0  # no holes: every ring is a part
    if plain.all():
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), _closed(xy, ring, np.ones(len(ring) - 1, int)))
    parts = [[[x] for x in r] if easy else polygons(r) for r, easy in zip(_nested(xy, ring, per), plain, strict=True)]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)), as_column([g for p in parts for g in p]))


def minus_groups(a: pa.Array, others: pa.Array, group: np.ndarray, at_once: int = 24) -> pa.Array:
    """What the others (rows in order of ``group``, the row of ``a`` that each belongs to) leave of each row."""
    first = np.concatenate([[True], group[1:] != group[:-1]])
    place = np.arange(len(group)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    for k in range(0, int(place.max(initial=-1)) + 1, at_once):
        some = np.flatnonzero((place >= k) & (place < k + at_once))
        rows, own = np.unique(group[some], return_inverse=True)
        each = np.arange(len(rows))
        both = arranged([(a.take(pa.array(rows)), each, np.zeros_like(each)), (others.take(pa.array(some)), own, place[some] - k + 1)], len(rows), int((place[some] - k).max()) + 2)
        at = np.arange(len(a))
        at[rows] = len(a) + each
        a = _together(a, _closed(*both.regions(lambda in_: in_[:, 0] & ~in_[:, 1:].any(1)))).take(pa.array(at))
    return a


# Layers -------------------------------------------------------------------------------------------------------------------------------------


def _boxed(layer: DataFrame) -> DataFrame:
    """(id, rings) with bounds; null and empty geometries meet nothing."""
    flat = F.flatten("rings")
    axes = {"x": F.transform(flat, lambda p: p["x"]), "y": F.transform(flat, lambda p: p["y"])}
    ends = [(f"{c}{e}", f(v)) for c, v in axes.items() for e, f in (("min", F.array_min), ("max", F.array_max))]
    return layer.where("rings is not null and size(rings) > 0").select("id", "rings", *[v.alias(n) for n, v in ends])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """By ``keys`` into a fixed number of partitions: overlays cost time and not bytes, so partitions must not be put together for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pairs(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, a_rings, b_rings) of shapes whose bounds meet."""
    return J.boxes_that_meet(_boxed(a), _boxed(b), size).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("a.rings").alias("a_rings"), F.col("b.rings").alias("b_rings"))


def intersection(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, rings) of what shapes of two layers (id, rings) share, where that has an area. ``size``: the side of a cell, about that of a shape."""
    x = spread(pairs(a, b, size), "a_id", "b_id").select("a_id", "b_id", binary("and")("a_rings", "b_rings").alias("rings"))
    return x.where(F.size("rings") > 0)


def difference(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(id, rings) of what all shapes of ``b`` together leave of each shape of ``a``, where anything is left. Ids of ``a`` are unique."""
    kind = a.schema["id"].dataType.simpleString()
    met = pairs(a, b, size)  # every group has a pair, so what is left has been through an arrangement

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of ``a_id``; of the last one there may be more in the next batch."""
        ids = left = None
        for t in batches:
            if not t.num_rows:
                continue
            key = t.column("a_id") if ids is None else pa.concat_arrays([ids, t.column("a_id")])
            code = key.dictionary_encode("encode").indices.to_numpy()
            new = np.concatenate([[True], code[1:] != code[:-1]])
            own = t.column("a_rings") if ids is None else _together(left, t.column("a_rings"))
            held = int(ids is not None)
            begin = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            ids, left = key.take(pa.array(begin)), minus_groups(own.take(pa.array(begin)), t.column("b_rings"), run[held:])
            yield pa.RecordBatch.from_pydict({"id": ids.slice(0, len(ids) - 1), "rings": left.slice(0, len(ids) - 1)})
            ids, left = ids.slice(len(ids) - 1), left.slice(len(left) - 1)
        if ids is not None:
            yield pa.RecordBatch.from_pydict({"id": ids, "rings": left})

    cut_down = spread(met, "a_id").sortWithinPartitions("a_id").mapInArrow(kernel, f"id {kind}, rings {RINGS}")
    whole = _boxed(a).select("id", "rings").join(J.merged(met.select(F.col("a_id").alias("id")).distinct()), "id", "left_anti")
    return cut_down.where(F.size("rings") > 0).unionByName(whole)


def union_of_layers(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, rings): what both have, what only ``a`` has (b_id null) and what only ``b`` has (a_id null)."""
    ids = {n: t.schema["id"].dataType for n, t in (("a_id", a), ("b_id", b))}
    both = intersection(a, b, size)
    left = difference(a, b, size).select(F.col("id").alias("a_id"), F.lit(None).cast(ids["b_id"]).alias("b_id"), "rings")
    right = difference(b, a, size).select(F.lit(None).cast(ids["a_id"]).alias("a_id"), F.col("id").alias("b_id"), "rings")
    return both.unionByName(left).unionByName(right)


def united_runs(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The union of each group's shapes, of a batch's groups at once. Rows come in order of ``names``; of the last group there may be more in the next batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for t in batches:
            if not t.num_rows:
                continue
            keys, rings = {n: t.column(n) for n in names}, valid_column(t.column("rings"))
            if held is not None:
                keys, rings = {n: pa.concat_arrays([held[0][n], c]) for n, c in keys.items()}, _together(held[1], rings)
            new = np.ones(len(rings), bool)
            new[1:] = np.any([np.diff(c.dictionary_encode("encode").indices.to_numpy()) != 0 for c in keys.values()], axis=0)
            begin = pa.array(np.flatnonzero(new))
            keys, rings = {n: c.take(begin) for n, c in keys.items()}, _united(rings, np.cumsum(new) - 1)
            last = len(rings) - 1
            yield pa.RecordBatch.from_pydict({n: c.slice(0, last) for n, c in keys.items()} | {"rings": rings.slice(0, last)})
            held = {n: c.slice(last) for n, c in keys.items()}, rings.slice(last)
        if held is not None:
            yield pa.RecordBatch.from_pydict(held[0] | {"rings": held[1]})

    return kernel


def dissolve(layer: DataFrame, key: str, size: float) -> DataFrame:
    """(``key``, rings): the union of each key's shapes. First by cell, then of the cells' outlines."""
    kind = layer.schema[key].dataType.simpleString()

    def kernel(names: list[str], at_once: int = 2_000_000):
        def of(group: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, points = [], 0
            for t in batches:
                held.append(t.column("rings"))
                points += len(held[-1].flatten().flatten())
                if points > at_once:
                    held, points = [_united(_together(*held))], 0
            yield pa.RecordBatch.from_pydict({n: pa.array([g.as_py()], g.type) for n, g in zip(names, group, strict=True)} | {"rings": _united(_together(*held))})

        return of

    first = F.col("rings")[0][0]
    cells = layer.where("rings is not null and size(rings) > 0").select(F.col(key).alias("k"), F.floor(first["x"] / (8 * size)).alias("i"), F.floor(first["y"] / (8 * size)).alias("j"), "rings")
    some = spread(cells, "k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(united_runs(["k", "i", "j"]), f"k {kind}, i bigint, j bigint, rings {RINGS}").select("k", "rings")
    return spread(some, "k").groupBy("k").applyInArrow(kernel(["k"]), f"k {kind}, rings {RINGS}").withColumnRenamed("k", key)
