"""Percentiles that combine: a digest of counts on the nodes of a dyadic tree over a bounded, ordered universe.

A value is quantized to one of ``2**levels`` leaves, which cover all doubles in their order: leaves are of equal width in the inverse hyperbolic sine, so nearly of equal
width about zero and in proportion to the value far from it. A digest holds counts on tree nodes (heap numbers: the root is 1, node i has the
children 2i and 2i+1). Compression moves the counts of two siblings to their parent while the three together hold at most ``n / k``, from the leaves upward. Then at most ``3 k`` nodes
remain, and the rank of any answer is off by at most ``levels * n / k``, whatever the data. Two digests merge by adding counts node by node and compressing again; the bound stays the same, with n the sum of both.

Rows are folded where they are read (``digests``) or, where repeated rows count once (``digests_of_latest``), after one shuffle by group and a hash of the row's key, so a group with a third of all rows
is many tasks. Folding runs over sorted batches and keeps one digest at a time: no task ever holds a group. Only nodes are shuffled after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digest size: at most ``3 K`` nodes, and a rank error of at most ``levels / K`` of the values (0.5 %).
K = 4600
#: Nodes in one row of a partial digest, so that a batch of rows has a bounded size.
CHUNK = 256


@dataclass(frozen=True)
class Universe:
    """Leaves over all doubles: ``per`` of them to a unit of asinh(value), so at most ``max(|v|, 1) * 1.5 / per`` wide at v. Infinite values have the outermost leaves."""

    per: int = 4096
    levels: int = 23

    @property
    def leaves(self) -> int:
        return 1 << self.levels

    def leaf(self, value: Column) -> Column:
        """The leaf's heap number."""
        size = F.abs(value)
        place = F.when(size < 1e100, F.log(size + F.sqrt(size * size + 1))).otherwise(F.log(size) + math.log(2))
        place = F.floor(F.signum(value) * F.least(place, F.lit(2.0**30)) * self.per) + self.leaves // 2
        return (F.least(F.greatest(place, F.lit(0)), F.lit(self.leaves - 1)) + self.leaves).cast("int")

    def value(self, leaf: np.ndarray) -> np.ndarray:
        """The middle of leaves (0 ..)."""
        with np.errstate(over="ignore"):
            return np.sinh((np.asarray(leaf) - self.leaves // 2 + 0.5) / self.per)


def depth(nodes: np.ndarray) -> np.ndarray:
    return np.frexp(nodes.astype(float))[1] - 1


def compress(nodes: np.ndarray, counts: np.ndarray, levels: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct nodes with their counts, of which no two siblings and their parent hold ``n / k`` or less."""
    nodes, where = np.unique(np.asarray(nodes, np.int64), return_inverse=True)
    counts = np.bincount(where, counts, minlength=len(nodes)).round().astype(np.int64)
    most = int(counts.sum()) // k
    if most < 1:
        return nodes, counts
    kept_nodes, kept_counts = [], []
    at = depth(nodes)
    carried = np.empty(0, np.int64), np.empty(0, np.int64)
    for level in range(levels, 0, -1):
        here = at == level
        n = np.concatenate([nodes[here], carried[0]])
        c = np.concatenate([counts[here], carried[1]])
        n, w = np.unique(n, return_inverse=True)
        c = np.bincount(w, c, minlength=len(n)).astype(np.int64)
        parent, w = np.unique(n >> 1, return_inverse=True)
        both = np.bincount(w, c, minlength=len(parent)).astype(np.int64)
        up = nodes[at == level - 1]
        i = np.searchsorted(up, parent)
        held = np.zeros(len(parent), np.int64)
        if len(up):
            match = (i < len(up)) & (up[np.minimum(i, len(up) - 1)] == parent)
            held[match] = counts[at == level - 1][i[match]]
        move = both + held <= most
        stay = ~move[w]
        kept_nodes.append(n[stay])
        kept_counts.append(c[stay])
        carried = parent[move], both[move]
    root = at == 0
    nodes = np.concatenate([*kept_nodes, nodes[root], carried[0]])
    counts = np.concatenate([*kept_counts, counts[root], carried[1]])
    nodes, where = np.unique(nodes, return_inverse=True)
    return nodes, np.bincount(where, counts, minlength=len(nodes)).round().astype(np.int64)


def ranks(nodes: np.ndarray, counts: np.ndarray, levels: int, shares: list[float]) -> np.ndarray:
    """The leaf (0 ..) that answers each share: the end of the first node, in order of their ends and small ones first, up to which at least that share is counted."""
    span = levels - depth(nodes)
    end = ((nodes + 1) << span) - 1 - (1 << levels)
    order = np.lexsort((span, end))
    total = np.cumsum(counts[order])
    need = np.maximum(np.ceil(np.array(shares) * total[-1]), 1)
    return end[order][np.searchsorted(total, need)]


class _Fold:
    """Digests of groups that arrive one after the other; of the open group only a digest is held."""

    def __init__(self, keys: list[str], fields: tuple[str, ...], levels: int, k: int, chunk: int | None):
        self.keys, self.fields, self.levels, self.k, self.chunk = keys, fields, levels, k, chunk
        self.key: list | None = None
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.ends: dict[str, tuple[int, int]] = {}
        self.out: list[tuple] = []

    def add(self, key: list, field: str, nodes: np.ndarray, counts: np.ndarray, least: int, most: int) -> None:
        if self.key is None or key != self.key:
            self.close()
            self.key = key
        parts = self.held.setdefault(field, [])
        parts.append((nodes, counts))
        a, b = self.ends.get(field, (least, most))
        self.ends[field] = min(a, least), max(b, most)
        if len(parts) > 1 and sum(len(p[0]) for p in parts) > 8 * self.k:
            self.held[field] = [self._one(parts)]

    def _one(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return compress(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), self.levels, self.k)

    def close(self) -> None:
        for field, parts in self.held.items():
            nodes, counts = self._one(parts)
            step = self.chunk or max(len(nodes), 1)
            self.out += [(self.key, field, nodes[i : i + step], counts[i : i + step], *self.ends[field]) for i in range(0, len(nodes), step)]
        self.key, self.held, self.ends = None, {}, {}

    def flush(self, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """What is complete, as rows of the keys, field, n, nodes, counts, least and most."""
        for at in range(0, len(self.out), 2000):
            rows = self.out[at : at + 2000]
            columns = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(types)]
            columns.append(pa.array([r[1] for r in rows], pa.string()))
            columns.append(pa.array([int(r[3].sum()) for r in rows], pa.int64()))
            offsets = np.cumsum([0] + [len(r[2]) for r in rows]).astype(np.int32)
            for i, t in ((2, np.int32), (3, np.int64)):
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[i] for r in rows]).astype(t))))
            columns += [pa.array([r[i] for r in rows], pa.int32()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "field", "n", "nodes", "counts", "least", "most"])
        self.out = []


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _differs(t: pa.Table, columns: list[str]) -> np.ndarray:
    """True for rows that differ from the one before; the first does."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in columns:
        codes = _codes(t.column(c))
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _shape(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys) + "field string, n bigint, nodes array<int>, counts array<bigint>, least int, most int"


def _types(t: pa.RecordBatch | pa.Table, keys: list[str]) -> list[pa.DataType]:
    return [t.schema.field(c).type for c in keys]


def _add_values(fold: _Fold, t: pa.Table, keys: list[str], fields: tuple[str, ...]) -> None:
    """Rows sorted by ``keys``, with a leaf or null in each of ``fields``."""
    if not t.num_rows:
        return
    starts = np.flatnonzero(_differs(t, keys)) if keys else np.zeros(1, int)
    run = np.zeros(t.num_rows, np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    key_rows = [t.column(c).combine_chunks().take(pa.array(starts)).to_pylist() for c in keys]
    per_field = []
    for f in fields:
        leaf = t.column(f).combine_chunks()
        there = leaf.is_valid().to_numpy(zero_copy_only=False)
        pair, count = np.unique((run[there] << 32) | leaf.fill_null(0).to_numpy()[there].astype(np.int64), return_counts=True)
        ends = np.searchsorted(pair >> 32, np.arange(len(starts) + 1))
        per_field.append((pair & 0xFFFFFFFF, count, ends))
    for i in range(len(starts)):
        key = [c[i] for c in key_rows]
        for f, (nodes, count, ends) in zip(fields, per_field, strict=True):
            a, b = ends[i], ends[i + 1]
            if b > a:
                fold.add(key, f, nodes[a:b], count[a:b], int(nodes[a]), int(nodes[b - 1]))


def digests_of_latest(
    df: DataFrame, keys: list[str], values: tuple[str, ...], once: list[str], latest: str, universe: Universe = Universe(), k: int = K, splits: int = 8
) -> DataFrame:
    """As ``digests``, but of rows of one group with the same ``once`` only that with the greatest ``latest`` counts (ties: the greatest leaves), with all its values."""
    leaves = [_leaf(v, universe).alias(f"v{i}") for i, v in enumerate(values)]
    names, fields = [f"k{i}" for i in range(len(keys))], tuple(f"v{i}" for i in range(len(values)))
    ids = [f"o{i}" for i in range(len(once))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], *[F.col(c).alias(n) for c, n in zip(once, ids, strict=True)], F.col(latest).alias("l"), *leaves)
    rows = rows.repartition(*names, F.pmod(F.xxhash64(*ids), F.lit(splits))).sortWithinPartitions(*names, *ids, "l", *fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, types, carried = _Fold(names, fields, universe.levels, k, CHUNK), None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            types = types or _types(t, names)
            if carried is not None:
                t = pa.concat_tables([carried, t])
            new = _differs(t, names + ids)
            last = np.append(new[1:], False)  # the last row may go on in the next batch
            carried = t.slice(t.num_rows - 1)
            _add_values(fold, t.filter(pa.array(last)), names, fields)
            yield from fold.flush(names, types)
        if carried is not None:
            _add_values(fold, carried, names, fields)
            fold.close()
            yield from fold.flush(names, types)

    partial = rows.mapInArrow(kernel, _shape(rows, names))
    return _named(_folded(partial, names, universe, k), names, keys, values)


def digests(df: DataFrame, keys: list[str], values: tuple[str, ...], universe: Universe = Universe(), k: int = K) -> DataFrame:
    """One digest per group of ``keys`` and field of ``values``: the keys, ``field``, ``n``, ``nodes``, ``counts``, and the ``least`` and ``most`` leaf with a value.

    Null and NaN values are left out (infinite ones fall into the outermost leaves); a group with no value has no digest; null keys form a group as any other. Every other row counts as often as it occurs.
    Empty input gives an empty result; other columns are ignored. Rows are folded where they are read.
    """
    leaves = [_leaf(v, universe).alias(f"v{i}") for i, v in enumerate(values)]
    names, fields = [f"k{i}" for i in range(len(keys))], tuple(f"v{i}" for i in range(len(values)))
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], *leaves).sortWithinPartitions(*names) if keys else df.select(*leaves)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, types = _Fold(names, fields, universe.levels, k, CHUNK), None
        for b in batches:
            types = types or _types(b, names)
            _add_values(fold, pa.Table.from_batches([b]), names, fields)
            yield from fold.flush(names, types)
        fold.close()
        if fold.out:
            yield from fold.flush(names, types)

    partial = rows.mapInArrow(kernel, _shape(rows, names))
    return _named(_folded(_folded(partial, names, universe, k, spread=True), names, universe, k), names, keys, values)


def _leaf(value: str, universe: Universe) -> Column:
    v = F.col(value).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), universe.leaf(v))


def _named(d: DataFrame, names: list[str], keys: list[str], values: tuple[str, ...]) -> DataFrame:
    field = F.element_at(F.array(*[F.lit(v) for v in values]), F.substring("field", 2, 9).cast("int") + 1)
    return d.select(*[F.col(n).alias(c) for n, c in zip(names, keys, strict=True)], field.alias("field"), "n", "nodes", "counts", "least", "most")


def _folded(partial: DataFrame, keys: list[str], universe: Universe, k: int, spread: bool = False) -> DataFrame:
    """Partial digests by ``keys`` and field put together: one row each, or with ``spread`` up to 16 groups of rows, so that many partial digests of one key are no single task's."""
    by = [*keys, "field"]
    salt = [F.pmod(F.xxhash64(F.slice("nodes", 1, 4), F.slice("counts", 1, 4)), F.lit(16))] if spread else []
    rows = partial.select(*by, "nodes", "counts", "least", "most").repartition(*by, *salt).sortWithinPartitions(*by)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, types = _Fold(keys, (), universe.levels, k, CHUNK if spread else None), None
        for b in batches:
            types = types or _types(b, keys)
            keyed = list(zip(*[b.column(c).to_pylist() for c in by], strict=True))
            ends = zip(b.column("least").to_pylist(), b.column("most").to_pylist(), strict=True)
            for i, ((*key, field), (least, most)) in enumerate(zip(keyed, ends, strict=True)):
                fold.add(list(key), field, b.column("nodes")[i].values.to_numpy(), b.column("counts")[i].values.to_numpy(), least, most)
            yield from fold.flush(keys, types)
        fold.close()
        if fold.out:
            yield from fold.flush(keys, types)

    return rows.mapInArrow(kernel, _shape(partial, keys))


def merge(d: DataFrame, keys: list[str], universe: Universe = Universe(), k: int = K) -> DataFrame:
    """Digests of the unions of digests by ``keys`` (those of ``d`` or fewer; none: of everything), per field. In two steps, as one key may have any number of digests."""
    return _folded(_folded(d.select(*keys, "field", "n", "nodes", "counts", "least", "most"), keys, universe, k, spread=True), keys, universe, k)


def percentiles(d: DataFrame, shares: tuple[float, ...], universe: Universe = Universe(), k: int = K) -> DataFrame:
    """``d`` without its nodes, with ``percentiles`` (one value per share) and the bound that holds for each.

    The rank of the value's leaf among the n counted ones is at most ``rank_bound`` = ``levels * floor(n / k)`` above the share's; the value is the middle of its leaf (which is none beyond the least and the greatest value's), so it differs
    from a value of the data by less than ``max(|v|, 1) / per``. The outermost leaves, of infinite values, give infinities.
    """
    levels = universe.levels

    @F.arrow_udf("array<double>")
    def answer(nodes: pa.Array, counts: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
        out = []
        for a, b, lo, hi in zip(nodes, counts, least.to_numpy(), most.to_numpy(), strict=True):
            leaf = np.clip(ranks(a.values.to_numpy().astype(np.int64), b.values.to_numpy(), levels, list(shares)), lo - (1 << levels), hi - (1 << levels))
            value = universe.value(leaf)
            out.append(np.where(leaf == 0, -np.inf, np.where(leaf == (1 << levels) - 1, np.inf, value)))
        return pa.array(out, pa.list_(pa.float64()))

    bound = (F.floor(F.col("n") / k) * levels).alias("rank_bound")
    return d.select(*[c for c in d.columns if c not in ("nodes", "counts", "least", "most")], answer("nodes", "counts", "least", "most").alias("percentiles"), bound)
