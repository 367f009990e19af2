"""Missing numbers and categories filled from similar records: a mixture of Gaussians and categorical distributions, fitted by EM.

A row has numeric columns and categorical ones, any of them missing. Components have a full covariance over the numeric
columns and an independent distribution over each category. The E-step integrates missing values out, pattern by pattern; a missing
number is filled with its conditional expectation, a missing category with its conditional mode.

Fitting scales by sufficient statistics: all rows are first folded into the cells of a fixed grid over the columns (with count and sums),
so that their number is bounded by the grid and not by the rows; each iteration is one distributed pass over the
cells that returns one small matrix per task, and the driver adds these up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Numeric:
    """A numeric column, with the width of its cells and the range that cells cover (values beyond fall into the outer cells)."""

    name: str
    width: float
    low: float
    high: float


@dataclass(frozen=True)
class Category:
    """A categorical column with the values 0 .. ``size`` - 1."""

    name: str
    size: int


@dataclass(frozen=True)
class Mixture:
    """Parameters: weights (k), means (k, d), covariances (k, d, d), one (k, size) table per category."""

    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    tables: tuple[np.ndarray, ...]


def _patterns(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows by which numbers they have."""
    code = (~np.isnan(x)) @ (1 << np.arange(x.shape[1]))
    for c in np.unique(code):
        yield np.flatnonzero(code == c), np.array([bool(c >> i & 1) for i in range(x.shape[1])])


def responsibilities(m: Mixture, x: np.ndarray, cats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """P(component | what the row has), and the rows' log likelihoods. -1 is a missing category, NaN a missing number."""
    k, d = m.mean.shape
    logp = np.tile(np.log(m.weight), (len(x), 1))
    for c, t in zip(cats, m.tables, strict=True):
        have = c >= 0
        logp[have] += np.log(t[:, c[have]]).T
    for rows, has in _patterns(x):
        if not has.any():
            continue
        for j in range(k):
            low = np.linalg.cholesky(m.cov[j][np.ix_(has, has)])
            z = np.linalg.solve(low, (x[rows][:, has] - m.mean[j][has]).T)
            logp[rows, j] -= 0.5 * (z * z).sum(0) + np.log(np.diag(low)).sum() + 0.5 * has.sum() * np.log(2 * np.pi)
    top = logp.max(1, keepdims=True)
    p = np.exp(logp - top)
    total = p.sum(1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def expectations(m: Mixture, x: np.ndarray, j: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows completed under component ``j``, and per pattern of missing numbers their conditional covariance."""
    full, spread = x.copy(), []
    for rows, has in _patterns(x):
        gone = ~has
        if not gone.any():
            continue
        c = m.cov[j]
        if has.any():
            gain = np.linalg.solve(c[np.ix_(has, has)], c[np.ix_(has, gone)]).T
            full[np.ix_(rows, gone)] = m.mean[j][gone] + (x[rows][:, has] - m.mean[j][has]) @ gain.T
            rest = c[np.ix_(gone, gone)] - gain @ c[np.ix_(has, gone)]
        else:
            full[np.ix_(rows, gone)] = m.mean[j][gone]
            rest = c
        extra = np.zeros_like(c)
        extra[np.ix_(gone, gone)] = rest
        spread.append((rows, extra))
    return full, spread


def statistics(m: Mixture, x: np.ndarray, cats: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    """Sufficient statistics of weighted rows: per component its weight, sums, products and category counts; then the log likelihood."""
    r, ll = responsibilities(m, x, cats)
    r *= w[:, None]
    out = []
    for j in range(len(m.weight)):
        full, spread = expectations(m, x, j)
        second = (full * r[:, [j]]).T @ full
        for rows, extra in spread:
            second += r[rows, j].sum() * extra
        counts = [np.bincount(c[c >= 0], r[c >= 0, j], minlength=t.shape[1]) for c, t in zip(cats, m.tables, strict=True)]
        out.append(np.concatenate([[r[:, j].sum()], r[:, j] @ full, second.ravel(), *counts]))
    return np.concatenate([*out, [float(ll @ w)]])


def maximise(stats: np.ndarray, d: int, sizes: list[int], k: int, ridge: np.ndarray) -> Mixture:
    per = stats[:-1].reshape(k, -1)
    n = np.maximum(per[:, 0], 1e-9)
    mean = per[:, 1 : 1 + d] / n[:, None]
    second = per[:, 1 + d : 1 + d + d * d].reshape(k, d, d) / n[:, None, None]
    cov = second - mean[:, :, None] * mean[:, None, :] + np.diag(ridge)
    cov = (cov + cov.transpose(0, 2, 1)) / 2
    for j in range(k):  # a component left with next to nothing keeps a proper covariance
        low = np.linalg.eigvalsh(cov[j])[0]
        if low <= 0:
            cov[j] += np.diag(ridge - 2 * low)
    tables, at = [], 1 + d + d * d
    for size in sizes:
        c = per[:, at : at + size] + 0.5
        tables.append(c / c.sum(1, keepdims=True))
        at += size
    w = (per[:, 0] + 1e-6) / (per[:, 0] + 1e-6).sum()
    return Mixture(w, mean, cov, tuple(tables))


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 1e12), v)


def _arrays(t: pa.RecordBatch, numeric: list[str], cats: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    x = np.stack([t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in numeric], axis=1)
    return x, [t.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(int) for c in cats]


def fit(df: DataFrame, numeric: tuple[Numeric, ...], categories: tuple[Category, ...], components: int = 9, iterations: int = 12, tolerance: float = 1e-4) -> Mixture:
    """The mixture fitted to all rows of ``df``. With no usable rows it is a flat one in the middle of the ranges."""
    names, cats = [n.name for n in numeric], [c.name for c in categories]
    cell = [F.when(_clean(n.name).isNotNull(), F.least(F.greatest(F.floor((_clean(n.name) - n.low) / n.width), F.lit(-1)), F.lit(round((n.high - n.low) / n.width)))).cast("int").alias(f"c_{n.name}") for n in numeric]
    kinds = [F.when(F.col(c.name).between(0, c.size - 1), F.col(c.name)).cast("int").alias(c.name) for c in categories]
    q = df.select(*[_clean(n).alias(n) for n in names], *cell, *kinds)
    cells = q.groupBy(*[f"c_{n}" for n in names], *cats).agg(F.count("*").cast("double").alias("w"), *[F.avg(n).alias(n) for n in names]).select(*names, *cats, "w")
    cells = cut(cells)
    spark, d, k = df.sparkSession, len(names), components

    moments = cells.agg(*[e for n in names for e in (F.sum(F.when(F.col(n).isNotNull(), F.col("w"))), F.sum(F.col("w") * F.col(n)), F.sum(F.col("w") * F.col(n) * F.col(n)))]).first()
    mean, var = np.empty(d), np.empty(d)
    for i, n in enumerate(numeric):
        w, s, s2 = moments[3 * i : 3 * i + 3]
        mean[i] = s / w if w else (n.low + n.high) / 2
        var[i] = max(s2 / w - mean[i] ** 2, n.width**2) if w else ((n.high - n.low) / 4) ** 2
    ridge = np.array([(n.width / 4) ** 2 for n in numeric])
    # The start: components on a lattice along the first two numbers.
    side = max(1, round(k**0.5))
    spots = np.linspace(-1.2, 1.2, side)
    start = np.tile(mean, (k, 1))
    for j in range(k):
        start[j, 0] += spots[j % side] * var[0] ** 0.5
        if d > 1:
            start[j, 1] += spots[(j // side) % side] * var[1] ** 0.5
    m = Mixture(np.full(k, 1 / k), start, np.tile(np.diag(var), (k, 1, 1)), tuple(np.full((k, c.size), 1 / c.size) for c in categories))

    before = -np.inf
    for _ in range(iterations):

        def partial(batches: Iterator[pa.RecordBatch], m: Mixture = m) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                x, c = _arrays(b, names, cats)
                total = total + statistics(m, x, c, b.column("w").to_numpy())
            if not np.isscalar(total):
                yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

        parts = [r[0] for r in cells.mapInArrow(partial, "s array<double>").collect()]
        if not parts:
            break
        stats = np.sum(np.array(parts), axis=0)
        m = maximise(stats, d, [c.size for c in categories], k, ridge)
        if abs(stats[-1] - before) <= tolerance * abs(stats[-1]):
            break
        before = stats[-1]
    return m


def fill(df: DataFrame, m: Mixture, numeric: tuple[Numeric, ...], categories: tuple[Category, ...], row_id: str, targets: tuple[str, ...]) -> DataFrame:
    """``row_id`` and, for each target, ``x`` (its value, filled where it was missing) and ``x_filled`` (true where it was)."""
    names, cats = [n.name for n in numeric], [c.name for c in categories]
    sizes = {c.name: c.size for c in categories}
    id_type = df.schema[row_id].dataType.simpleString()
    own = df.select(F.col(row_id).alias("row_id"), *[_clean(n).alias(n) for n in names], *[F.when(F.col(c).between(0, sizes[c] - 1), F.col(c)).cast("int").alias(c) for c in cats])

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = _arrays(b, names, cats)
            r, _ = responsibilities(m, x, c)
            out = {"row_id": b.column("row_id")}
            need = [names.index(t) for t in targets if t in names]
            if need:
                expected = np.zeros_like(x)
                for j in range(len(m.weight)):
                    expected += r[:, [j]] * expected_rows(m, x, j)
            for t in targets:
                if t in names:
                    i = names.index(t)
                    gone = np.isnan(x[:, i])
                    out[t] = pa.array(np.where(gone, expected[:, i], x[:, i]))
                else:
                    i = cats.index(t)
                    gone = c[i] < 0
                    out[t] = pa.array(np.where(gone, (r @ m.tables[i]).argmax(1), c[i]).astype(np.int32))
                out[f"{t}_filled"] = pa.array(gone)
            yield pa.RecordBatch.from_pydict(out)

    kinds = ", ".join(f"`{t}` {'double' if t in names else 'int'}, `{t}_filled` boolean" for t in targets)
    return own.mapInArrow(complete, f"row_id {id_type}, {kinds}").withColumnRenamed("row_id", row_id)


def expected_rows(m: Mixture, x: np.ndarray, j: int) -> np.ndarray:
    return expectations(m, x, j)[0]


#: The sky over a station: infrared radiation (J/cm² in an hour), air temperature, what others of its department had at that hour.
SKY_NUMBERS = (Numeric("INFRAR", 8.0, 30.0, 190.0), Numeric("T", 3.0, -40.0, 45.0), Numeric("INFRAR_near", 8.0, 30.0, 190.0))
SKY_CATEGORIES = (Category("N", 9), Category("N_near", 9))


def sky_records(resolved: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows with INFRAR, N (oktas), T and the means of other stations of the same ``dep`` in the same hour.

    ``resolved`` has obs_id, station_id, minute, INFRAR_value, N_value, T. Rows without a time or dep have no company.
    The mean leaves the row itself out. Repeated station rows count once.
    """
    deps = stations.groupBy("station_id").agg(F.min("dep").alias("dep"))
    t = F.col("T").cast("double")
    x = resolved.withColumn("T", F.when(t.between(-60, 60), t))
    x = x.join(deps, "station_id", "left").select("obs_id", "dep", F.floor(F.col("minute") / 60).alias("hour"), F.col("INFRAR_value").cast("float").alias("INFRAR"), F.round("N_value").cast("tinyint").alias("N"), F.col("T").cast("float").alias("T"))
    x = cut(x)
    company = x.where("dep is not null and hour is not null and (INFRAR is not null or N is not null)").groupBy("dep", "hour").agg(F.sum("INFRAR").alias("s_ir"), F.count("INFRAR").alias("n_ir"), F.sum("N").alias("s_n"), F.count("N").alias("n_n"))
    x = x.join(company, ["dep", "hour"], "left")
    rest = lambda c, s, n: F.try_divide(F.col(s) - F.coalesce(c, F.lit(0)), F.col(n) - F.when(F.col(c).isNotNull(), 1).otherwise(0))
    return x.withColumns({"INFRAR_near": rest("INFRAR", "s_ir", "n_ir"), "N_near": F.round(rest("N", "s_n", "n_n")).cast("int")}).select("obs_id", "INFRAR", "T", "INFRAR_near", "N", "N_near")


def fill_sky(records: DataFrame) -> DataFrame:
    """obs_id, INFRAR, INFRAR_filled, N, N_filled of ``sky_records``.

    Every row gets both values. Nulls in any column are integrated out, a row with none of them gets the mixture's mean and mode; ties between
    categories go to the smaller one. Repeated rows weigh as often as they occur. Empty input gives an empty result.
    """
    m = fit(records, SKY_NUMBERS, SKY_CATEGORIES)
    return fill(records, m, SKY_NUMBERS, SKY_CATEGORIES, "obs_id", ("INFRAR", "N"))
