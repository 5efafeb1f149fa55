"""Whitening of embeddings from exact covariances by polarisation.

An entry c becomes the whole number x = floor(256 c).  The statistics come from
each distinct vector once.  With y the values less the floor of their mean, a
covariance follows from variances alone: ``2 Cov(i, j) = Var(i + j) - Var(i) -
Var(j)``.  So one pass adds, for every dimension and every sum of two dimensions,
the values and their squares as whole numbers; the remaining shift by the mean's
fraction is taken out exactly on the driver, which sees d (d + 1) / 2 sums for d
dimensions, and gives the matrix to ``eigh``.  A dimension pair's numbers do not
grow with the rows but by their digits.

Rows whose vector is null or holds null or non-finite entries are dropped.
Vectors shorter than the longest are filled up with zeros, the empty ones
included.  Entries beyond 64 bits are cut to the range of a long.  Repeated rows
are returned each.  Components without variance have no whitened value (null)
and explain nothing; where no component has variance the identity error is
null.  A deviation beyond a long is null.  Only the id and vector are read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import frames
from attestry.session import stored

COMPONENTS = 4
SCALE = 256
# Variances below this part of all are rounding noise.
NOISE = 1e-13
# Rows that are taken at once, by entries of their pair sums.
ENTRIES = 4_000_000


def scaled(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the rows whose entries are all finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # the floor of a double ends at the range of a long; zero has no sign there
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("vec_id"), x.alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """Vectors of a batch as rows of ``d`` whole numbers."""
    lists = batch.column(batch.schema.get_field_index("x"))
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _exact_sums(y: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums and sums of squares of single dimensions and of sums of two, as Python integers."""
    reach = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    if 4 * reach * reach * max(1, len(y)) < 2**62:
        wide = np.concatenate([y, y[:, one] + y[:, two]], axis=1)
        return wide.sum(axis=0).tolist(), np.einsum("ij,ij->j", wide, wide).tolist()
    big = y.astype(object)
    wide = np.concatenate([big, big[:, one] + big[:, two]], axis=1)
    return [int(v) for v in wide.sum(axis=0)], [int(v) for v in (wide * wide).sum(axis=0)]


def _sums(d: int, center: list[int]):
    one, two = np.triu_indices(d, 1)

    def task(batches):
        total, squares = [0] * (d + len(one)), [0] * (d + len(one))
        rows = max(1, ENTRIES // max(1, len(total)))
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                x = _matrix(batch.slice(low, rows), d)
                wide = max(map(abs, center), default=0) >= 2**61 or (x.size and np.abs(x.astype(float)).max() >= 2.0**61)
                y = x.astype(object) - np.array(center, object) if wide else x - np.array(center, np.int64)
                s, q = _exact_sums(y, one, two)
                total, squares = [a + b for a, b in zip(total, s)], [a + b for a, b in zip(squares, q)]
        cells = list(range(len(total)))
        # digits as text: a task's sums have no bound of their own
        columns = [pa.array(cells, pa.int32()), pa.array(map(str, total), pa.string()), pa.array(map(str, squares), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "s", "q"])

    return task


def _added(parts: DataFrame, size: int) -> tuple[list[int], list[int]]:
    """Task sums added in decimals of 18 digits a limb, so that nothing is rounded."""
    base, limbs = 10**18, 6

    def pieces(name):
        digits = F.lpad(F.regexp_replace(name, "^-", ""), 18 * limbs, "0")
        sign = F.when(F.col(name).startswith("-"), -1).otherwise(1)
        return [
            F.sum((F.substring(digits, 18 * k + 1, 18).cast("long") * sign).cast("decimal(38,0)")).alias(f"{name}{k}")
            for k in range(limbs)
        ]

    rows = parts.groupBy("cell").agg(*pieces("s"), *pieces("q")).collect()
    total, squares = [0] * size, [0] * size
    for row in rows:
        for name, out in (("s", total), ("q", squares)):
            for k in range(limbs):
                out[row["cell"]] = out[row["cell"]] + int(row[f"{name}{k}"]) * base ** (limbs - 1 - k)
    return total, squares


class Moments:
    """Count, per-dimension sums and the covariance of the fit list, exact."""

    def __init__(self, fit: DataFrame, d: int):
        self.d = d
        # any whole numbers near the means will do, so rounded sums are enough here
        each = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("s"))
        self.n = fit.count()
        rough = {r.i: r.s for r in each.collect()}
        self.center = [int(rough.get(i, 0.0) // max(1, self.n)) for i in range(d)]
        one, two = np.triu_indices(d, 1)
        parts = frames.map_texts(fit, _sums(d, self.center), "cell int, s string, q string")
        total, squares = _added(parts, d + len(one))
        # n * n times a variance, whole
        spread = [self.n * q - s * s for s, q in zip(total, squares)]
        self.sums = [s + self.n * c for s, c in zip(total, self.center)]
        self.covariance = np.zeros((d, d))
        weight = max(1, self.n) ** 2
        for i in range(d):
            self.covariance[i, i] = float(Fraction(spread[i], weight))
        for k, (i, j) in enumerate(zip(one.tolist(), two.tolist())):
            cross = Fraction(spread[d + k] - spread[i] - spread[j], 2 * weight)
            self.covariance[i, j] = self.covariance[j, i] = float(cross)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) ** 2 of each row."""
    reach = (max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0) * n + max(map(abs, sums), default=0)
    if reach * reach * max(1, x.shape[1]) < 2**62:
        apart = x * n - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", apart, apart).tolist()
    apart = x.astype(object) * n - np.array(sums, object)
    return [int(v) if v < 2**63 else None for v in (apart * apart).sum(axis=1)]


def _projected(moments: Moments, axes: np.ndarray, deviations: bool):
    """Task: deviation and whitened values of every row."""
    mean = [Fraction(s, max(1, moments.n)) for s in moments.sums]
    whole = [int(m // 1) for m in mean]
    part = np.array([float(m - w) for m, w in zip(mean, whole)])
    d, n, sums = moments.d, moments.n, moments.sums

    def task(batches):
        for batch in batches:
            x = _matrix(batch, d)
            wide = max(map(abs, whole), default=0) >= 2**61 or (x.size and np.abs(x.astype(float)).max() >= 2.0**61)
            apart = (x.astype(object) - np.array(whole, object)).astype(float) if wide else (x - np.array(whole, np.int64))
            values = (apart - part) @ axes
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1], values.ravel())
            if deviations:
                columns = [batch.column(0), pa.array(_deviations(x, n, sums), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "values"])
            else:
                yield pa.RecordBatch.from_arrays([lists], names=["values"])

    return task


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and leading component."""
    kept = stored(scaled(rows, vector, key), "white-rows")
    # equal vectors of a task are one row before they are shuffled
    fit = stored(kept.select("x").distinct(), "white-fit")
    d = kept.agg(F.max(F.size("x"))).first()[0] or 0
    moments = Moments(fit, d)
    trace = float(np.trace(moments.covariance))
    values, vectors = np.linalg.eigh(moments.covariance)
    falling = [(float(e), v) for e, v in zip(values, vectors.T)][::-1][:components]
    live = [e > NOISE * trace for e, _ in falling]
    axes = np.zeros((d, len(falling)))
    for k, (e, v) in enumerate(falling):
        if live[k]:
            axes[:, k] = v / np.sqrt(e)
    error = _identity_error(fit, moments, axes[:, live]) if any(live) else None

    kind = kept.schema["vec_id"].dataType.simpleString()
    found = frames.map_texts(kept, _projected(moments, axes, True), f"vec_id {kind}, deviation long, values array<double>")
    names = [(k + 1, bool(on), e / trace if on else 0.0) for k, (on, (e, _)) in enumerate(zip(live, falling))]
    each = found.select("vec_id", "deviation", F.posexplode("values").alias("k", "value"))
    explained = F.element_at(F.array(*[F.lit(e) for _, _, e in names]), F.col("k") + 1) if names else F.lit(0.0)
    has = F.element_at(F.array(*[F.lit(on) for _, on, _ in names]), F.col("k") + 1) if names else F.lit(False)
    return each.select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(moments.n).cast("long").alias("n"),
        "deviation",
        F.when(has, F.col("value")).alias("whitened"),
        explained.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _identity_error(fit: DataFrame, moments: Moments, axes: np.ndarray) -> float:
    """Largest entry of the whitened fit list's measured covariance less the identity."""
    k = axes.shape[1]
    values = frames.map_texts(fit, _projected(moments, axes, False), "values array<double>")
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    column = [F.element_at("values", i + 1) for i in range(k)]
    means = [F.avg(c) for c in column]
    row = values.agg(*means).first()
    centred = [c - F.lit(m) for c, m in zip(column, row)]
    found = values.agg(*[F.avg(centred[i] * centred[j]) for i, j in cells]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(cells, found))
