"""Whitening of embeddings by the eigenvectors of their covariance, found by cyclic Jacobi rotations.

The fit list is every distinct vector once. Sums, and then the scatter of the centred vectors, are added up in the tasks that hold the
list; the driver sees one row of totals for each cell of a matrix of dimensions, whatever the number of vectors. There, Jacobi rotations go round
all pairs of dimensions until no off-diagonal entry counts against its two diagonal ones, which leaves small eigenvalues as exact as
large ones. The whitening matrix goes to all rows with a broadcast of at most MAX_DIM * components numbers.

Vectors are integers, so centring is exact but for one division: x - S/n is (x - q) - r/n with q, r from S divided by n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
MAX_DIM = 4_096
#: Entries are clipped here, so that sums over 2^10 rows and more stay exact in decimals and x itself in a double.
CLIP = float(2**52)
_BLOCK = 4_096


def quantise(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): x = floor(SCALE * c) + OFFSET for each entry c, without vectors that are null or hold null or non-finite entries.

    Products beyond CLIP are clipped there.
    """
    v = F.col(vector_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = vectors.where(v.isNotNull() & F.forall(v, finite))
    entry = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-CLIP)), F.lit(CLIP))).cast("long") + OFFSET
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, entry).alias("x"))


def _blocks(column: pa.ListArray, dim: int) -> Iterator[np.ndarray]:
    """Vectors of one length as matrices of up to _BLOCK rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dim) if dim else np.zeros((len(column), 0), np.int64)
    for at in range(0, len(rows), _BLOCK):
        yield rows[at : at + _BLOCK]


@dataclass
class Fit:
    """Whitening of the vectors of one length: `basis` has a unit eigenvector a row, `variance` their eigenvalues, both falling."""

    n: int
    sums: list[int]
    variance: np.ndarray
    basis: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s // self.n for s in self.sums], np.int64)) - np.array([s % self.n / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; 0 for those without variance."""
        some = self.variance > 0
        scale = np.where(some, 1 / np.sqrt(np.where(some, self.variance, 1)), 0)
        return (self.centred(x) @ self.basis.T) * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exact; None where that is beyond a long."""
        near = x - np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        most = (float(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2.0**62:
            return np.square(near * self.n - rest).sum(axis=1).tolist()
        exact = [sum(v * v for v in row) for row in (near.astype(object) * self.n - rest.astype(object)).tolist()]
        return [v if v < 2**63 else None for v in exact]


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as rows) of a symmetric matrix, the values falling.

    A sweep rotates every pair of dimensions once, in rounds of disjoint pairs (as in a tournament), which are rotated together. It ends
    with the sweep that finds every off-diagonal entry below rounding against its diagonal ones.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    vectors = np.eye(d)
    players = np.arange(d + d % 2)
    tiny = np.finfo(float).tiny
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(players) - 1):
            p, q = players[: len(players) // 2], players[len(players) // 2 :][::-1]
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            off, left, right = a[p, q], a[p, p], a[q, q]
            big = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(left * right)) + tiny
            if not big.any():
                continue
            rotated = True
            p, q, off, left, right = p[big], q[big], off[big], left[big], right[big]
            theta = (right - left) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, vectors):
                rows_p, rows_q = m[p], m[q]
                m[p], m[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, q] = a[q, p] = 0
            a[p, p], a[q, q] = left - t * off, right + t * off
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[order]


def _sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, sums)} over the fit list; sums are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for dim in np.unique(sizes).tolist():
                own = batch.column(0).filter(pa.array(sizes == dim))
                total = found.setdefault(dim, [0, [0] * dim])
                for x in _blocks(own, dim):
                    high, low = x >> 26, x & ((1 << 26) - 1)  # sums of a block stay within longs
                    part = [(h << 26) + l for h, l in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist())]
                    total[0], total[1] = total[0] + len(x), [a + b for a, b in zip(total[1], part)]
        rows = [(d, i, str(v)) for d, (n, s) in found.items() for i, v in enumerate([n, *s], -1)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dim", "i", "v"]).astype({"dim": "int32", "i": "int32", "v": "str"}), preserve_index=False)

    parts = fit_list.mapInArrow(run, "dim int, i int, v string")
    totals = parts.groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a row a dimension
    table = {(r["dim"], r["i"]): int(r["v"]) for r in totals}
    return {d: (table[d, -1], [table[d, i] for i in range(d)]) for d in {d for d, _ in table}}


def _products(fit_list: DataFrame, fits: dict[int, Fit], of) -> dict[int, np.ndarray]:
    """{length: sum over the fit list of v v'} with v = of(fit, x), a vector a row; x comes centred or whitened, so it is centred before multiplying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for dim in np.unique(sizes).tolist():
                for x in _blocks(batch.column(0).filter(pa.array(sizes == dim)), dim):
                    v = of(fits[dim], x)
                    found[dim] = found.get(dim, 0) + v.T @ v
        for dim, m in found.items():
            i, j = np.triu_indices(len(m))
            columns = [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "i", "j", "v"])

    parts = fit_list.mapInArrow(run, "dim int, i int, j int, v double")
    cells = parts.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # a row a cell of a matrix
    out = {}
    for dim, g in cells.groupby("dim"):
        side = int(g["j"].max()) + 1
        m = np.zeros((side, side))
        m[g["i"], g["j"]] = m[g["j"], g["i"]] = g["v"]
        out[int(dim)] = m
    return out


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A whitening for each length of vectors in `fit_list` (x, each vector once)."""
    fits = {d: Fit(n, s, np.zeros(0), np.zeros((0, d)), 0.0) for d, (n, s) in _sums(fit_list).items()}
    if too_long := [d for d in fits if d > MAX_DIM]:
        raise ValueError(f"vectors of {max(too_long)} dimensions; the driver solves for at most {MAX_DIM}")
    for dim, scatter in _products(fit_list, fits, Fit.centred).items():
        own = fits[dim]
        covariance = scatter / own.n
        values, vectors = jacobi(covariance)
        own.trace = float(np.trace(covariance))
        rounding = len(values) * np.finfo(float).eps * max(own.trace, 0)
        own.variance, own.basis = np.where(values > rounding, values, 0)[:components], vectors[:components]
    return fits


def identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """{length: largest absolute entry of the whitened fit list's covariance minus the identity}, over components with variance."""
    out = {}
    for dim, products in _products(fit_list, fits, Fit.whiten).items():
        some = fits[dim].variance > 0
        rest = (products / fits[dim].n - np.eye(len(products)))[np.ix_(some, some)]
        out[dim] = float(np.abs(rest).max(initial=0))
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): the first components of every vector.

    Rows whose vector is null or holds null or non-finite entries leave. Repeated rows, and rows without an id, come out as often as they are; the
    fit counts each distinct vector once. Vectors of different lengths are fitted apart; those without entries have no component. A
    component without variance is 0 for every row and explains 0. A deviation beyond a long is null. An empty table gives no rows; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = quantise(vectors, id_col, vector_col)
    fit_list = cut(rows.select("x").distinct())
    fits = fit(fit_list, components)
    errors = identity_errors(fit_list, fits)
    sent = spark.sparkContext.broadcast(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(sizes[sizes > 0]).tolist():
                own, at = sent.value[dim], 0
                part = batch.filter(pa.array(sizes == dim))
                for x in _blocks(part.column(1), dim):
                    values = pa.array(own.whiten(x).tolist(), pa.list_(pa.float64()))
                    columns = [part.column(0).slice(at, len(x)), pa.array([dim] * len(x), pa.int32()), pa.array(own.deviation(x), pa.int64()), values]
                    at += len(x)
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "deviation", "values"])

    found = rows.mapInArrow(run, "vec_id long, dim int, deviation long, values array<double>")
    by_length: Column | None = None
    for dim, own in fits.items():
        explained = own.variance / own.trace if own.trace > 0 else own.variance
        known = F.struct(F.lit(own.n).cast("long").alias("n"), F.array(*(F.lit(float(e)) for e in explained)).cast("array<double>").alias("explained"), F.lit(errors.get(dim, 0.0)).alias("error"))
        by_length = F.when(F.col("dim") == dim, known) if by_length is None else by_length.when(F.col("dim") == dim, known)
    if by_length is None:
        by_length = F.lit(None).cast("struct<n:long,explained:array<double>,error:double>")
    flat = found.withColumn("fit", by_length).select("vec_id", "deviation", "fit", F.posexplode("values").alias("at", "whitened"))
    return flat.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.col("fit.n").alias("n"),
        "deviation",
        "whitened",
        F.get("fit.explained", F.col("at")).alias("explained"),
        F.col("fit.error").alias("identity_error"),
    )
