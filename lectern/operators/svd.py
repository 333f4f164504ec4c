"""Truncated SVD of a sparse table of cells (row, column, weight) by block power iteration (M5).

One path for every size.  A block of k + `oversample` column vectors is multiplied
by A and by A' as a join with the cells and a sum by key, so a hot row or column is
added up in parallel (map-side) and its join can be split.  The driver holds nothing
but Gram matrices of blocks, whose size depends on k alone.

Each cycle keeps the best vectors (Rayleigh-Ritz) of the span of

    V   the current vectors,
    Z   A'A V, the power step, and
    P   the direction of the last change,

which converges like conjugate gradients instead of like the plain power step.  It
ends when each of the k residuals |A'A v - s^2 v| is below `tol` of its s^2; if the block
is as wide as the matrix has columns, that is after the first step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import stored_at
from lectern.sources.files import delete

OVERSAMPLE = 50
TOL = 1e-7
MAX_CYCLES = 100
STUCK = 8       # cycles that have not halved the residual: rounding is reached


@dataclass
class Svd:
    """rows: (row, x) = U S; columns: (column, x) = V; values: singular values, falling; explained: share of the
    variance of the columns that the factors of the rows keep; residual: the largest relative residual."""

    rows: DataFrame
    columns: DataFrame
    values: list[float]
    explained: float
    residual: float
    cycles: int


class _Kept:
    """Stored blocks.  Those of a cycle are deleted once the next one's are written: what is on disk does not grow with the cycles."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        out, path = stored_at(df, "svd")
        self.paths.append(path)
        return out

    def only(self, last: int) -> None:
        """Deletes all but the `last` blocks."""
        for path in self.paths[:-last]:
            delete(self.spark, path)
        self.paths = self.paths[-last:]


def _times(cells: DataFrame, vectors: DataFrame, on: str, to: str) -> DataFrame:
    """(to, x): for each key `to` the weighted sum of the vectors of its cells."""
    met = cells.join(vectors, on).select(to, "w", array_to_vector("x").alias("v"))
    return met.groupBy(to).agg(Summarizer.sum(F.col("v"), F.col("w")).alias("s")).select(to, vector_to_array("s").alias("x"))


def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gram(vectors: DataFrame) -> np.ndarray:
    """X'X of the block in column x: tasks add up their rows' products, Spark adds those up by line."""
    def products(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = _block(b.column(0))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "line"])

    parts = vectors.select("x").mapInArrow(products, "i long, line array<double>")
    lines = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("line")).alias("s")).select("i", vector_to_array("s").alias("s")).collect()
    out = np.array([r["s"] for r in sorted(lines, key=lambda r: r["i"])])
    return (out + out.T) / 2


def _combined(vectors: DataFrame, key: str, c: np.ndarray) -> DataFrame:
    """(key, x c): a linear map of every row, in place."""
    kind = dict(vectors.dtypes)[key]

    def combine(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_block(b.column(1)) @ c), pa.list_(pa.float64()))], names=[key, "x"])

    return vectors.select(key, "x").mapInArrow(combine, f"`{key}` {kind}, x array<double>")


def _beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Blocks of the same keys side by side."""
    return left.select(key, F.col("x").alias("a")).join(right.select(key, F.col("x").alias("b")), key).select(key, F.concat("a", "b").alias("x"))


def _whitener(gram: np.ndarray) -> np.ndarray:
    """W with W' gram W = I over the directions that are there."""
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    e, u = np.linalg.eigh(gram * scale[:, None] * scale)
    keep = e > 1e-11 * e[-1]
    return scale[:, None] * (u[:, keep] / np.sqrt(e[keep]))


def truncated_svd(cells: DataFrame, row: str, column: str, k: int, oversample: int = OVERSAMPLE, tol: float = TOL,
                  max_cycles: int = MAX_CYCLES) -> Svd | None:
    """The k largest singular values of `cells` (row, column, w) with their factors; cells of one place are one row.
    They are read in every cycle: pass a stored table.

    None if there is no weight at all.  If `max_cycles` or rounding end it first, `residual` says how far it has come.
    """
    cells = cells.select(row, column, F.col("w").cast("double").alias("w"))
    by_column = cells.groupBy(column).agg(F.sum("w").alias("s1"), F.sum(F.col("w") * F.col("w")).alias("s2"))
    moments = by_column.agg(F.count("*").alias("n"), F.sum("s2").alias("s2"), F.sum(F.col("s1") * F.col("s1")).alias("s1")).first()
    if not moments["n"] or not moments["s2"]:
        return None
    wide = min(k + oversample, moments["n"])
    draw = F.transform(F.sequence(F.lit(1), F.lit(wide)), lambda j: F.xxhash64(F.col(column), j).cast("double") / float(1 << 63))
    start = cells.select(column).distinct().withColumn("x", draw)
    w = _whitener(_gram(start))
    kept = _Kept(cells.sparkSession)
    v, b = kept(_combined(start, column, w)), w.shape[1]
    y = kept(_times(cells, v, column, row))
    p = yp = None
    mark, stuck = float("inf"), 0
    for cycle in range(1, max_cycles + 1):
        if b >= moments["n"]:  # the block spans all columns: there is no residual
            e, c = np.linalg.eigh(_gram(y))
            top, lam, residual = c[:, ::-1][:, :k], np.maximum(e[::-1][:k], 0), 0.0
            break
        z = _times(cells, y, row, column)
        x = kept(_beside(v, z, column) if p is None else _beside(_beside(v, z, column), p, column))
        gram = _gram(x)
        t, zz, vv = gram[:b, b:2 * b], gram[b:2 * b, b:2 * b], gram[:b, :b]
        w = _whitener(vv)
        e, c = np.linalg.eigh(w.T @ ((t + t.T) / 2) @ w)
        e, c = e[::-1], (w @ c)[:, ::-1]
        top = c[:, :k]
        lam = np.maximum(e[:top.shape[1]], 0)
        off = np.einsum("ij,ik,kj->j", top, zz, top) - 2 * lam * np.einsum("ij,ik,kj->j", top, t, top) + lam ** 2 * np.einsum("ij,ik,kj->j", top, vv, top)
        residual = float((np.sqrt(np.maximum(off, 0)) / np.maximum(lam, max(1e-8 * lam[0], 1e-300))).max())
        stuck = 0 if residual < 0.5 * mark else stuck + 1
        mark = min(mark, residual) if stuck == 0 else mark
        if residual <= tol or stuck > STUCK or cycle == max_cycles:
            break
        y2 = _times(cells, x.select(column, F.slice("x", b + 1, b).alias("x")), column, row)
        ax = kept(_beside(y, y2, row) if yp is None else _beside(_beside(y, y2, row), yp, row))
        w = _whitener(gram)
        e, c = np.linalg.eigh(w.T @ _gram(ax) @ w)
        c = (w @ c)[:, ::-1][:, :b]
        change = c.copy()
        change[:b] = 0
        both = np.hstack((c, change))
        b = c.shape[1]
        x, ax = kept(_combined(x, column, both)), kept(_combined(ax, row, both))
        kept.only(2)
        part = lambda d, key, at: d.select(key, F.slice("x", at + 1, b).alias("x"))  # noqa: E731,B023
        v, p, y, yp = part(x, column, 0), part(x, column, b), part(ax, row, 0), part(ax, row, b)
    keep = lam > 1e-13 * lam[0]  # the rest is rounding of the Gram matrices
    top, lam = top[:, keep], lam[keep]
    y = y.select(row, "x")
    sums = y.agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("s")).first()
    n_rows, sums = sums["n"], np.array(sums["s"]) @ top
    # variance of the factors over the rows, against that of the matrix's columns
    whole = moments["s2"] / n_rows - moments["s1"] / n_rows ** 2
    explained = float((lam / n_rows - (sums / n_rows) ** 2).sum() / whole) if whole > 0 else 0.0
    return Svd(_combined(y, row, top), _combined(v, column, top), np.sqrt(lam).tolist(), explained, residual, cycle)
