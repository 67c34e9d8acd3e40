"""Whitening of embeddings by the singular value decomposition of their centred, distributed matrix.

Entries are put on an integer grid first, so that counts, sums and deviations are exact. Each distinct grid vector is one
row of the fit. Rows are centred by their exact deviations from the mean, Spark MLlib's RowMatrix.computeSVD gives the
axes, and the singular values, squared and divided by the number of rows, are the variances along them. The total
variance is not the sum of these: it is added up from the exact deviations.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.shared import need, written

_SAFE = float(1 << 62)  # integers below it add and multiply without overflow of a long


@dataclass(frozen=True)
class Whitening:
    """Of vectors of one length: n distinct ones with sums per dimension, the axes (a column each) and variances along
    them in falling order, the total variance, and the largest entry of the whitened fit's covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    def transform(self, deviations: np.ndarray) -> np.ndarray:
        """deviations: n * x - sums as numbers, a row each."""
        return deviations.astype(np.float64) / self.n @ self.axes / np.sqrt(self.variances)


def grid(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of every entry, in double precision; beyond 2^62 the entries are held at that."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(_SAFE)), F.lit(-_SAFE))) + F.lit(shift))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: as longs where these suffice, else as Python's integers."""
    if len(x) and n * float(np.abs(x.astype(np.float64)).max()) + max(map(abs, sums), default=0) >= _SAFE:
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def _squares(dev: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if dev.dtype != object and (not dev.size or (dev.astype(np.float64) ** 2).sum(1).max() < _SAFE):
        return (dev * dev).sum(1).tolist()
    return [sum(v * v for v in row) for row in dev.tolist()]


def _sums(fit: DataFrame, d: int) -> tuple[int, ...]:
    """Exact sums per dimension, in tasks first; d numbers come to the driver."""

    def partial(batches):
        total = [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if len(x) and float(np.abs(x.astype(np.float64)).max()) * len(x) >= _SAFE:
                x = x.astype(object)
            total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    found = fit.select("x").mapInArrow(partial, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by_dim = {r.i: int(r.s) for r in found}
    return tuple(by_dim.get(i, 0) for i in range(d))


def _row_matrix(rows: DataFrame, column: str, n: int, d: int) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"), n, d)


def _fit(fit: DataFrame, n: int, d: int, components: int) -> Whitening:
    sums = _sums(fit, d)

    def centre(batches):
        for batch in batches:
            dev = _deviations(_matrix(batch.column(0), d), n, sums)
            spread = [float(Decimal(s) / Decimal(n * n)) for s in _squares(dev)]
            flat = pa.array((dev.astype(np.float64) / n).ravel())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(dev) + 1, dtype=np.int32) * d), flat), pa.array(spread, pa.float64())], names=["c", "spread"])

    centred = fit.select("x").mapInArrow(centre, "c array<double>, spread double")
    total = (centred.agg(F.sum("spread")).first()[0] or 0.0) / n
    if not total:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    found = _row_matrix(centred, "c", n, d).computeSVD(d if d <= 2048 else min(d, components), computeU=False)
    variances = found.s.toArray() ** 2 / n
    k = int((variances[:components] > variances[0] * d * np.finfo(float).eps).sum())
    axes = found.V.toArray()[:, :k]
    made = Whitening(n, sums, axes / np.linalg.norm(axes, axis=0), variances[:k], total)

    def project(mean):
        def whitened(batches):
            for batch in batches:
                w = made.transform(_deviations(_matrix(batch.column(0), d), n, sums)) - mean
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))], names=["w"])

        return _row_matrix(fit.select("x").mapInArrow(whitened, "w array<double>"), "w", n, k)

    mean = project(np.zeros(k)).computeColumnSummaryStatistics().mean()
    covariance = project(mean).computeGramianMatrix().toArray() / n
    return Whitening(n, sums, made.axes, made.variances, total, float(np.abs(covariance - np.eye(k)).max()))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> tuple[DataFrame, dict[int, Whitening]]:
    """Rows id_col, length, n, deviation and whitened (an array of a number for each component), and the fit per length of vectors.

    Vectors that are null or hold a null or non-finite entry are dropped. All others, those with repeated or null ids, too, get a row; what they
    repeat counts once in the fit. Vectors of different lengths are fitted apart. Directions without variance, up to rounding, are
    no components: a fit of one vector, or of empty ones, has none, and its rows' arrays are empty. deviation, the sum over dimensions of
    (n * x - S)^2, is exact, and null where it is beyond a long. Other columns are not read; no rows give no rows.
    The driver gets one number a dimension, and matrices of one length's size.
    """
    need(vectors, id_col, vector_col)
    value = F.col(vector_col)
    sound = value.isNotNull() & F.coalesce(F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    rows = vectors.filter(sound).select(F.col(id_col).cast("long").alias("id"), grid(value, scale, shift).alias("x"))
    fit = written(rows.select("x").distinct().withColumn("d", F.size("x")), "distinct-vectors")
    fits = {r.d: _fit(fit.filter(F.col("d") == r.d), r.n, r.d, components) if r.d else Whitening(r.n, (), np.zeros((0, 0)), np.zeros(0), 0.0) for r in fit.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}

    def apply(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            for d in np.unique(lengths).tolist():
                at = pa.array(np.flatnonzero(lengths == d))
                made, count = fits[d], len(at)
                dev = _deviations(_matrix(lists.take(at), d), made.n, made.sums) if d else np.zeros((count, 0), np.int64)
                w = made.transform(dev)
                squares = [s if s < 1 << 63 else None for s in _squares(dev)]
                ends = pa.array(np.arange(count + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array(np.full(count, d, np.int32)), pa.array(np.full(count, made.n)), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["id", "length", "n", "deviation", "whitened"])

    out = rows.mapInArrow(apply, "id long, length int, n long, deviation long, whitened array<double>")
    return out.withColumnRenamed("id", id_col), fits


def by_component(rows: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """A row for each component of each of whiten()'s rows: component from 1, whitened, explained, identity_error; rows without components give
    none."""
    shares = [(d, i + 1, float(v / f.total), f.identity_error) for d, f in fits.items() for i, v in enumerate(f.variances)]
    table = F.create_map(*[x for d, i, share, error in shares for x in (F.concat_ws(":", F.lit(d), F.lit(i)), F.struct(F.lit(share).alias("share"), F.lit(error).alias("error")))]) if shares else F.lit(None).cast("map<string,struct<share:double,error:double>>")
    long = rows.select("*", F.posexplode("whitened").alias("_i", "_w")).withColumn("component", F.col("_i") + 1)
    long = long.withColumn("_of", F.element_at(table, F.concat_ws(":", "length", "component")))
    return long.withColumns({"whitened": F.col("_w"), "explained": F.col("_of.share"), "identity_error": F.col("_of.error")}).drop("_i", "_w", "_of", "length")
