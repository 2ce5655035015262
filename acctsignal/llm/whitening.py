"""Whitening of vectors with weighted multiplicities.

Equal vectors are one row with a count. Sums, the covariance and the projection run once per distinct vector, with the
counts (or one) as weights; the results are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctsignal.llm.batches import unused_name
from acctsignal.session import materialize

#: A component counts as one of the fit if its eigenvalue is above this share of the largest.
LEAST_EIGENVALUE = 1e-12
#: Entries of this size or more are no usable numbers: their squares could not be summed exactly.
LARGEST_ENTRY = 1 << 40
#: A vector that more than one in so many rows has goes back to its rows by broadcast: fewer vectors than this.
HOT_ONE_IN = 256


def grid(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * entry) + shift as longs; NULL for a vector that is NULL, empty, or has an unusable entry."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST_ENTRY))
    return F.when(usable & (F.size(vector) > 0), F.transform(
        vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long") + F.lit(shift)))


@dataclass(frozen=True)
class Fit:
    """What a whitening needs: the weight of all vectors, their sum, eigenvectors over roots of eigenvalues.

    ``low`` is the integer part of the mean and ``rest`` n times its fraction, so n*x - S = n*(x - low) - rest.
    """

    n: int
    low: np.ndarray
    rest: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2, exact: 64-bit arithmetic wraps, so it is right whenever the result fits; else None."""
        with np.errstate(over="ignore"):
            difference = np.int64(self.n) * (x - self.low) - self.rest
            exact = (difference * difference).sum(axis=1)
        size = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        return [int(e) if s < 2.0 ** 63 * (1 - 1e-9) else None for e, s in zip(exact, size)]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The rows of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _products(distinct: DataFrame, of, size: int) -> np.ndarray:
    """The weighted sum of v v' over the distinct vectors, ``of`` giving v: a product of matrices per batch, summed by Spark."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                v = of(batch)
                total += (v * batch.column("weight").to_numpy()[:, None]).T @ v
        for i in range(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, i)), pa.array(np.arange(size)), pa.array(total[i])], ["i", "j", "part"])

    found = (distinct.mapInArrow(partial, "i long, j long, part double")
             .groupBy("i", "j").agg(F.sum("part").alias("value")).collect())
    matrix = np.zeros((size, size))
    for i, j, value in found:
        matrix[i, j] = value
    return (matrix + matrix.T) / 2


def fit_whitening(distinct: DataFrame, components: int) -> Fit | None:
    """Fit to ``distinct`` (x: longs, all of one length; weight); None if there is no row.

    The covariance's divisor is the sum of weights. Collected are one sum per dimension and one number per pair of
    dimensions, whatever the number of rows.
    """
    sums = (distinct.select("weight", F.posexplode("x")).groupBy("pos")
            .agg(F.sum("weight").alias("n"),
                 F.sum(F.col("col").cast("decimal(38,0)") * F.col("weight").cast("decimal(19,0)")).alias("s"))
            .orderBy("pos").collect())
    if not sums:
        return None
    n = int(sums[0]["n"])
    low = np.array([int(r["s"]) // n for r in sums], dtype=np.int64)
    rest = np.array([int(r["s"]) % n for r in sums], dtype=np.int64)
    start = Fit(n, low, rest, np.empty((0, 0)), np.empty(0))
    covariance = _products(distinct.select("x", "weight"), lambda b: start.centred(_matrix(b.column("x"))), len(low)) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values[0], 0) * LEAST_EIGENVALUE).sum()))
    return Fit(n, low, rest, vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / np.trace(covariance))


def whiten(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000,
           counted: bool = True) -> DataFrame:
    """``df`` with whitened vectors: its usable rows with the struct ``whitening`` (n, deviation, whitened, explained, identity_error).

    Entries are first put on a grid (see ``grid``). The fit list is all usable vectors, or with ``counted=False`` every
    distinct one once. ``whitened`` and ``explained`` are arrays by falling eigenvalue, of at most ``components`` and of
    no more than the covariance has directions: equal vectors alone have none. ``deviation`` is NULL where it
    does not fit a long. ``identity_error`` is measured on the whitened vectors.

    Rows take no part whose vector is NULL, empty, holds NULL, NaN, infinite or huge entries, or is not of the most
    frequent length (the longer in a tie). Rows that repeat, also ids, stay rows. The new column gets underscores
    if ``df`` has one of that name.
    """
    key, number = unused_name(df, "x"), unused_name(df, "whitening")
    rows = df.withColumn(key, grid(F.col(vector), scale, shift)).where(F.col(key).isNotNull())
    counts = rows.groupBy(F.col(key).alias("x")).agg(F.count("*").alias("copies"))
    distinct = materialize(counts, "distinct-vectors")
    lengths = distinct.groupBy(F.size("x").alias("size")).agg(F.sum("copies").alias("copies"))
    usual = lengths.orderBy(F.desc("copies"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    distinct = distinct.where(F.size("x") == size)
    weight = F.col("copies") if counted else F.lit(1).cast("long")
    fit = fit_whitening(distinct.select("x", weight.alias("weight")), components)
    schema = "x array<long>, copies long, weight long, deviation long, whitened array<double>"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, size), dtype=np.int64)
            projected = fit.centred(x) @ fit.scaled
            ends = pa.array(np.arange(len(x) + 1) * projected.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fit.deviations(x), pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(projected.ravel()))],
                [*batch.schema.names, "deviation", "whitened"])

    shape = "struct<n: long, deviation: long, whitened: array<double>, explained: array<double>, identity_error: double>"
    if fit is None:
        return rows.limit(0).drop(key).withColumn(number, F.lit(None).cast(shape))
    found = materialize(distinct.select("x", "copies", weight.alias("weight")).mapInArrow(project, schema), "whitened")
    kept = fit.scaled.shape[1]
    covariance = _products(found.select("whitened", "weight"), lambda b: _matrix(b.column("whitened")), kept) / fit.n
    error = float(np.abs(covariance - np.eye(kept)).max()) if kept else 0.0

    result = F.struct(
        F.lit(fit.n).cast("long").alias("n"), F.col("deviation"), F.col("whitened"),
        F.array(*map(F.lit, fit.explained.tolist())).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"))
    found = found.select(F.col("x").alias(key), F.col("copies").alias("_copies"), result.alias(number))
    # the vectors of very many rows: fewer than HOT_ONE_IN, whatever the number of rows
    total = usual["copies"]
    hot = F.broadcast(found.where(F.col("_copies") * HOT_ONE_IN > total).drop("_copies"))
    rest = found.where(F.col("_copies") * HOT_ONE_IN <= total).drop("_copies")
    return (rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))
            .drop(key))
