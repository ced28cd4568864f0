"""PCA whitening of embeddings, by a singular value decomposition of centred rows.

Entries become longs, x = floor(64 c) + 1000000.  The fit list has each distinct
x vector once: n vectors with sums S.  With S = n q + r, an entry centred is
(x - q) - r / n, an exact long less one rounded quotient, and n x - S is the long
n (x - q) - r.  The distributed centred rows go to MLlib's computeSVD; a singular
value s gives the eigenvalue s^2 / n of the covariance with divisor n.  The total
variance comes from the exact deviations alone: the sum of (n x - S)^2 over the fit
list, as a decimal, is n^3 times the trace.

The driver holds sums and a matrix of the vectors' dimension squared; rows stay
distributed, and a row becomes COMPONENTS rows in Arrow batches.

Edge cases: rows are left out whose vector is null, empty, holds null or
non-finite entries, an entry beyond 2^52 / 64 (no exact long), or has another
length than most vectors (of equally common lengths the smallest counts);
repeated rows and ids give their rows each, but count once in the fit list.
Components whose variance is under 1e-12 of the largest don't exist, so equal
vectors, one vector or an empty table give no rows.  A deviation beyond a long is
null in the query, and whole in ``deviations``.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import saved, table

#: Fixed values of the task.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Largest size of an entry, and the least share of the largest singular value that counts as one.
MOST, LEAST_SHARE = float((1 << 52) // SCALE), 1e-6

_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    n: int
    quotients: list[int]
    remainders: list[int]
    #: dimension x components, divided by the root of the eigenvalue
    weights: np.ndarray
    explained: list[float]


def quantised(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): whole vectors of the commonest length as longs."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("c"))
    rows = rows.where((F.size("c") > 0) & F.forall("c", lambda c: c.isNotNull() & F.coalesce(F.abs(c) <= MOST, F.lit(False)) & ~F.isnan(c)))
    rows = saved(rows.select("vec_id", F.transform("c", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long")).alias("x")), "vectors")
    # One row per length.
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows if most is None else rows.where(F.size("x") == most.d)


def deviations(fit: Fit) -> Column:
    """The sum over dimensions of (n x - S)^2 of column ``x``, a decimal without rounding."""
    q, r = (F.array(*(F.lit(v) for v in values)) for values in (fit.quotients, fit.remainders))
    apart = F.zip_with(F.zip_with("x", q, lambda x, q: F.lit(fit.n) * (x - q)), r, lambda x, r: x - r)
    whole = "decimal(38,0)"
    return F.aggregate(apart, F.lit(0).cast(whole), lambda sum_, d: (sum_ + (d.cast("decimal(19,0)") * d.cast("decimal(19,0)"))).cast(whole))


def fitted(x: DataFrame) -> tuple[Fit | None, DataFrame]:
    """The components of the distinct vectors of ``x``, and these vectors."""
    distinct = saved(x.select("x").distinct(), "distinct")
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not sums:
        return None, distinct
    n = sums[0].n
    q, r = zip(*(divmod(int(row.s), n) for row in sums))
    centre = [(F.col("x")[i] - q[i]).cast("double") - F.lit(r[i] / n) for i in range(len(q))]
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(F.array(*centre)).alias("v")), "v")
    svd = RowMatrix(rows, n, len(q)).computeSVD(len(q), False, LEAST_SHARE)
    values = svd.s.toArray() ** 2 / n
    fit = Fit(n, list(q), list(r), np.zeros((len(q), 0)), [])
    trace = distinct.agg(F.sum(deviations(fit))).first()[0]
    k = min(COMPONENTS, int(np.count_nonzero(values > 0)))
    if not trace or not k:
        return None, distinct
    vectors = svd.V.toArray()[:, :k]
    # Columns of the fitted directions, each of length 1, over the deviation along them.
    return fit._replace(weights=vectors / np.sqrt(values[:k]), explained=(values[:k] * float(n) ** 3 / float(trace)).tolist()), distinct


def _projected(batch: pa.RecordBatch, fit: Fit) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(fit.quotients))
    return ((x - np.array(fit.quotients)).astype(np.float64) - np.array(fit.remainders) / fit.n) @ fit.weights


def _moments(fit: Fit) -> Callable:
    """Sums of the whitened rows and of their products, a row for each entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.weights.shape[1]
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _projected(batch, fit)
                sums += w.sum(axis=0)
                products += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        columns = [np.append(np.full(k, -1), i), np.append(np.arange(k), j), np.append(sums, products)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "v"])

    return run


def identity_error(distinct: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the covariance of whitened rows less the identity."""
    k = fit.weights.shape[1]
    rows = distinct.select("x").mapInArrow(_moments(fit), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    found = {(row.i, row.j): row.v / fit.n for row in rows}
    return max(abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i in range(k) for j in range(k))


def _whitened_rows(fit: Fit, error: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fit.weights.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            row = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column("vec_id").take(row),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fit.n)),
                batch.column("deviation").take(row),
                pa.array(_projected(batch, fit).ravel()),
                pa.array(np.tile(fit.explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])

    return run


def whitened(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each whole vector and component."""
    x = quantised(embeddings, column)
    fit, distinct = fitted(x)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], _RESULT)
    rows = x.select("vec_id", "x", deviations(fit).try_cast("long").alias("deviation"))
    return rows.mapInArrow(_whitened_rows(fit, identity_error(distinct, fit)), _RESULT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
