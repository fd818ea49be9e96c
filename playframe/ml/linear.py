"""Principal components by block Krylov iterations over the rows.

A pass multiplies the scatter matrix of the centred vectors with a block of
directions: every task adds up what its rows give, and Spark sums those parts in
slices of features. No d x d matrix is made anywhere. The first block is random,
the next is what the last pass adds to the directions known so far; the components
are those of the scatter matrix within all directions. Passes go on until as many
components as asked for, or as many as hold the share of the variance asked for,
are left with a residual below the tolerance. Vectors no wider than a block are
done after one pass; all other widths take the same path.

The driver holds the directions, d numbers each; their number depends on the
components asked for, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playframe.session import materialize

#: directions of a pass
BLOCK = 64
#: numbers in a slice of partial sums
SLICE = 1 << 15


@dataclass
class Components:
    """Fitted components: rows of ``loadings`` are unit vectors whose largest
    entry by size is positive."""

    mean: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray
    spread: np.ndarray  # variance of every place of the vectors

    def keep(self, k: int) -> "Components":
        return Components(self.mean, self.loadings[:k], self.variance[:k], self.ratio[:k], self.spread)

    def count_for(self, share: float) -> int:
        """Fewest components whose shares add up to ``share``; an error where
        the fitted ones do not reach it."""
        cum = np.cumsum(self.ratio)
        if cum[-1] < share - 1e-9:
            raise ValueError(f"{len(cum)} components hold {cum[-1]:.6f} of the variance, less than {share}: fit more")
        return min(int(np.searchsorted(cum, share)) + 1, len(cum))

    def scores(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        """Project centred vectors."""
        mean, loadings = self.mean, self.loadings
        return _rowwise(df, vector, out, lambda x: (x - mean) @ loadings.T)

    def restore(self, df: DataFrame, scores: str, out: str) -> DataFrame:
        """Map scores back to the vector space."""
        mean, loadings = self.mean, self.loadings
        return _rowwise(df, scores, out, lambda s: s @ loadings + mean)

    def table(self, df: DataFrame) -> DataFrame:
        """Explained variance as a table."""
        cum = np.cumsum(self.ratio)
        rows = [(i + 1, float(v), float(r), float(c)) for i, (v, r, c) in enumerate(zip(self.variance, self.ratio, cum))]
        return df.sparkSession.createDataFrame(rows, "pc int, variance double, ratio double, cumulative double")

    def save(self, spark, path: str) -> None:
        rows = [("mean", -1, 0.0, 0.0, self.mean.tolist()), ("spread", -1, 0.0, 0.0, self.spread.tolist())]
        rows += [("component", i, float(self.variance[i]), float(self.ratio[i]), c.tolist()) for i, c in enumerate(self.loadings)]
        spark.createDataFrame(rows, "kind string, pc int, variance double, ratio double, vector array<double>").write.mode(
            "overwrite").parquet(path)

    @classmethod
    def read(cls, spark, path: str) -> "Components":
        rows = {(r.kind, r.pc): r for r in spark.read.parquet(path).collect()}
        parts = [rows[k] for k in sorted(k for k in rows if k[0] == "component")]
        return cls(np.array(rows[("mean", -1)].vector), np.array([p.vector for p in parts]),
                   np.array([p.variance for p in parts]), np.array([p.ratio for p in parts]), np.array(rows[("spread", -1)].vector))


def _rowwise(df: DataFrame, vector: str, out: str, fn) -> DataFrame:
    """Apply a matrix function to an array column, one Arrow batch at a time."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(fn(np.stack(v.to_numpy()).astype(float)))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(F.col(vector).cast("array<double>")))


def _signed(loadings: np.ndarray) -> np.ndarray:
    peak = loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)]
    return loadings * np.where(peak < 0, -1.0, 1.0)[:, None]


def moments(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and variance over n - 1 of every place, and the number of rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vec = array_to_vector(F.col(vector).cast("array<double>"))
    stats = df.select(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s")).first().s
    return stats.mean.toArray(), stats.variance.toArray(), int(stats["count"])


def scatter_product(df: DataFrame, vector: str, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The scatter matrix of the centred vectors times ``block`` (d x b)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    width, many = block.shape
    step = max(1, SLICE // many)
    shared = df.sparkSession.sparkContext.broadcast((mean, block))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, directions = shared.value
        total = np.zeros((width, many))
        for batch in batches:
            column = batch.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) - centre
            total += x.T @ (x @ directions)
        if total.any():
            parts = [total[k:k + step].ravel() for k in range(0, width, step)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["slice", "part"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(add, "slice int, part array<double>")
    sums = parts.groupBy("slice").agg(Summarizer.sum(array_to_vector("part")).alias("part")).collect()  # d x b numbers
    shared.unpersist()
    out = np.zeros((width, many))
    for row in sums:
        k = row["slice"] * step
        out[k:k + step] = row.part.toArray().reshape(-1, many)
    return out


def _new_directions(found: np.ndarray, known: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal basis of what ``found`` adds to the ``known`` directions."""
    for _ in range(2):
        found = found - known @ (known.T @ found)
    basis, size, _ = np.linalg.svd(found, full_matrices=False)
    basis = basis[:, size > floor]
    basis = basis - known @ (known.T @ basis)
    return np.linalg.qr(basis)[0]


def fit_components(df: DataFrame, vector: str, k: int | None = None, share: float | None = None, tolerance: float = 1e-9,
                   block: int = BLOCK, seed: int = 0) -> Components:
    """Principal components with variances over n - 1: the first ``k``, the
    fewest that hold a ``share`` of the variance, as many as both need where both
    are given, or all that have any. The residual of a component is at most
    ``tolerance`` times the first variance."""
    mean, spread, n = moments(df, vector)
    width, total = len(mean), float(spread.sum())
    if n < 2 or total == 0:
        return Components(mean, np.empty((0, width)), np.empty(0), np.empty(0), spread)
    rows = df.select(vector)
    if width > block:
        rows = materialize(rows)  # read by every pass
    limit = min(width, n - 1)
    wanted = min(k, limit) if k else limit
    rng = np.random.default_rng(seed)
    fresh = np.linalg.qr(rng.normal(size=(width, min(block, width))))[0]
    known, image = np.empty((width, 0)), np.empty((width, 0))
    while True:
        found = scatter_product(rows, vector, mean, fresh) / (n - 1)
        known, image = np.hstack([known, fresh]), np.hstack([image, found])
        inner = known.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = np.clip(values[::-1], 0, None), turn[:, ::-1]
        whole = known.shape[1] >= width or values.sum() >= total * (1 - 1e-12)
        if share is not None:
            reached = np.cumsum(values) >= share * total
            wanted = min(max(k or 1, int(reached.argmax()) + 1), limit) if reached.any() else limit
        loadings = known @ turn[:, :wanted]
        if whole:
            break
        if len(values) >= wanted and (share is None or reached.any()) and (k or share is not None):
            residual = np.linalg.norm(image @ turn[:, :wanted] - loadings * values[:wanted], axis=0)
            if (residual <= tolerance * values[0]).all():
                break
        fresh = _new_directions(found, known, 1e-10 * values[0])
        if not fresh.shape[1]:  # the directions span an invariant space that does not hold all variance
            fresh = _new_directions(rng.normal(size=(width, min(block, width - known.shape[1]))), known, 1e-10)
        fresh = fresh[:, :width - known.shape[1]]
    values, loadings = values[:wanted], loadings[:, :wanted].T
    if not k and share is None:
        has = values > 1e-12 * values[0]
        values, loadings = values[has], loadings[has]
    return Components(mean, _signed(loadings), values, values / total, spread)
