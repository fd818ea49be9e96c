"""Sparse and dense cell maps.

A map is kept sparse, one row per occupied cell, until an operator needs its
neighbours. A dense map is one array per key in row-major order; its length is
the number of cells of the grid, so it is bounded whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from playframe.functions.gridding import edge_bin, rotate_cell
from playframe.functions.nulls import ratio
from playframe.session import materialize

CELLS = 1 << 18  # cells of dense maps held at once


def histogram2d(points: DataFrame, keys: list[str], x: str, y: str, length, width, n_cols, n_rows,
                count: str = "n") -> DataFrame:
    """Points per cell; points outside fall into the border cells."""
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*keys, edge_bin(y, width, n_rows).alias("row"), edge_bin(x, length, n_cols).alias("col")).agg(
        F.count(F.lit(1)).alias(count)
    )


def with_share(cells: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Share of a cell in the total of its map. The window sees aggregated
    cells, at most one per grid cell and map key."""
    whole = Window.partitionBy(*keys)
    return cells.withColumn(out, F.col(value) / F.sum(value).over(whole))


def densify(cells: DataFrame, keys: list[str], value: str, n_rows: int, n_cols: int, out: str = "cells",
            then: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """One array per map; absent cells are zero and repeated cells add up.
    ``then`` changes the dense maps (one per row) in the same pass."""
    index = (F.col("row") * n_cols + F.col("col")).cast("int")
    summed = cells.groupBy(*keys, index.alias("__i")).agg(F.sum(F.col(value).cast("double")).alias("__v"))
    packed = summed.groupBy(*keys).agg(F.collect_list(F.struct("__i", "__v")).alias("__m"))
    size = n_rows * n_cols
    schema = T.StructType([*[packed.schema[k] for k in keys], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, size):
            listed = part.column(len(keys))
            pair = listed.flatten()
            row = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            dense = np.zeros((len(listed), size))
            dense[row, pair.field(0).to_numpy()] = pair.field(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists(then(dense) if then else dense)], names=[*keys, out])

    return packed.select(*keys, "__m").mapInArrow(fill, schema)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose dense maps have ``CELLS`` cells in all at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, CELLS // size)):
            yield batch.slice(at, max(1, CELLS // size))


def _lists(dense: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(dense) + 1, dtype=np.int32) * dense.shape[1]), pa.array(dense.ravel()))


def sparsify(maps: DataFrame, keys: list[str], cells: str, n_cols: int, value: str = "value") -> DataFrame:
    """Non-zero cells of dense maps."""
    opened = maps.select(*keys, F.posexplode(cells).alias("__i", value)).filter(F.col(value) != 0)
    return opened.select(
        *keys, F.expr(f"__i div {n_cols}").cast("int").alias("row"), (F.col("__i") % n_cols).alias("col"), value
    )


def _spread_bin(cell: str, n_in, n_out: int) -> Column:
    """(bin, weight) structs of the output bins that a unit cell overlaps."""
    n_in = F.lit(n_in) if isinstance(n_in, int) else n_in
    step = n_in / F.lit(n_out)
    j = F.col(cell)
    lo = F.greatest(F.floor(j / step).cast("int") - 1, F.lit(0))
    hi = F.least(F.ceil((j + 1) / step).cast("int"), F.lit(n_out - 1))

    def weigh(i: Column) -> Column:
        top = F.when(i == n_out - 1, n_in.cast("double")).otherwise((i + 1) * step)
        return F.struct(i.alias("bin"), (F.least(top, j + 1.0) - F.greatest(i * step, j.cast("double"))).alias("w"))

    return F.filter(F.transform(F.sequence(lo, hi), weigh), lambda s: s["w"] > 0)


def regrid(cells: DataFrame, keys: list[str], value: str, n_rows_in, n_cols_in, n_rows: int, n_cols: int) -> DataFrame:
    """Mass-conserving change of resolution by overlap. The input shape may be
    a column, so maps of different pitches go through in one plan, and the
    weights are arithmetic, so nothing is joined."""
    opened = cells.withColumns({
        "__r": F.explode(_spread_bin("row", n_rows_in, n_rows)),
    }).withColumn("__c", F.explode(_spread_bin("col", n_cols_in, n_cols)))
    return opened.groupBy(*keys, F.col("__r.bin").alias("row"), F.col("__c.bin").alias("col")).agg(
        F.sum(F.col("__r.w") * F.col("__c.w") * F.col(value)).alias(value)
    )


def rotate(cells: DataFrame, flip: Column, n_rows, n_cols) -> DataFrame:
    """Half turn of the cells where ``flip`` holds."""
    row, cell = rotate_cell("row", "col", n_rows, n_cols, flip)
    return cells.withColumns({"row": row, "col": cell})


def centroid_x(cells: DataFrame, keys: list[str], value: str, n_cols, length: float, out: str) -> DataFrame:
    """Mass centre along the pitch, null for empty maps."""
    n_cols = F.lit(n_cols) if isinstance(n_cols, int) else n_cols
    x = (F.col("col") + 0.5) * F.lit(length) / n_cols
    return cells.groupBy(*keys).agg(ratio(F.sum(F.col(value) * x), F.sum(value)).alias(out))


def smoother(n_rows: int, n_cols: int, sigma: float, truncate: float = 4.0) -> Callable[[np.ndarray], np.ndarray]:
    """Gaussian smoothing of dense maps, one per row; separable, with mirrored borders."""

    radius = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()

    def mixing(n: int) -> np.ndarray:
        """Row i holds the weights of the cells that make up output cell i."""
        m = np.zeros((n, n))
        at = np.arange(n)[:, None] + np.arange(-radius, radius + 1)[None, :]
        at = np.mod(at, 2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        np.add.at(m, (np.repeat(np.arange(n), len(taps)), at.ravel()), np.tile(taps, n))
        return m

    by_row, by_col = mixing(n_rows), mixing(n_cols)

    return lambda dense: (by_row @ dense.reshape(-1, n_rows, n_cols) @ by_col.T).reshape(len(dense), -1)


def smooth(maps: DataFrame, cells: str, n_rows: int, n_cols: int, sigma: float, truncate: float = 4.0) -> DataFrame:
    """``smoother`` over dense maps of a table."""
    names, place, size = maps.columns, maps.columns.index(cells), n_rows * n_cols
    change = smoother(n_rows, n_cols, sigma, truncate)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, size):
            columns = part.columns
            columns[place] = _lists(change(part.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return maps.mapInArrow(apply, maps.schema)


def total_variation(cells: Column, n_rows: int, n_cols: int) -> Column:
    """Sum of the jumps between side-by-side cells over the mass of the map."""
    n = n_rows * n_cols

    def jumps(lag: int) -> Column:
        def add(acc: Column, i: Column) -> Column:
            jump = F.abs(F.get(cells, i) - F.get(cells, i - lag))
            if lag == 1:
                jump = F.when(i % n_cols != 0, jump).otherwise(0.0)
            return acc + jump
        if n <= lag:
            return F.lit(0.0)
        return F.aggregate(F.sequence(F.lit(lag), F.lit(n - 1)), F.lit(0.0), add)

    mass = F.aggregate(cells, F.lit(0.0), lambda a, v: a + v)
    return ratio(jumps(1) + jumps(n_cols), mass)


def isolated_share(cells: Column, n_rows: int, n_cols: int) -> Column:
    """Share of the mass in cells none of whose four neighbours is positive."""
    n = n_rows * n_cols

    def positive(i: Column) -> Column:
        return F.coalesce(F.get(cells, i) > 0, F.lit(False))

    def alone(i: Column) -> Column:
        c = i % n_cols
        return (
            positive(i)
            & ~((c > 0) & positive(i - 1)) & ~((c < n_cols - 1) & positive(i + 1))
            & ~((i >= n_cols) & positive(i - n_cols)) & ~positive(i + n_cols)
        )

    lonely = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), alone)
    kept = F.aggregate(lonely, F.lit(0.0), lambda a, i: a + F.get(cells, i))
    mass = F.aggregate(cells, F.lit(0.0), lambda a, v: a + v)
    return ratio(kept, mass)


def label_correlation(cells: DataFrame, label: str, value: str, n_cells: int, labels: list[str] | None = None,
                      cell: str = "cell") -> DataFrame:
    """Pearson correlation of every pair of labelled maps over all cells, zero
    cells included: one row per pair of the labels in the data, or of ``labels``
    where they are given.

    Every cell becomes one centred vector over the labels; a task adds up the
    products of its cells, so only labels x labels sums leave it.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    named = cells.filter(F.col(label).isNotNull())
    summed = materialize(named.groupBy(cell, label).agg(F.sum(F.col(value).cast("double")).alias("__v")))
    spark, schema = cells.sparkSession, "label_a string, label_b string, corr double"
    sums = {r[0]: r[1] for r in summed.groupBy(label).agg(F.sum("__v")).orderBy(label).collect()}
    labels = list(sums) if labels is None else labels
    if not labels:
        return spark.createDataFrame([], schema)
    mean = np.array([sums.get(x) or 0.0 for x in labels]) / n_cells
    code = {str(x): i for i, x in enumerate(labels)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(mean), len(mean))), 0
        for batch in batches:
            column = batch.column(0)
            flat = column.flatten()
            at = np.array([code.get(x, -1) for x in flat.field(0).to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            x = np.tile(-mean, (len(column), 1))
            x[row[at >= 0], at[at >= 0]] += flat.field(1).to_numpy(zero_copy_only=False)[at >= 0]
            total, n = total + x.T @ x, n + len(column)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(mean)), pa.int32()), pa.array([np.array([float(n)]), *total], pa.list_(pa.float64()))], names=["row", "part"])

    packed = summed.groupBy(cell).agg(F.collect_list(F.struct(F.col(label).cast("string"), "__v")).alias("m")).select("m")
    parts = packed.mapInArrow(products, "row int, part array<double>").groupBy("row").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    found = {r.row: r.part.toArray() for r in parts.collect()}  # labels x labels numbers
    dots = (n_cells - (found[-1][0] if found else 0)) * np.outer(mean, mean)
    if found:
        dots += np.array([found[i] for i in range(len(mean))])
    size = np.sqrt(np.clip(np.diag(dots), 0, None))
    rows = [(a, b, float(dots[i, j] / (size[i] * size[j])) if size[i] and size[j] else None)
            for i, a in enumerate(labels) for j, b in enumerate(labels)]
    return spark.createDataFrame(rows, schema)
