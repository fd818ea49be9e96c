"""Feature preparation: selection, imputation, scaling and group weights.

A feature is a numeric column, or one place of an array column that holds a
map. Only one number per feature reaches the driver; rows stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from playframe.functions import taxonomy
from playframe.operators.quantiles import column_medians, exact_quantiles


def usable_columns(df: DataFrame, columns: list[str], max_null_share: float = 0.6) -> list[str]:
    """Columns with fewer nulls than the share and more than one value. Whether
    a column varies is read from its extremes, so nothing is counted distinct."""
    if not columns:
        return []
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(c).alias(f"c_{i}") for i, c in enumerate(columns)],
        *[(F.min(c) != F.max(c)).alias(f"d_{i}") for i, c in enumerate(columns)],
    ).first()
    return [c for i, c in enumerate(columns) if row["n"] and 1 - row[f"c_{i}"] / row["n"] < max_null_share and row[f"d_{i}"]]


def null_profile(df: DataFrame) -> DataFrame:
    """Null share and exact number of distinct values of every column. The
    columns are stacked, so each value is counted in its own task."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("e")).select("e.*")
    seen = cells.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("column_name").agg(
        (F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_share"),
        F.count("v").alias("n_distinct"))


def impute_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    medians = column_medians(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in columns})


def impute_maps(df: DataFrame, cells: str) -> DataFrame:
    """Fill missing maps with the median of every cell."""
    have = df.filter(F.col(cells).isNotNull())
    if df.filter(F.col(cells).isNull()).isEmpty():
        return df
    med = exact_quantiles(have.select(F.posexplode(cells).alias("i", "v")), ["i"], "v", [0.5]).collect()
    fill = [r.q[0] for r in sorted(med, key=lambda r: r.i)]  # one number per cell
    return df.withColumn(cells, F.coalesce(F.col(cells), F.lit(fill)))


def array_moments(df: DataFrame, cells: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of every place of an array column."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(cells))).alias("s")).first().s
    n = s["count"]
    return s.mean.toArray(), s.variance.toArray() * (n - 1) / n


@dataclass
class Scaling:
    """Centres and divisors per feature, in the order of ``names``."""

    names: list[str]
    groups: list[str]
    mean: np.ndarray
    divisor: np.ndarray
    variance: np.ndarray                     # of the scaled feature
    maps: dict[str, slice] = field(default_factory=dict)

    def group_weights(self, alpha: float, holdout: set[str]) -> np.ndarray:
        """Weight per feature: a group of total variance v ends up with
        v ** (1 - alpha). Held-out groups get zero."""
        groups = np.array(self.groups)
        weight = np.zeros(len(groups))
        for g in sorted(set(self.groups) - holdout):
            at = groups == g
            nominal = self.variance[at].sum()
            if nominal > 0:
                weight[at] = np.sqrt(nominal ** (1.0 - alpha) / nominal)
        return weight

    def shares(self, weight: np.ndarray) -> dict[str, float]:
        """Share of the weighted variance per group, largest first."""
        groups, v = np.array(self.groups), self.variance * weight ** 2
        out = {g: float(v[groups == g].sum() / v.sum()) for g in set(self.groups) if v[groups == g].sum() > 0}
        return dict(sorted(out.items(), key=lambda kv: -kv[1]))


def fit_scaling(df: DataFrame, columns: list[str], maps: dict[str, str] | None = None) -> Scaling:
    """Scaling of columns and map arrays (array column to group).

    Columns are divided by their population deviation; principal scores all by
    that of the first; maps by the deviation of their busiest cell.
    """
    maps = maps or {}
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first() if columns else {}
    mean = [row[f"m_{i}"] for i in range(len(columns))]
    std = [row[f"s_{i}"] for i in range(len(columns))]
    groups = [taxonomy.group_of(c) for c in columns]
    lead = std[columns.index("PC1")] if "PC1" in columns else None
    divisor = [lead if g == "positional_pca" and lead else (s or 1.0) for g, s in zip(groups, std)]
    variance = [(s / d) ** 2 for s, d in zip(std, divisor)]
    names, spans = list(columns), {}
    peaks: dict[str, float] = {}
    moments = {c: array_moments(df, c) for c in maps}
    for c, g in maps.items():
        peaks[g] = max(peaks.get(g, 0.0), float(np.sqrt(moments[c][1].max())))
    for c, g in maps.items():
        m, v = moments[c]
        spans[c] = slice(len(names), len(names) + len(m))
        names += [f"{c}_{i}" for i in range(len(m))]
        groups += [g] * len(m)
        mean += m.tolist()
        divisor += [peaks[g] or 1.0] * len(m)
        variance += (v / (peaks[g] or 1.0) ** 2).tolist()
    return Scaling(names, groups, np.array(mean), np.array(divisor), np.array(variance), spans)


def scaled_vector(df: DataFrame, scaling: Scaling, columns: list[str], weight: np.ndarray | None = None,
                  groups: set[str] | None = None, out: str = "features") -> DataFrame:
    """Scaled and weighted features as one array; features of weight zero and,
    if given, of other groups are left out."""
    w = np.ones(len(scaling.names)) if weight is None else weight
    parts: list[Column] = []

    def used(i: int) -> bool:
        return w[i] > 0 and (groups is None or scaling.groups[i] in groups)

    single = [((F.col(c) - float(scaling.mean[i])) * float(w[i] / scaling.divisor[i])) for i, c in enumerate(columns) if used(i)]
    if single:
        parts.append(F.array(*single))
    for c, span in scaling.maps.items():
        if used(span.start):
            m = F.lit(scaling.mean[span].tolist())
            factor = float(w[span.start] / scaling.divisor[span.start])
            parts.append(F.zip_with(c, m, lambda v, mu: (v - mu) * factor))
    return df.withColumn(out, F.concat(*parts))


def residual_on(df: DataFrame, vector: str, anchors: list[int], out: str) -> DataFrame:
    """Residual of every feature after least squares on a few anchor features
    and a constant. One pass gives the products of all features with the
    anchors; of anchors that depend on each other the shortest solution counts."""
    from playframe.ml.linear import _rowwise, moments, scatter_product

    mean, _, _ = moments(df, vector)
    products = scatter_product(df, vector, mean, np.eye(len(mean))[:, anchors])
    beta = np.linalg.lstsq(products[anchors], products.T, rcond=None)[0]
    return _rowwise(df, vector, out, lambda x: x - mean - (x[:, anchors] - mean[anchors]) @ beta)


def one_hot(df: DataFrame, column: str, values: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Indicator columns of all but the first category in sorted order. The
    categories are a small vocabulary unless ``values`` names them."""
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("None")))
    if values is None:
        values = sorted(r[0] for r in df.select(text).distinct().collect())
    names = {f"fmt_{column}_{v}": (text == v).cast("tinyint") for v in values[1:]}
    return df.withColumns(names) if names else df, list(names)


def block_to_share(base_variance: float, block_variance: float, share: float, base_share: float) -> float:
    """Factor that gives a block its share of the variance next to a base."""
    wanted = base_variance * share / base_share
    return float(np.sqrt(wanted / block_variance)) if block_variance > 0 else 0.0
