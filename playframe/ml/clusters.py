"""Clustering and its diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from playframe.functions.nulls import ratio
from playframe.ml import kmeans
from playframe.ml.prepare import array_moments


def shift_tolerance(df: DataFrame, features: str, relative: float = 1e-4) -> float:
    """Centre shift below which a fit has converged, relative to the mean
    variance of the features."""
    _, variance = array_moments(df.withColumn("__f", F.col(features).cast("array<double>")), "__f")
    return float(np.sqrt(relative * variance.mean())) or relative


def best_kmeans(df: DataFrame, k: int, n_init: int = 10, seed: int = 0, features: str = "features", tol: float = 1e-4) -> kmeans.Clusters:
    """Clusters of least cost over several starts."""
    return kmeans.best(kmeans.fit_many(df, features, [kmeans.Setting(k, seed + i) for i in range(n_init)], tol=tol))


def contingency_ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency counts."""
    pairs = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = pairs.select(F.lit("cell").alias("kind"), "n")
    for kind, c in (("a", a), ("b", b)):
        counts = counts.unionByName(pairs.groupBy(c).agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "n"))
    two = F.col("n") * (F.col("n") - 1) / 2

    def of(kind: str, value) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    j = counts.agg(of("cell", two).alias("both"), of("cell", F.col("n")).alias("n"), of("a", two).alias("sa"), of("b", two).alias("sb"))
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("sa") * F.col("sb") / total
    top = (F.col("sa") + F.col("sb")) / 2
    return j.select(F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def hash_order(keys: list[str], seed: int) -> Column:
    """Repeatable pseudo-random ticket of a row."""
    return F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit(seed))


def silhouette(df: DataFrame, label: str, features: str = "features") -> float:
    """Mean silhouette of all rows with squared Euclidean distances, which
    follow from sums per cluster: no row is compared with another."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    v = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("__v"), F.col(label).cast("double").alias("__c"))
    return float(ClusteringEvaluator(featuresCol="__v", predictionCol="__c", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(v))


def sampled_silhouette(df: DataFrame, label: str, sample: int, features: str = "features", keys: list[str] | None = None, seed: int = 0) -> float:
    """Mean silhouette with Euclidean distances over ``sample`` rows, for those
    who ask for it.

    The sampled rows are the points compared with each other. Their number is
    fixed, so they travel to every task; the distances are made in the tasks.
    """
    picked = df.select(features, F.col(label).cast("int").alias("__c"), hash_order(keys or [features], seed).alias("__t"))
    picked = picked.orderBy("__t").limit(sample)
    rows = picked.collect()  # bounded by ``sample``
    points = np.array([r[0] for r in rows], dtype=float)
    labels = np.array([r[1] for r in rows])
    kinds, code = np.unique(labels, return_inverse=True)
    member = np.eye(len(kinds))[code]
    size = member.sum(axis=0)
    square = (points ** 2).sum(axis=1)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((points, square, member, size, code))

    @pandas_udf("double")
    def score(i: pd.Series) -> pd.Series:
        pts, sq, mem, n, lab = shared.value
        at = i.to_numpy()
        out = np.zeros(len(at))
        for start in range(0, len(at), 512):
            r = at[start:start + 512]
            d = np.sqrt(np.maximum(sq[r][:, None] + sq[None, :] - 2 * pts[r] @ pts.T, 0.0))
            d[np.arange(len(r)), r] = 0.0
            sums = d @ mem
            own = lab[r]
            rows_ = np.arange(len(r))
            inside = sums[rows_, own] / np.maximum(n[own] - 1, 1)
            mean = sums / n[None, :]
            mean[rows_, own] = np.inf
            outside = mean.min(axis=1)
            s = (outside - inside) / np.maximum(inside, outside)
            out[start:start + 512] = np.where(n[own] > 1, s, 0.0)
        return pd.Series(out)

    index = spark.range(len(points))
    return float(index.select(F.avg(score("id"))).first()[0])


def below_share(ids: DataFrame, ticket: Column, share: float) -> Column:
    """Whether a ticket lies in the lower ``share`` of all 64-bit values; the
    smallest ticket always does and the largest never, if there are two."""
    b = ids.agg(F.min(ticket).alias("lo"), F.max(ticket).alias("hi")).first()
    limit = int((share - 0.5) * 2.0**64)
    if b.lo is not None:
        limit = min(max(limit, b.lo + 1), max(b.hi, b.lo + 1))
    return ticket < F.lit(max(min(limit, 2**63 - 1), -(2**63)))


def sweep(df: DataFrame, ks: list[int], features: str = "features", keys: list[str] | None = None, n_init: int = 10,
          sample: int | None = None, repeats: int = 5, group: str = "match_id", half_inits: int = 3) -> tuple[DataFrame, DataFrame]:
    """Cluster for every k. Returns the rows with ``cluster_k*`` columns and
    the table of silhouette, inertia and stability.

    Stability is the mean and deviation, over ``repeats``, of the agreement on
    all rows of clusters fitted on two disjoint halves of the groups, split by
    hash order. All fits share their passes.
    """
    flags = []
    if repeats:
        ids = df.select(group).distinct()
        flags = [below_share(ids, hash_order([group], r), 0.5) for r in range(repeats)]
    base = df.withColumn("__parts", F.array(*flags)) if repeats else df
    halves = [(r, side) for r in range(repeats) for side in (True, False)]
    settings = [kmeans.Setting(k, i) for k in ks for i in range(n_init)]
    settings += [kmeans.Setting(k, r + (0 if side else 100) + i, r, side) for k in ks for r, side in halves for i in range(half_inits)]
    fits: dict[tuple, list] = {}
    for c in kmeans.fit_many(base, features, settings, "__parts" if repeats else None, shift_tolerance(df, features)):
        fits.setdefault((c.setting.k, c.setting.part, c.setting.side), []).append(c)
    chosen = {key: kmeans.best(found) for key, found in fits.items()}
    whole = {k: chosen[k, -1, True] for k in ks}
    labelled = kmeans.assigned(df, features, {f"cluster_k{k}": c for k, c in whole.items()})
    if sample:
        scores = [sampled_silhouette(labelled, f"cluster_k{k}", sample, features, keys) for k in ks]
    else:
        scores = kmeans.silhouettes(df, features, list(whole.values()))
    agreed = kmeans.agreements(df, features, [(chosen[k, r, True], chosen[k, r, False]) for k in ks for r in range(repeats)])
    table = []
    for n, k in enumerate(ks):
        own = agreed[n * repeats:(n + 1) * repeats]
        mean, std = (float(np.mean(own)), float(np.std(own))) if own else (None, None)
        table.append((k, scores[n], whole[k].cost, mean, std))
    return labelled, df.sparkSession.createDataFrame(
        table, "k int, silhouette double, inertia double, stability_ari_mean double, stability_ari_std double")


def eta_squared(df: DataFrame, label: str, features: str, names: list[str] | None = None) -> DataFrame:
    """Share of the variance of every feature that lies between clusters.

    Mean and variance per (cluster, feature) are combined map-side; the rest
    works on clusters x features rows. Squares are taken of differences from the
    mean only, so far-off values keep their digits.
    """
    long = df.select(F.col(label).alias("__c"), F.posexplode(F.col(features).cast("array<double>")).alias("i", "v")).filter(F.col("v").isNotNull())
    per = long.groupBy("__c", "i").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("q"))
    mean = per.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"))
    off = F.col("m") - F.col("mu")
    g = per.join(mean, "i").groupBy("i").agg(F.sum(F.col("n") * off * off).alias("between"), F.sum(F.col("n") * F.col("q")).alias("within"))
    out = g.select("i", F.coalesce(ratio("between", F.col("between") + F.col("within")), F.lit(0.0)).alias("eta_squared"))
    return out.withColumn("feature", F.get(F.lit(names), F.col("i"))) if names else out


def group_importance(importance: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Mean eta squared per feature group, highest first."""
    lookup = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.lit(v))])
    tagged = importance.withColumn("group", F.coalesce(F.try_element_at(lookup, F.col("feature")), F.lit("other")))
    return tagged.groupBy("group").agg(F.avg("eta_squared").alias("eta_squared")).orderBy(F.desc("eta_squared"), "group")


def profile(df: DataFrame, label: str, columns: list[str], digits: int = 2) -> DataFrame:
    """Rounded means and size per cluster."""
    return df.groupBy(label).agg(*[F.bround(F.avg(c), digits).alias(c) for c in columns], F.count(F.lit(1)).alias("n_phases"))
