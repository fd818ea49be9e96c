"""K-means for many settings in shared passes.

A setting is a number of clusters, a seed and, if wanted, one half of the rows. A
pass over the rows moves the centres of every setting that has not come to rest:
a task adds up, per centre, its rows and their number, and Spark sums those parts.
So a sweep over numbers of clusters, starts and halves takes as many passes as its
slowest setting alone.

Starts come from k-means||: per seed and half, two rounds draw rows in proportion to
their distance from those drawn before, over all rows; the drawn ones, weighted by
the rows next to them, are clustered on the driver. They are the same for every
number of clusters, so their passes are shared as well. Draws are by hash: equal
rows are drawn together.

A centre without rows stays where it is; of equally near centres the first counts;
with fewer distinct rows than clusters some centres coincide and the later ones
stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from playframe.ml.linear import moments
from playframe.session import materialize

#: rows whose distances are made at once
BLOCK = 1024


class Setting(NamedTuple):
    k: int
    seed: int = 0
    part: int = -1      # which split of the rows; -1: all rows
    side: bool = True   # which half of that split


@dataclass
class Clusters:
    """Fitted centres with what they cost over the rows they were fitted on."""

    setting: Setting
    centres: np.ndarray
    cost: float

    def assign(self, df: DataFrame, features: str, out: str = "cluster") -> DataFrame:
        return assigned(df, features, {out: self})


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    d = (x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)
    return np.maximum(d, 0.0)


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per row, from its hash."""
    z = h.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2 ** 64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(float) / 2.0 ** 64


class Rows:
    """The written rows of a fit: centred features, halves and a hash."""

    def __init__(self, df: DataFrame, features: str, parts: str | None = None):
        self.mean = moments(df, features)[0]
        halves = F.col(parts) if parts else F.array().cast("array<boolean>")
        x = F.col(features).cast("array<double>")
        self.table = materialize(df.select(x.alias("x"), halves.alias("parts"), F.xxhash64(x).alias("h")))

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        width, mean = len(self.mean), self.mean
        for batch in batches:
            n = batch.num_rows
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, width) - mean
            flags = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(bool)
            flags = flags.reshape(n, -1) if n and len(flags) else np.zeros((n, 0), dtype=bool)
            h = batch.column(2).to_numpy()
            for k in range(0, n, BLOCK):
                yield x[k:k + BLOCK], flags[k:k + BLOCK], h[k:k + BLOCK]

    def _bare(self) -> "Rows":
        out = Rows.__new__(Rows)
        out.mean = self.mean
        return out

    def sums(self, of_block: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
        """One pass: the arrays that ``of_block`` gives per key, summed over all rows."""
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        own = self._bare()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for block in own.blocks(batches):
                for key, v in of_block(*block).items():
                    total[key] = total[key] + v if key in total else v
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["key", "part"])

        parts = self.table.mapInArrow(add, "key int, part array<double>")
        found = parts.groupBy("key").agg(Summarizer.sum(array_to_vector("part")).alias("part")).collect()  # one row per setting
        return {r.key: r.part.toArray() for r in found}

    def points(self, of_block: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[int, float, np.ndarray]]], first: bool) -> dict[int, np.ndarray]:
        """One pass: distinct rows that ``of_block`` names per key; with
        ``first`` the one of the least number."""
        own = self._bare()

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in own.blocks(batches):
                found = of_block(*block)
                if found:
                    keys, numbers, points = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(numbers, pa.float64()), pa.array(points, pa.list_(pa.float64()))],
                                                     names=["key", "number", "point"])

        named = self.table.mapInArrow(name, "key int, number double, point array<double>")
        if first:
            named = named.groupBy("key").agg(F.min_by("point", F.struct("number", "point")).alias("point"))
        out: dict[int, list] = {}
        for r in named.select("key", "point").distinct().orderBy("key", "point").collect():  # bounded by the settings
            out.setdefault(r.key, []).append(r.point)
        return {k: np.array(v) for k, v in out.items()}


def _of_half(x: np.ndarray, parts: np.ndarray, part: int, side: bool) -> np.ndarray:
    return np.ones(len(x), dtype=bool) if part < 0 else parts[:, part] == side


def _starts(rows: Rows, sources: list[tuple[int, int, bool]], drawn: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidates and their weights per (seed, part, side), about 2 * ``drawn``."""

    def least(x, parts, h):
        out = []
        for n, (seed, part, side) in enumerate(sources):
            use = np.flatnonzero(_of_half(x, parts, part, side))
            if len(use):
                u = _uniform(h[use], seed * 1000003 + 1)
                k = int(u.argmin())
                out.append((n, float(u[k]), x[use[k]]))
        return out

    held = rows.points(least, first=True)
    for step in range(2):
        known = {n: c for n, c in held.items()}

        def cost(x, parts, h):
            return {n: np.array([_distances(x[_of_half(x, parts, *sources[n][1:])], c).min(axis=1).sum()]) for n, c in known.items()}

        costs = {n: float(v[0]) for n, v in rows.sums(cost).items()}

        def draw(x, parts, h):
            out = []
            for n, c in known.items():
                seed, part, side = sources[n]
                use = np.flatnonzero(_of_half(x, parts, part, side))
                if len(use) and costs[n] > 0:
                    near = _distances(x[use], c).min(axis=1)
                    for k in np.flatnonzero(_uniform(h[use], seed * 1000003 + 2 + step) < drawn * near / costs[n]).tolist():
                        out.append((n, 0.0, x[use[k]]))
            return out

        for n, more in rows.points(draw, first=False).items():
            held[n] = np.unique(np.concatenate([held[n], more]), axis=0)
    known = dict(held)

    def weigh(x, parts, h):
        return {n: np.bincount(_distances(x[_of_half(x, parts, *sources[n][1:])], c).argmin(axis=1), minlength=len(c)).astype(float) for n, c in known.items()}

    weights = rows.sums(weigh)
    return [(held[n], weights[n]) if n in held else (np.empty((0, len(rows.mean))), np.empty(0)) for n in range(len(sources))]


def _seeded(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of weighted points: drawn by distance, then moved."""
    if not len(points):
        return np.zeros((k, points.shape[1]))
    centres = [points[rng.choice(len(points), p=weight / weight.sum())]]
    while len(centres) < k:
        near = _distances(points, np.array(centres)).min(axis=1) * weight
        centres.append(points[rng.choice(len(points), p=near / near.sum())] if near.sum() > 0 else points[rng.integers(len(points))])
    c = np.array(centres)
    for _ in range(20):
        own = _distances(points, c).argmin(axis=1)
        c = np.array([np.average(points[own == j], axis=0, weights=weight[own == j]) if weight[own == j].sum() > 0 else c[j] for j in range(k)])
    return c


def _moves(settings: list[Setting], centres: dict[int, np.ndarray]) -> Callable:
    """Per setting the sums of the rows of each centre, their numbers, the cost."""
    halves: dict[tuple[int, bool], list[int]] = {}
    for n in centres:
        halves.setdefault(settings[n][2:], []).append(n)

    def move(x, parts, h):
        out = {}
        for (part, side), own in halves.items():
            rows = x[_of_half(x, parts, part, side)]
            d = _distances(rows, np.concatenate([centres[n] for n in own]))
            at = 0
            for n in own:
                k = len(centres[n])
                near = d[:, at:at + k]
                one = near.argmin(axis=1)[:, None] == np.arange(k)
                out[n] = np.concatenate([(one.T.astype(float) @ rows).ravel(), one.sum(axis=0), [near.min(axis=1).sum()]])
                at += k
        return out

    return move


def fit_many(df: DataFrame, features: str, settings: list[Setting], parts: str | None = None, tol: float = 1e-4, rounds: int = 300) -> list[Clusters]:
    """Clusters of every setting. ``parts`` is an array of flags per row that say
    which half of each split it lies in. A setting rests when none of its centres
    moves by more than ``tol``."""
    rows = Rows(df, features, parts)
    sources = sorted({(s.seed, s.part, s.side) for s in settings})
    starts = dict(zip(sources, _starts(rows, sources, 2 * max(s.k for s in settings)), strict=True))
    centres = {n: _seeded(*starts[s.seed, s.part, s.side], s.k, np.random.default_rng(s.seed)) for n, s in enumerate(settings)}
    moving, width = dict(centres), len(rows.mean)
    for _ in range(rounds):
        sums = rows.sums(_moves(settings, moving))
        for n, total in sums.items():
            k = settings[n].k
            size = total[k * width:-1]
            mean = total[:k * width].reshape(k, width) / np.maximum(size, 1)[:, None]
            fresh = np.where(size[:, None] > 0, mean, centres[n])
            if np.sqrt(((fresh - centres[n]) ** 2).sum(axis=1)).max() <= tol:
                del moving[n]
            else:
                moving[n] = fresh
            centres[n] = fresh
        moving = {n: c for n, c in moving.items() if n in sums}
        if not moving:
            break
    costs = rows.sums(_moves(settings, centres))
    return [Clusters(s, centres[n] + rows.mean, float(costs[n][-1]) if n in costs else 0.0) for n, s in enumerate(settings)]


def best(fits: list[Clusters]) -> Clusters:
    """The fit of least cost, the first of equals."""
    return min(fits, key=lambda c: c.cost)


def assigned(df: DataFrame, features: str, fits: dict[str, Clusters]) -> DataFrame:
    """``df`` with a column of cluster numbers for each fit, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast([c.centres for c in fits.values()])

    @pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v.to_numpy()).astype(float)
        origin = shared.value[0].mean(axis=0)
        return pd.Series(list(np.stack([_distances(x - origin, c - origin).argmin(axis=1) for c in shared.value], axis=1).astype(np.int32)))

    labelled = df.withColumn("__near", near(F.col(features).cast("array<double>")))
    return labelled.withColumns({name: F.get("__near", F.lit(i)) for i, name in enumerate(fits)}).drop("__near")


def agreements(df: DataFrame, features: str, pairs: list[tuple[Clusters, Clusters]]) -> list[float]:
    """Adjusted Rand index of each pair of fits over all rows, in one pass."""
    if not pairs:
        return []
    rows = Rows(df, features)
    moved = [(a.centres - rows.mean, b.centres - rows.mean) for a, b in pairs]

    def cross(x, parts, h):
        return {n: np.bincount(_distances(x, a).argmin(axis=1) * len(b) + _distances(x, b).argmin(axis=1), minlength=len(a) * len(b)).astype(float)
                for n, (a, b) in enumerate(moved)}

    counts = rows.sums(cross)
    return [_rand(counts[n].reshape(len(a), len(b))) for n, (a, b) in enumerate(moved)]


def _rand(counts: np.ndarray) -> float:
    def pairs(n) -> float:
        return float((n * (n - 1) / 2).sum())

    both, a, b, total = pairs(counts), pairs(counts.sum(axis=1)), pairs(counts.sum(axis=0)), pairs(counts.sum())
    expected, top = a * b / total, (a + b) / 2
    return 1.0 if top == expected else (both - expected) / (top - expected)


def silhouettes(df: DataFrame, features: str, fits: list[Clusters]) -> list[float]:
    """Mean silhouette of all rows with squared distances, for every fit, in two
    passes: the mean squared distance from a row to a cluster follows from sums
    over the cluster. A row alone in its cluster counts as 0."""
    rows = Rows(df, features)
    centres = [c.centres - rows.mean for c in fits]

    def total(x, parts, h):
        out = {}
        for n, c in enumerate(centres):
            one = (_distances(x, c).argmin(axis=1)[:, None] == np.arange(len(c))).astype(float)
            out[n] = np.concatenate([(one.T @ x).ravel(), one.sum(axis=0), one.T @ (x ** 2).sum(axis=1)])
        return out

    inside = []
    for n, part in sorted(rows.sums(total).items()):
        k = len(centres[n])
        size, square = part[-2 * k:-k], part[-k:]
        inside.append((part[:-2 * k].reshape(k, -1) / np.maximum(size, 1)[:, None], size, square / np.maximum(size, 1)))

    def score(x, parts, h):
        out = {}
        for n, (mean, size, square) in enumerate(inside):
            own, at = _distances(x, centres[n]).argmin(axis=1), np.arange(len(x))
            d = np.maximum((x ** 2).sum(axis=1)[:, None] - 2 * x @ mean.T + square, 0.0)
            a = d[at, own] * size[own] / np.maximum(size[own] - 1, 1)
            d[:, size == 0] = np.inf
            d[at, own] = np.inf
            b, most = d.min(axis=1), np.maximum(a, d.min(axis=1))
            s = np.where((size[own] > 1) & np.isfinite(b) & (most > 0), (b - a) / np.where((most > 0) & np.isfinite(most), most, 1.0), 0.0)
            out[n] = np.array([s.sum(), len(s)])
        return out

    found = rows.sums(score)
    return [float(found[n][0] / found[n][1]) for n in range(len(fits))]
