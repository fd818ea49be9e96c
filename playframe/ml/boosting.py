"""Gradient boosting on binned features, with one tree for all outputs.

Features are cut into quantile bins once, and the binned rows are written. A pass
over them adds up, per feature, node and bin, the rows and the gradients of all
outputs; Spark sums these histograms per feature, and each feature names its best
split of each node in a task of its own. So a level of a tree is one pass, however
many outputs there are, and the driver sees one line per feature and node. Leaves
hold a value per output, shrunk by ``l2``. Predictions are written every
``KEEP`` trees; between, a pass applies the trees since.

Boosting stops where whole held-out groups see no better loss for ``patience``
rounds, and the trees up to the best loss stay. With shares below one, each tree
sees a part of the rows, by a hash, and a part of the features: the second kind of
model. Missing features are a bin of their own that either side of a split takes.
Of equal gains the first feature, and of its bins the first, missing values left,
is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from playframe.session import materialize

#: trees between two written predictions
KEEP = 16
#: relative difference below which two gains are equal
TIE = 1e-9


@dataclass(frozen=True)
class Boosting:
    """Settings of one booster."""

    rounds: int = 500
    step: float = 0.05
    depth: int = 5
    min_leaf: int = 30
    l2: float = 1.0
    bins: int = 64           # 2 to 255; a task holds features x nodes x bins x outputs numbers
    hold_out: float = 0.1    # share of the groups that tell when to stop
    patience: int = 30
    tolerance: float = 1e-7
    row_share: float = 1.0   # of the rows, per tree
    column_share: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes as lists; feature -1 at a leaf. Codes up to ``code`` go left."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, value: np.ndarray) -> int:
        for part, v in ((self.feature, -1), (self.code, 0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, value)):
            part.append(v)
        return len(self.feature) - 1

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node each row of codes ends in."""
        feature, code, missing = np.array(self.feature), np.array(self.code), np.array(self.missing_left)
        left, right = np.array(self.left), np.array(self.right)
        at, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        while (inner := feature[at] >= 0).any():
            own = codes[rows, np.maximum(feature[at], 0)]
            go_left = np.where(own == 0, missing[at], own <= code[at])
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        return at

    def values(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(codes)]


def encoded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Codes of feature values: 0 where missing, else 1 plus the edges below."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i]) + 1)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, nulls as nan."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


@dataclass
class Model:
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[Tree]
    losses: list[float]  # of the held-out groups, before each tree

    def predict(self, df: DataFrame, vector: str, out: str) -> DataFrame:
        """``df`` with the array of outputs for each array of features."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("array<double>")
        def apply(v: pd.Series) -> pd.Series:
            own = model.value
            if not len(v):
                return pd.Series([], dtype=object)
            codes = encoded(np.array(v.tolist(), dtype=float), own.edges)
            total = np.tile(own.base, (len(codes), 1))
            for tree in own.trees:
                total += tree.values(codes)
            return pd.Series(list(total))

        return df.withColumn(out, apply(F.col(vector).cast("array<double>")))


def bin_edges(df: DataFrame, vector: str, width: int, bins: int) -> list[np.ndarray]:
    """Quantiles of every feature, at most ``bins`` - 1."""
    cells = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v")).filter("v is not null and not isnan(v)")
    shares = [(k + 1) / bins for k in range(bins - 1)]
    edges = [np.empty(0)] * width
    for row in cells.groupBy("i").agg(F.percentile_approx("v", shares, 100 * bins).alias("q")).collect():  # features x bins numbers
        edges[row.i] = np.unique(row.q)
    return edges


def _binned(df: DataFrame, vector: str, target: str, held: Column, edges: list[np.ndarray]) -> DataFrame:
    """Codes, outputs, held-out flag and hash of every row."""
    shared = df.sparkSession.sparkContext.broadcast(edges)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            codes = encoded(_matrix(batch.column(0), len(own)), own)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), *batch.columns[1:]], names=["x", *batch.schema.names[1:]])

    features, outputs = F.col(vector).cast("array<double>"), F.col(target).cast("array<double>")
    rows = df.select(features.alias("x"), outputs.alias("y"), held.alias("held"), F.xxhash64(features, outputs).alias("h"))
    return materialize(rows.mapInArrow(code, "x binary, y array<double>, held boolean, h long"))


def _drawn(h: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Rows that a tree sees; equal rows are seen together."""
    z = h.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(float) < share * 2.0 ** 53


class _Fit:
    """The rows of a fit with the predictions of the trees written so far."""

    def __init__(self, rows: DataFrame, width: int, base: np.ndarray, cfg: Boosting):
        self.cfg, self.width, self.base, self.outputs = cfg, width, base, len(base)
        self.rows, self.late = rows, []  # trees since the predictions were written

    def _read(self, batch: pa.RecordBatch, late: list[Tree]) -> tuple[np.ndarray, ...]:
        codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, self.width)
        y = _matrix(batch.column(1), self.outputs)
        p = _matrix(batch.column(4), self.outputs) if batch.num_columns > 4 else np.tile(self.base, (len(y), 1))
        for tree in late:
            p = p + tree.values(codes)
        return codes, y, p, batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy()

    def keep(self) -> None:
        """Write the predictions of all trees so far."""
        late, fit = self.late, self._plain()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = fit._read(batch, late)[2]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(list(p), pa.list_(pa.float64()))], names=["x", "y", "held", "h", "p"])

        self.rows = materialize(self.rows.mapInArrow(add, "x binary, y array<double>, held boolean, h long, p array<double>"))
        self.late = []

    def _plain(self) -> "_Fit":
        out = _Fit.__new__(_Fit)
        out.cfg, out.width, out.base, out.outputs = self.cfg, self.width, self.base, self.outputs
        return out

    def splits(self, tree: Tree, number: int, active: list[int], features: np.ndarray) -> tuple[dict, tuple[float, float]]:
        """The best split of each active node, from one pass: gain, feature,
        code, missing left, and rows and gradients on both sides. Also the rows
        and the loss of the held-out groups."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        fit, cfg, late, size = self._plain(), self.cfg, self.late, self.cfg.bins + 1  # codes, with that of missing values
        slot = np.full(len(tree.feature), -1)
        slot[active] = np.arange(len(active))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(features), len(active), fit.outputs + 1, size))
            rows, loss = 0, 0.0
            for batch in batches:
                codes, y, p, held, h = fit._read(batch, late)
                rows, loss = rows + int(held.sum()), loss + float(((p - y)[held] ** 2).sum())
                at = slot[tree.leaves(codes)]
                use = ~held & (at >= 0)
                if cfg.row_share < 1:
                    use &= _drawn(h, number, cfg.row_share)
                codes, gradient, at = codes[use], (p - y)[use], at[use]
                for n, f in enumerate(features.tolist()):
                    place, cells = at * size + codes[:, f], size * len(active)
                    total[n, :, 0] += np.bincount(place, minlength=cells).reshape(-1, size)
                    for k in range(fit.outputs):
                        total[n, :, k + 1] += np.bincount(place, weights=gradient[:, k], minlength=cells).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *features.tolist()], pa.int32()), pa.array([np.array([rows, loss]), *(t.ravel() for t in total)], pa.list_(pa.float64()))],
                                             names=["feature", "part"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for f, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = part.values.to_numpy()
                    if f < 0:
                        yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([-1], pa.int32()), pa.array([part], pa.list_(pa.float64()))], names=["feature", "node", "found"])
                        continue
                    found = [_best_of(x, cfg) for x in part.reshape(-1, fit.outputs + 1, size)]
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.list_(pa.float64()))],
                                                     names=["feature", "node", "found"])

        parts = self.rows.mapInArrow(count, "feature int, part array<double>")
        sums = parts.groupBy("feature").agg(Summarizer.sum(array_to_vector("part")).alias("part")).select("feature", vector_to_array("part").alias("part"))
        found, seen = {}, (0.0, 0.0)
        for row in sorted(sums.mapInArrow(best, "feature int, node int, found array<double>").collect(), key=lambda r: r.feature):
            if row.feature < 0:
                seen = (row.found[0], row.found[1])
            elif row.found[0] > 0 and (row.node not in found or row.found[0] > found[row.node][0] * (1 + TIE)):
                found[row.node] = (row.found[0], row.feature, *row.found[1:])
        return {active[k]: v for k, v in found.items()}, seen


def _best_of(cells: np.ndarray, cfg: Boosting) -> np.ndarray:
    """Gain (0 if there is none), code, missing left, then rows and gradients
    left and right, of one feature in one node; ``cells`` are
    (1 + outputs) x codes."""
    n, g = cells[0], cells[1:]
    total_n, total_g = n.sum(), g.sum(axis=1)

    def worth(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return (sums ** 2).sum(axis=0) / (rows + cfg.l2)

    best = np.zeros(3 + 2 * len(cells))
    for missing_left in (True, False):
        left_n, left_g = np.cumsum(n[1:]), np.cumsum(g[:, 1:], axis=1)
        if missing_left:
            left_n, left_g = left_n + n[0], left_g + g[:, :1]
        right_n, right_g = total_n - left_n, total_g[:, None] - left_g
        gain = worth(left_n, left_g) + worth(right_n, right_g) - worth(total_n, total_g[:, None])
        gain = np.where((left_n >= cfg.min_leaf) & (right_n >= cfg.min_leaf), gain, 0.0)
        if gain.max() <= 0:
            continue
        k = int((gain >= gain.max() * (1 - TIE)).argmax())
        if gain[k] > best[0] * (1 + TIE):
            best = np.concatenate([[gain[k], k + 1, missing_left, left_n[k]], left_g[:, k], [right_n[k]], right_g[:, k]])
    return best


def fit(train: DataFrame, target: str, vector: str, cfg: Boosting, group: str | None = None) -> Model:
    """Booster for an array of outputs from an array of features; rows without
    outputs are left out. Without ``group``, or with one group, nothing is held out."""
    from playframe.ml.clusters import below_share
    from playframe.ml.linear import moments

    known = train.filter(F.col(target).isNotNull() & ~F.exists(F.col(target).cast("array<double>"), lambda v: v.isNull() | F.isnan(v)))
    if not 2 <= cfg.bins <= 255:
        raise ValueError("bins must be 2 to 255")
    first = known.select(F.size(vector).alias("width")).first()
    if first is None:
        raise ValueError("no row has a target")
    held = F.lit(False)
    if group and cfg.hold_out > 0:
        ids = known.select(group).distinct()
        if ids.limit(2).count() > 1:
            ticket = F.xxhash64(F.col(group).cast("string"), F.lit(cfg.seed + 1))
            held = below_share(ids, ticket, cfg.hold_out)
    edges = bin_edges(known.filter(~held), vector, first.width, cfg.bins)
    rows = _binned(known, vector, target, held, edges)
    base = moments(rows.filter(~F.col("held")), "y")[0]
    state, rng = _Fit(rows, first.width, base, cfg), np.random.default_rng(cfg.seed)
    trees, losses = [], []
    best, waited = np.inf, 0
    while len(trees) < cfg.rounds or losses:  # a last pass gives the loss of all trees
        features = np.arange(first.width)
        if cfg.column_share < 1:
            features = np.sort(rng.permutation(first.width)[:max(1, round(cfg.column_share * first.width))])
        tree, active = Tree(), [0]
        tree.add(np.zeros(len(base)))
        for level in range(cfg.depth):
            found, (n_held, loss) = state.splits(tree, len(trees), active, features)
            if level == 0 and n_held:
                losses.append(loss / n_held)
                waited = 0 if losses[-1] < best * (1 - cfg.tolerance) else waited + 1
                best = min(best, losses[-1])
                if waited > cfg.patience:
                    break
            if len(trees) == cfg.rounds:
                break
            active = []
            for node, (_, feature, code, missing, *sides) in sorted(found.items()):
                tree.feature[node], tree.code[node], tree.missing_left[node] = feature, int(code), bool(missing)
                half = len(sides) // 2
                children = [tree.add(-cfg.step * np.array(s[1:]) / (s[0] + cfg.l2)) for s in (sides[:half], sides[half:])]
                tree.left[node], tree.right[node] = children
                active += children
            if not active:
                break
        if len(tree.feature) == 1:  # the end, or nothing left to split
            break
        trees.append(tree)
        state.late.append(tree)
        if len(state.late) == KEEP:
            state.keep()
    if losses:
        trees = trees[:int(np.argmin(losses))]
    return Model(edges, base, trees, losses)
