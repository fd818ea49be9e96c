"""The distributed booster against a plain one that holds all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.ml import boosting, regress
from playframe.ml.boosting import Boosting


def plain(x, y, held, h, edges, cfg):
    """Predictions after all rounds and the held-out losses, row by row in numpy."""
    codes = boosting.encoded(x, edges)
    pred = np.tile(y[~held].mean(axis=0), (len(y), 1))
    losses, rng = [], np.random.default_rng(cfg.seed)
    for t in range(cfg.rounds):
        losses.append(((pred - y)[held] ** 2).sum() / max(1, held.sum()))
        features = range(x.shape[1])
        if cfg.column_share < 1:
            features = sorted(rng.permutation(x.shape[1])[:max(1, round(cfg.column_share * x.shape[1]))])
        seen = ~held & (boosting._drawn(h, t, cfg.row_share) if cfg.row_share < 1 else True)
        gradient, out = pred - y, np.zeros_like(pred)

        def grow(rows, depth, value):
            best = None
            total = gradient[rows & seen]
            for f in features if depth < cfg.depth else ():
                for missing_left in (True, False):
                    for code in range(1, len(edges[f]) + 1):
                        c = codes[:, f]
                        left = np.where(c == 0, missing_left, c <= code)
                        a, b = gradient[rows & seen & left], gradient[rows & seen & ~left]
                        if len(a) < cfg.min_leaf or len(b) < cfg.min_leaf:
                            continue
                        gain = sum((s.sum(0) ** 2).sum() * k / (len(s) + cfg.l2) for s, k in ((a, 1), (b, 1), (total, -1)))
                        if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = (gain, left, *[-cfg.step * s.sum(0) / (len(s) + cfg.l2) for s in (a, b)])
            if best is None:
                out[rows] = value
                return
            grow(rows & best[1], depth + 1, best[2])
            grow(rows & ~best[1], depth + 1, best[3])

        grow(np.ones(len(y), dtype=bool), 0, np.zeros(y.shape[1]))
        pred = pred + out
    losses.append(((pred - y)[held] ** 2).sum() / max(1, held.sum()))
    return pred, losses


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).round(2)
    y = np.column_stack([np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1], x[:, 2] * x[:, 0]]) + 0.1 * rng.normal(size=(300, 2))
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, f"m{i % 10}", [None if np.isnan(v) else float(v) for v in a], b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, g string, x array<double>, y array<double>").repartition(3).persist()


@pytest.mark.parametrize("shares", [(1.0, 1.0), (0.7, 0.75)])
def test_against_a_plain_booster(data, shares, monkeypatch):
    x, y, df = data
    monkeypatch.setattr(boosting, "KEEP", 2)
    cfg = Boosting(rounds=5, step=0.3, depth=3, min_leaf=8, bins=12, hold_out=0.0, row_share=shares[0], column_share=shares[1])
    model = boosting.fit(df, "y", "x", cfg)
    h = np.array([r.h for r in df.select("id", F.xxhash64("x", "y").alias("h")).orderBy("id").collect()])
    want, _ = plain(x, y, np.zeros(len(y), dtype=bool), h, model.edges, cfg)
    got = np.array([r.p for r in model.predict(df, "x", "p").orderBy("id").collect()])
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert len(model.trees) == 5 and not model.losses


def test_stops_on_whole_groups(data):
    x, y, df = data
    cfg = Boosting(rounds=60, step=0.5, depth=3, min_leaf=3, bins=12, hold_out=0.3, patience=3)
    model = boosting.fit(df, "y", "x", cfg, "g")
    assert len(model.trees) == int(np.argmin(model.losses)) < 60 and len(model.losses) <= 61
    ids = df.select("g").distinct()
    from playframe.ml.clusters import below_share

    ticket = F.xxhash64(F.col("g").cast("string"), F.lit(cfg.seed + 1))
    held = {r.g for r in ids.filter(below_share(ids, ticket, 0.3)).collect()}
    assert 0 < len(held) < 10
    mask = np.array([f"m{i % 10}" in held for i in range(len(y))])
    got = np.array([r.p for r in model.predict(df, "x", "p").orderBy("id").collect()])
    assert ((got - y)[mask] ** 2).sum() / mask.sum() == pytest.approx(min(model.losses))


def test_passes_do_not_depend_on_the_outputs(data, monkeypatch):
    _, _, df = data
    passes, plain_splits = [], boosting._Fit.splits
    monkeypatch.setattr(boosting._Fit, "splits", lambda self, *a: passes.append(1) or plain_splits(self, *a))
    counts = []
    for k in (1, 2, 6):
        wide = df.withColumn("w", F.flatten(F.array_repeat(F.slice("y", 1, 1), k)))
        boosting.fit(wide, "w", "x", Boosting(rounds=2, depth=2, hold_out=0.0, bins=8))
        counts.append(len(passes))
        passes.clear()
    assert counts[0] == counts[1] == counts[2]


def test_no_targets_and_constant_features(spark):
    df = spark.createDataFrame([([1.0, 2.0], None)] * 3, "x array<double>, y array<double>")
    with pytest.raises(ValueError):
        boosting.fit(df, "y", "x", Boosting(rounds=2))
    flat = spark.createDataFrame([([1.0, None], [float(i)]) for i in range(40)], "x array<double>, y array<double>")
    model = boosting.fit(flat, "y", "x", Boosting(rounds=3, min_leaf=2))
    assert not model.trees and model.predict(flat, "x", "p").first().p == [19.5]


def test_map_prediction_scores_every_component(data):
    _, _, df = data
    maps = df.withColumn("map", F.concat("y", "y", F.array(F.lit(0.5))))
    out = regress.predict_map(maps, maps, "x", "map", 2, Boosting(rounds=10, step=0.3, depth=3, min_leaf=5, hold_out=0.0)).persist()
    assert out.filter("predicted_errors is not null").count() == 0
    per = {r.pc: r.r2 for r in regress.component_scores(out).collect()}
    assert sorted(per) == [1, 2] and per[1] > 0.5
    broken = regress.predict_map(maps, maps.limit(4), "x", "map", 2, Boosting(rounds=1, bins=999))
    assert all("ValueError" in r.predicted_errors for r in broken.collect())
