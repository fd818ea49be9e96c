"""Blocked ordered operators against plain pandas, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playframe.operators import ordered as od
from playframe.operators import ranges
from playframe.operators.quantiles import column_medians, exact_quantiles


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))
    t = rng.integers(0, 200, n).astype(float)
    v = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
    return pd.DataFrame({"k": key, "t": t, "id": np.arange(n), "v": v, "w": rng.integers(0, 3, n)})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize("width", [3.0, 1000.0])
def test_all_requests_match_pandas(spark, rows, width):
    out = od.ordered(
        frame(spark, rows), ["k"], ["t", "id"], width, lag={"before": F.col("id")}, lead={"after": F.col("id")},
        cumsum={"run": F.col("w")}, cummax={"top": F.col("v")}, fill_forward={"ff": F.col("v")}, fill_backward={"bf": F.col("v")}, index="pos").toPandas()
    out = out.sort_values(["k", "t", "id"]).reset_index(drop=True)
    want = rows.sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = want.groupby("k")
    np.testing.assert_array_equal(out["id"], want["id"])
    np.testing.assert_array_equal(out["before"].fillna(-1), g["id"].shift(1).fillna(-1))
    np.testing.assert_array_equal(out["after"].fillna(-1), g["id"].shift(-1).fillna(-1))
    np.testing.assert_array_equal(out["run"], g["w"].cumsum())
    np.testing.assert_allclose(out["top"], g["v"].cummax().groupby(want["k"]).ffill())
    np.testing.assert_array_equal(out["pos"], g.cumcount())
    np.testing.assert_allclose(out["ff"], g["v"].ffill())
    np.testing.assert_allclose(out["bf"], g["v"].bfill())


def test_lag_tells_null_value_from_missing_row(spark):
    df = spark.createDataFrame([(1, 0.0, None), (1, 10.0, 5), (1, 20.0, 6)], "k int, t double, v int")
    out = od.ordered(df, ["k"], ["t"], 5.0, lag={"p": F.struct("v")}).orderBy("t").collect()
    assert out[0].p is None and out[1].p.v is None and out[2].p.v == 5


def test_null_keys_and_null_order_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (1, None), (1, 3.0)], "k int, t double")
    out = od.ordered(df, ["k"], ["t"], 1.0, index="i")
    assert sorted((r.k or 0, r.i) for r in out.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_islands_and_changes(spark):
    data = [(1, i, c) for i, c in enumerate("aabbba")] + [(2, 0, "a")]
    df = spark.createDataFrame(data, "k int, i int, c string")
    got = {(r.k, r.i): r.island for r in od.islands(df, ["k"], ["i"], "c", 2.0).collect()}
    assert [got[(1, i)] for i in range(6)] == [0, 0, 1, 1, 1, 2] and got[(2, 0)] == 0
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(["h", None, "h", None, "a", "a", "h"])], "k int, i int, c string")
    assert sorted(r.i for r in od.changes(df, ["k"], ["i"], "c", 2.0).collect()) == [4, 6]


def test_steps_bridge_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, None, None), (1, 2, 3.0, 4.0)], "k int, i int, x double, y double")
    assert [r.step for r in od.steps(df, ["k"], ["i"], "x", "y", 1.0).orderBy("i").collect()] == [None, 5.0]


def test_top_per_key_breaks_ties_by_text(spark):
    df = spark.createDataFrame([(1, 9, 5), (1, 10, 5), (1, 11, 7)], "k int, item int, n int")
    got = od.top_per_key(df, ["k"], [F.desc("n"), F.col("item").cast("string")], 2)
    assert [r.item for r in got.orderBy("rank").collect()] == [11, 10]


def test_asof_clamps_and_takes_first_of_ties(spark):
    s = spark.createDataFrame([(1, 1.0, 10), (1, 5.0, 12), (1, 5.0, 11)], "k int, t double, f long")
    q = spark.createDataFrame([(1, 0.0, 1), (1, 1.0, 2), (1, 1.1, 3), (1, 99.0, 4), (2, 1.0, 5)], "k int, x double, q int")
    got = {r.q: r.f for r in ranges.asof_forward(q, s, ["k"], "x", "t", "f", ["f"], 2.0).collect()}
    assert got == {1: 10, 2: 10, 3: 11, 4: 11}


def test_intervals_are_closed_and_last_written_wins(spark):
    p = spark.createDataFrame([(1, i) for i in range(12)], "k int, f int")
    s = spark.createDataFrame([(1, 2, 5, 0, "a"), (1, 5, 7, 1, "b"), (1, 9, 8, 2, "c")], "k int, s int, e int, o int, v string")
    got = {r.f: r.v for r in ranges.stamp_last(p, s, ["k"], "f", "s", "e", "o", "v", 3.0).collect()}
    assert [got[i] for i in range(12)] == [None, None, "a", "a", "a", "b", "b", "b", None, None, None, None]


def test_overlap_ties_go_to_the_earlier(spark):
    a = spark.createDataFrame([(1, 7, 0.0, 10.0), (1, 8, 20.0, 21.0)], "k int, id int, s double, e double")
    b = spark.createDataFrame([(1, 0.0, 4.0, "x"), (1, 6.0, 10.0, "y"), (1, 10.0, 30.0, "z")], "k int, bs double, be double, v string")
    got = {r.id: (r.v, r.overlap) for r in ranges.best_overlap(a, b, ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], 3.0).collect()}
    assert got == {7: ("x", 4.0), 8: ("z", 1.0)}


def plain_overlaps(a, b):
    """Best of all pairs: (key, id) -> (overlap, start)."""
    best = {}
    for k, i, s, e in a:
        for k2, bs, be, _ in b:
            if k == k2 and None not in (k, s, e, bs, be) and s <= e and bs <= be and bs < e and be > s:
                best[k, i] = max(best.get((k, i), (-1, 0)), (min(e, be) - max(s, bs), -bs))
    return {x: (o, -s) for x, (o, s) in best.items()}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_overlaps_match_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)

    def spans(n, reach, length):
        s, d = rng.integers(0, reach, n), rng.integers(-1, length, n)
        return [(int(k), int(x), int(x + y)) for k, x, y in zip(rng.integers(0, 3, n), s, d, strict=True)]

    a = [(k, i, s, e) for i, (k, s, e) in enumerate(spans(150, 60, 30))] + [(0, 900, 5, None), (None, 901, 0, 60)]
    b = [(k, s, e, s) for k, s, e in spans(120, 60, 12) + spans(20, 60, 60)] + [(1, None, 9, 0), (None, 0, 60, 0)]
    left, right = spark.createDataFrame(a, "k int, id int, s long, e long"), spark.createDataFrame(b, "k int, bs long, be long, v long")
    for width in (7.0, 1000.0):
        got = ranges.best_overlap(left, right, ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], width).collect()
        assert {(r.k, r.id): (r.overlap, r.v) for r in got} == plain_overlaps(a, b) and len(got) == len(plain_overlaps(a, b))
    assert ranges.best_overlap(left, right.limit(0), ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], 7.0).count() == 0
    assert ranges.best_overlap(left.limit(0), right, ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], 7.0).count() == 0


@pytest.mark.parametrize("few", [0, 15, 1000])
def test_few_and_many_intervals_of_a_key(spark, monkeypatch, few):
    """Keys are paired, cut into blocks, or both; equal intervals and repeated ids included."""
    rng = np.random.default_rng(5)

    def spans(keys, n, length):
        s, d = rng.integers(0, 60, n), rng.integers(-1, length, n)
        return [(int(k), int(x), int(x + y)) for k, x, y in zip(rng.choice(keys, n), s, d, strict=True)]

    a = [(k, i // 2, s, e) for i, (k, s, e) in enumerate(spans([0, 1, 2, 3, 4], 90, 30) + spans([5], 80, 30))] + [(None, 901, 0, 60)]
    b = [(k, s, e, s) for k, s, e in spans([0, 1, 2, 3], 24, 60) + spans([4, 6], 60, 12) + spans([5], 5, 20)]
    b += b[:10] + [(1, None, 9, 0), (None, 0, 60, 0)]
    left, right = spark.createDataFrame(a, "k int, id int, s long, e long"), spark.createDataFrame(b, "k int, bs long, be long, v long")
    blocks = []
    monkeypatch.setattr(ranges, "ordered", lambda *x, **y: blocks.append(1) or od.ordered(*x, **y))
    got = ranges.best_overlap(left, right, ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], 7.0, few=few).collect()
    assert {(r.k, r.id): (r.overlap, r.v) for r in got} == plain_overlaps(a, b) and len(got) == len(plain_overlaps(a, b))
    assert bool(blocks) == (few < 1000)


def test_few_intervals_are_not_numbered(spark, monkeypatch):
    """Numbering and cutting cost far more than the pairs of a key with few intervals."""
    monkeypatch.setattr(ranges, "ordered", None)
    left = spark.range(100).selectExpr("id div 10 as k", "id", "id as s", "id + 2 as e")
    right = spark.range(100).selectExpr("id div 10 as k", "id as v", "id + 0.5 as bs", "id + 1.5 as be")
    got = {r.id: (r.v, r.overlap) for r in ranges.best_overlap(left, right, ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], 7.0).collect()}
    assert got == {i: (i, 1) for i in range(100)}


def test_many_intervals_over_one_another(spark):
    """A pairing would make ten thousand million pairs here."""
    n = 100_000
    nested = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("bs"), (3.0 * n - F.col("id")).alias("be"), F.col("id").alias("v"))
    left = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") + 0.5).alias("s"), (3.0 * n - F.col("id") - 0.5).alias("e"))
    out = ranges.best_overlap(left, nested, ["k"], ("s", "e"), ("bs", "be"), ["id"], ["v"], 1000.0)
    # the first interval covers every left one, so it wins all ties
    assert out.filter("v = 0 and overlap = %d - 2 * id - 1" % (3 * n)).count() == n


def test_quantiles_are_exact_with_hot_values(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(400, 2.5), rng.lognormal(0, 4, 700), -rng.random(100)])
    k = rng.integers(0, 2, len(v))
    df = spark.createDataFrame(pd.DataFrame({"k": k, "v": v}))
    qs = [0.0, 0.01, 0.333, 0.5, 0.9, 1.0]
    for r in exact_quantiles(df, ["k"], "v", qs).collect():
        np.testing.assert_allclose(r.q, np.quantile(v[k == r.k], qs))
    assert column_medians(df, ["v"])["v"] == pytest.approx(np.median(v))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_looking_ahead_costs_no_square(spark):
    """A frame that ends with its partition is read anew for every row."""
    n = 40_000
    known = (np.arange(n) * 7919) % 13 == 0
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.when(F.col("id") * 7919 % 13 == 0, F.col("id")).alias("v"))
    out = od.ordered(df, ["k"], ["t"], 30_000.0, fill_backward={"b": F.col("v")})
    assert "unboundedfollowing" not in plan_of(out)
    want = pd.Series(np.where(known, np.arange(n), np.nan)).bfill()
    got = out.orderBy("t").toPandas().b.astype(float)
    assert got.equals(want.rename("b"))
