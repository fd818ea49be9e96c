"""Batch kernels against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.functions.gridding import edge_bin, overlap_weights
from playframe.operators import grids, kernels
from playframe.plans import formations as fm

PLAYERS = "array<struct<rank:int,pid:string,x:double,y:double,reliable:boolean>>"


def players(points):
    return [(i, str(i), float(x), float(y), True) for i, (x, y) in enumerate(points)]


def frame_table(spark, frames):
    rows = [("m", i, players(h), players(a), bx, by, 105.0, 68.0) for i, (h, a, bx, by) in enumerate(frames)]
    return spark.createDataFrame(
        rows, f"match_id string, frame_idx long, home {PLAYERS}, away {PLAYERS}, ball_x double, ball_y double, pitch_length double, pitch_width double")


def random_frames(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, a = rng.random((rng.integers(0, 12), 2)) * [105, 68], rng.random((rng.integers(1, 12), 2)) * [105, 68]
        out.append((h, a, None if i % 5 == 0 else float(rng.random() * 105), None if i % 5 == 0 else float(rng.random() * 68)))
    return out


def test_ties_go_home_then_to_the_first_player():
    own = kernels.home_owned(np.array([[0.0]]), np.array([[0.0]]), np.array([[2.0]]), np.array([[0.0]]), np.array([0.0, 1.0, 2.0]), np.array([0.0]), True)
    assert own.tolist() == [[True, True, False]]
    _, who = kernels._nearest_player(np.array([[0.0, 2.0]]), np.zeros((1, 2)), np.array([1.0]), np.array([0.0]))
    assert who.ravel().tolist() == [0]


def test_control_share_matches_brute_force(spark):
    data = random_frames(12)
    got = {r.frame_idx: r.home_control for r in kernels.control_share(frame_table(spark, data), 7, 4).collect()}
    xs, ys = np.linspace(0, 105, 7), np.linspace(0, 68, 7)
    for i, (h, a, _, _) in enumerate(data):
        if len(h) + len(a) < 4:
            assert got[i] == 0.5
            continue
        pts = np.vstack([h.reshape(-1, 2), a])
        wins = [np.argmin(np.sqrt(((pts - [x, y]) ** 2).sum(1))) < len(h) for y in ys for x in xs]
        assert got[i] == pytest.approx(np.mean(wins))


def test_geometry_matches_brute_force(spark):
    data = random_frames(20, 1)
    for r in kernels.frame_geometry(frame_table(spark, data)).collect():
        h, a, bx, by = data[r.frame_idx]
        if len(h) == 0:
            assert r.home_centroid_x is None
            continue
        c = h.mean(0)
        assert r.home_centroid_x == pytest.approx(c[0])
        assert r.home_compactness == pytest.approx(np.linalg.norm(h - c, axis=1).mean())
        assert r.home_width == pytest.approx(np.ptp(h[:, 1]))
        d = np.linalg.norm(h[:, None] - h[None], axis=2)
        if len(h) > 1:
            assert r.home_pairwise_distance == pytest.approx(d[np.triu_indices(len(h), 1)].mean())
            assert r.home_nearest_teammate_distance == pytest.approx((d + np.eye(len(h)) * 1e9).min(1).mean())
        else:
            assert r.home_pairwise_distance is None
        assert r.home_nearest_opponent == pytest.approx(np.linalg.norm(h[:, None] - a[None], axis=2).min(1).mean())
        if bx is None:
            assert r.home_ahead_right is None
        else:
            assert r.home_ahead_right == (h[:, 0] > bx).sum() and r.home_behind_right == (h[:, 0] <= bx).sum()


def test_hull_area_on_known_shapes():
    nan = np.nan
    x = np.array([[0, 4, 4, 0, 2], [0, 1, 2, nan, nan], [0, 4, 0, 2, 0], [1, 1, nan, nan, nan], [5, 5, 5, 5, 9]], float)
    y = np.array([[0, 0, 3, 3, 1], [0, 1, 2, nan, nan], [0, 0, 3, 0, 0], [1, 2, nan, nan, nan], [0, 1, 2, 3, 0]], float)
    got = kernels.hull_area(x, y)
    assert got[0] == 12 and np.isnan(got[1]) and got[2] == 6 and np.isnan(got[3]) and got[4] == 6


@pytest.mark.parametrize("n,m", [(3, 3), (4, 6), (6, 6), (1, 5)])
def test_assignment_is_optimal(n, m):
    cost = np.random.default_rng(n * 10 + m).random((25, n, m)) * 50
    total, cols = kernels.assignment_cost(cost)
    for b in range(len(cost)):
        best = min(sum(cost[b, i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert total[b] == pytest.approx(best)
        assert len(set(cols[b])) == n


def test_templates_find_themselves(spark):
    lib = fm.default_templates()
    assert all(len(v) == 10 for v in lib.values())
    rows = [(name, [float(x * 105) for x, _ in s], [float(y * 68) for _, y in s], 105.0, 68.0) for name, s in lib.items()]
    df = spark.createDataFrame(rows, "name string, xs array<double>, ys array<double>, pl double, pw double")
    for r in fm.match_templates(df, "xs", "ys", F.lit(False), "pl", "pw", lib).collect():
        assert r.cost == pytest.approx(0.0, abs=1e-9)
    turned = df.select("name", F.transform("xs", lambda v: 105 - v).alias("xs"), F.transform("ys", lambda v: 68 - v).alias("ys"), "pl", "pw")
    assert all(r.cost == pytest.approx(0.0, abs=1e-9) for r in fm.match_templates(turned, "xs", "ys", F.lit(True), "pl", "pw", lib).collect())


def test_edge_bins_match_searchsorted(spark):
    edges = np.linspace(0, 68, 69)
    values = np.concatenate([edges, edges + 1e-9, edges - 1e-9, [-5, 200, 33.3]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("b", edge_bin("v", 68.0, 68))
    for r in df.collect():
        assert r.b == np.clip(np.searchsorted(edges, r.v, side="right") - 1, 0, 67)


def test_regrid_keeps_mass_and_uses_overlap(spark):
    rng = np.random.default_rng(2)
    g = rng.random((7, 10))
    df = spark.createDataFrame([(1, r, c, float(g[r, c])) for r in range(7) for c in range(10)], "k int, row int, col int, v double")
    out = np.zeros((3, 4))
    for r in grids.regrid(df, ["k"], "v", 7, 10, 3, 4).collect():
        out[r.row, r.col] = r.v
    wr, wc = np.zeros((3, 7)), np.zeros((4, 10))
    for w, t in ((wr, overlap_weights(7, 3)), (wc, overlap_weights(10, 4))):
        for o, i, v in t:
            w[o, i] = v
    np.testing.assert_allclose(wr.sum(0), 1)
    np.testing.assert_allclose(out, wr @ g @ wc.T)
    assert out.sum() == pytest.approx(g.sum())


def test_rotating_twice_is_identity(spark):
    df = spark.createDataFrame([(1, 2, 3, 0.5)], "k int, row int, col int, v double")
    r = grids.rotate(grids.rotate(df, F.lit(True), 7, 10), F.lit(True), 7, 10).first()
    assert (r.row, r.col) == (2, 3)


def test_roughness_of_flat_and_lonely_maps(spark):
    df = spark.createDataFrame([([1.0] * 12,), ([0.0] * 5 + [2.0] + [0.0] * 6,), ([0.0] * 12,)], "m array<double>")
    got = df.select(grids.total_variation(F.col("m"), 3, 4).alias("tv"), grids.isolated_share(F.col("m"), 3, 4).alias("iso")).collect()
    assert (got[0].tv, got[0].iso) == (0.0, 0.0)
    assert (got[1].tv, got[1].iso) == (4.0, 1.0)
    assert (got[2].tv, got[2].iso) == (None, None)


def test_smoothing_keeps_mass(spark):
    df = spark.createDataFrame([(1, [float(i == 5) for i in range(12)])], "k int, cells array<double>")
    s = grids.smooth(df, "cells", 3, 4, 1.0).first().cells
    assert sum(s) == pytest.approx(1.0) and max(s) == s[5]


def test_control_totals_match_brute_force_and_hold_no_cells(spark):
    """Keys with few frames, a hot key over several blocks, a null key, a key with two sizes of pitch."""
    data = random_frames(60, 4)
    df = frame_table(spark, data).withColumns({
        "k": F.when(F.col("frame_idx") < 40, 0).when(F.col("frame_idx") % 3 != 0, F.col("frame_idx") % 3),
        "pitch_length": F.when(F.col("frame_idx") % 7 == 0, 90.0).otherwise(105.0)})
    arrays = kernels.control_arrays(df, ["k"], "centres", 4, block=8.0)
    plan = arrays.filter("k > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
    got = {(r.k, r.cell): (r.home_frames, r.frames) for r in kernels.open_totals(arrays).collect()}
    assert arrays.filter("start = 0 and size(owned) > 1").count() == 3  # maps, not cells, for keys that are not hot
    want = {}
    for i, (h, a, _, _) in enumerate(data):
        if len(h) + len(a) < 4:
            continue
        k, pl = 0 if i < 40 else i % 3 or None, 90.0 if i % 7 == 0 else 105.0
        pts = [np.array(s).reshape(1, -1, 2) for s in (h, a)]
        own = kernels.home_owned(pts[0][..., 0], pts[0][..., 1], pts[1][..., 0], pts[1][..., 1], *kernels.centre_axes(pl, 68.0, round(pl), 68), False)[0]
        for c, o in enumerate(own):
            n = want.get((k, c), (0, 0))
            want[k, c] = (n[0] + int(o), n[1] + 1)
    assert got == want


@pytest.mark.parametrize("n", [7, 8, 10, 13])
def test_cheapest_template_is_found_with_few_assignments(n, monkeypatch):
    rng = np.random.default_rng(n)
    slots = np.array(list(fm.default_templates(105.0, 68.0).values()))
    cost = np.sqrt(((rng.random((40, 1, n, 1, 2)) * [105, 68] - slots[None, :, None]) ** 2).sum(-1))
    cost = cost.transpose(0, 1, 3, 2) if n > 10 else cost
    cost[:, 20] = cost[:, 4]  # a tie goes to the first
    plain = kernels.assignment_cost
    total = plain(cost.reshape(-1, *cost.shape[2:]))[0].reshape(40, -1)
    solved = []
    monkeypatch.setattr(kernels, "assignment_cost", lambda c: (solved.append(len(c)), plain(c))[1])
    best, least = kernels.cheapest_assignment(cost)
    assert best.tolist() == total.argmin(axis=1).tolist() and least.tolist() == total.min(axis=1).tolist()
    assert sum(solved) < total.size / 4


def test_dense_maps_are_made_in_pieces(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5000))], names=["i"])
    parts = list(grids._pieces(iter([batch]), 550))
    assert max(p.num_rows for p in parts) * 550 <= grids.CELLS and sum(p.num_rows for p in parts) == 5000
    d = grids.densify(spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 1, 3.0), (2, 1, 2, 1.5)], "k int, row int, col int, v double"), ["k"], "v", 2, 3)
    assert {r.k: list(r.cells) for r in d.collect()} == {1: [0, 5.0, 0, 0, 0, 0], 2: [0, 0, 0, 0, 0, 1.5]}


def test_cells_do_not_meet_by_label(spark):
    from playframe.plans.similarity import label_sums

    cells = spark.createDataFrame([(i, 0, i % 2, "in", 1.0) for i in range(6)], "map_id int, row int, col int, block string, amount double")
    labels = spark.createDataFrame([(i, "x" if i < 4 else "y") for i in range(6)], "map_id int, label string")
    s = label_sums(cells, labels, ["map_id"], "amount", 3)
    assert sorted((r.label, r.col, r.n_phases, r.in_possession_sum) for r in s.collect()) == [("x", 0, 4, 2.0), ("x", 1, 4, 2.0)]
    depth = {}
    for line in s._jdf.queryExecution().optimizedPlan().toString().splitlines():
        for key in ("map_id", "label"):
            if f"Join Inner, ({key}" in line:
                depth[key] = line.index("Join")
    assert depth["label"] > depth["map_id"]


def test_smoothing_shares_the_pass_of_dense_maps(spark):
    cells = spark.createDataFrame([(1, 0, 1, 2.0), (1, 3, 4, 3.0), (2, 1, 2, 1.5)], "k int, row int, col int, v double")
    one = grids.densify(cells, ["k"], "v", 4, 5, then=grids.smoother(4, 5, 1.0))
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = grids.smooth(grids.densify(cells, ["k"], "v", 4, 5), "cells", 4, 5, 1.0)
    assert {r.k: list(r.cells) for r in one.collect()} == {r.k: list(r.cells) for r in two.collect()}
