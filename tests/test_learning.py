"""Analysis operators against numpy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.functions import taxonomy
from playframe.ml import clusters, linear, prepare, regress
from playframe.plans import analysis, maps, similarity
from playframe.sinks import writers


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.4, (60, 6)) for c in (0, 3, 6)])
    rows = [(i, f"m{i % 6}", i // 60, [float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, match_id string, label int, features array<double>").persist()


def test_components_match_svd(blobs):
    x, df = blobs
    c = linear.fit_components(df, "features")
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    np.testing.assert_allclose(c.variance, s ** 2 / (len(x) - 1), rtol=1e-8)
    np.testing.assert_allclose(np.abs(c.loadings @ vt.T), np.eye(6), atol=1e-6)
    assert all(l[np.abs(l).argmax()] > 0 for l in c.loadings)
    got = np.array([r.s for r in c.keep(2).scores(df, "features", "s").orderBy("id").collect()])
    np.testing.assert_allclose(got, xc @ c.loadings[:2].T, atol=1e-8)
    assert c.count_for(0.5) == int(np.searchsorted(np.cumsum(c.ratio), 0.5) + 1)


def test_small_blocks_give_the_same_components(blobs):
    x, df = blobs
    whole = linear.fit_components(df, "features", 3)
    for block in (1, 2, 4):
        small = linear.fit_components(df, "features", 3, block=block)
        np.testing.assert_allclose(small.variance, whole.variance, rtol=1e-9)
        np.testing.assert_allclose(small.loadings, whole.loadings, atol=1e-6)
        np.testing.assert_allclose(small.ratio, whole.ratio, rtol=1e-9)
    assert len(linear.fit_components(df, "features", share=0.9, block=1).ratio) == whole.count_for(0.9)
    np.testing.assert_allclose(whole.spread, x.var(axis=0, ddof=1))


def test_components_survive_saving(spark, blobs, tmp_path):
    _, df = blobs
    c = linear.fit_components(df, "features", 2)
    c.save(spark, str(tmp_path / "model"))
    back = linear.Components.read(spark, str(tmp_path / "model"))
    np.testing.assert_allclose(back.loadings, c.loadings)
    np.testing.assert_allclose(back.mean, c.mean)


def test_silhouette_matches_definition(blobs):
    x, df = blobs
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    lab = np.arange(len(x)) // 60
    s = []
    for i in range(len(x)):
        own = d[i][(lab == lab[i]) & (np.arange(len(x)) != i)].mean()
        other = min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        s.append((other - own) / max(own, other))
    assert clusters.sampled_silhouette(df, "label", 5000, "features", ["id"]) == pytest.approx(np.mean(s))


def test_ari_limits(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3) * 7, i // 15) for i in range(45)], "id int, a int, b int, c int")
    assert clusters.contingency_ari(df, "a", "b").first().ari == pytest.approx(1.0)
    assert abs(clusters.contingency_ari(df, "a", "c").first().ari) < 0.1


def test_kmeans_sweep_finds_blobs(blobs):
    _, df = blobs
    rows, table = clusters.sweep(df, [3], "features", ["id"], n_init=2, repeats=1)
    r = table.first()
    assert r.stability_ari_mean > 0.95 and r.silhouette > 0.7
    assert clusters.contingency_ari(rows, "label", "cluster_k3").first().ari == pytest.approx(1.0)


def test_group_weights_reach_the_target_variance(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(float(v) for v in r) for r in rng.normal(size=(200, 5)) * [1, 5, 2, 9, 3]]
    cols = ["width_a", "width_b", "width_c", "depth_a", "goals"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    s = prepare.fit_scaling(df, cols)
    w = s.group_weights(0.5, {"match_events"})
    v = prepare.scaled_vector(df, s, cols, w)
    x = np.array([r.features for r in v.collect()])
    assert x.shape[1] == 4
    assert x[:, :3].var(0).sum() == pytest.approx(3 ** 0.5) and x[:, 3].var() == pytest.approx(1.0)
    assert sum(s.shares(w).values()) == pytest.approx(1.0)


def test_principal_scores_share_one_divisor(spark):
    df = spark.createDataFrame([(float(i), float(i % 7) / 10) for i in range(50)], "PC1 double, PC2 double")
    s = prepare.fit_scaling(df, ["PC1", "PC2"])
    assert s.divisor[0] == s.divisor[1] and s.groups == ["positional_pca"] * 2


def test_missing_maps_get_cell_medians(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [4.0, 8.0]), (4, None)], "id int, m array<double>")
    assert prepare.impute_maps(df, "m").filter("id = 4").first().m == [0.0, 3.0]


def test_usable_columns(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (3.0, 1.0, 5.0)], "a double, b double, c double")
    assert prepare.usable_columns(df, ["a", "b", "c"]) == ["a"]


@pytest.mark.parametrize("name,plain,ball", [
    ("pitch_control_mean", "pitch_control_scalar", "pitch_control"), ("pcmap_r01_c02", "pitch_control_map", "other"),
    ("PC12", "positional_pca", "positional_pca"), ("attacking_centroid_x_mean", "centroid_position", "centroid_position"),
    ("centroid_distance_mean", "team_vs_team_distance", "team_vs_team_distance"), ("defending_area_std", "area", "area"),
    ("n_passs", "passing", "passing"), ("touch_mean_disp", "touch_movement", "touch_movement"), ("formwin_confidence", "formation", "formation"),
    ("nearest_opponent_distance_mean", "player_spacing", "player_spacing"), ("duration", "phase_duration", "phase_duration"),
    ("n_pressured_actions", "pressure", "pressure"), ("period", "other", "other"), ("formwin_mean_width", "width", "width"),
])
def test_feature_groups(name, plain, ball):
    assert taxonomy.group_of(name) == plain and taxonomy.group_of(name, with_ball=True) == ball


def test_feature_sets_leave_out_leaks():
    names = ("attacking_width_mean", "attacking_players_ahead_of_ball_mean", "ball_x_mean", "width_ratio_mean", "mean_player_speed", "period")
    sets = taxonomy.FeatureSets(names, names + ("formation_confidence",), ("fmt_a_b",)).build()
    assert sets["Cat 1"] == ["attacking_width_mean", "mean_player_speed", "period", "fmt_a_b", "formation_confidence"]
    assert "width_ratio_mean" in sets["Cat 2"] and sets["Cat 3"] == ["fmt_a_b", "formation_confidence"]


def synthetic_maps(spark, n_phases=60, n_rows=5, n_cols=8):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n_phases):
        team, period = ("home", "away")[i % 2], 1 + i % 3 // 2
        for side in ("home", "away"):
            g = rng.random((n_rows, n_cols)) ** 4
            g[:, : n_cols // 2] *= 3 if (i // 2) % 2 else 0.3
            g /= g.sum()
            rows += [(f"m{i % 3}", f"1_{i}", 1, team, side, period, r, c, 9, float(g[r, c])) for r in range(n_rows) for c in range(n_cols)]
    return spark.createDataFrame(rows, "match_id string, window_id string, sequence_id int, team string, side string, period int, row int, col int, frame_count int, recurrence_frac double")


def test_map_components_and_restored_maps(spark):
    rec = synthetic_maps(spark)
    got = analysis.map_components(rec, 3, min_frames=5)
    assert got.shape == (5, 8) and got.loadings.count() == 80
    s = got.scores.toPandas()
    assert len(s) == 60 and set(s.attack_dir_original) <= {1, -1}
    assert abs(s[["PC1", "PC2", "PC3"]].mean()).max() < 1e-9
    v = got.variance.toPandas()
    assert v.cumulative.iloc[-1] == pytest.approx(1.0) and (v.variance.diff().dropna() <= 1e-12).all()
    back = analysis.restored_cluster_maps(got.scores.withColumn("c", F.lit(0)), "c", got.model).first()
    assert len(back.cells) == 80 and min(back.cells) >= 0
    assert analysis.map_components(rec, 2, features="combined", transform="none", orient="none").loadings.count() == 40


def test_direction_falls_back_to_the_period(spark):
    df = spark.createDataFrame([("a", 1, "home", 50.0), ("a", 2, "home", 50.0), ("b", 1, "home", 40.0), ("b", 1, "away", 60.0)],
                               "match_id string, period int, team string, mid_x double")
    got = {(r.match_id, r.period): (r.home_dir, r.detected) for r in maps.home_attack_direction(df).collect()}
    assert got == {("a", 1): (1, False), ("a", 2): (-1, False), ("b", 1): (-1, True)}


def test_formation_maps(spark):
    rec = synthetic_maps(spark)
    phases = rec.select("match_id", "window_id").distinct().withColumn(
        "dominant_formation", F.when(F.pmod(F.split("window_id", "_")[1].cast("int"), F.lit(3)) == 0, "442").otherwise("433"))
    out = analysis.formation_maps(phases, rec, ["442", "433", "541"], n_rows=4, n_cols=6, min_phases=5, pairs=[("433", "442")])
    sums = out.sums.toPandas()
    assert set(sums.label) == {"442", "433"}
    assert sums.groupby("label").in_possession_sum.sum().to_dict() == pytest.approx({"442": 20.0, "433": 40.0})
    c = {(r.label_a, r.label_b): r.corr for r in out.combined.collect()}
    assert c[("442", "442")] == pytest.approx(1.0) and c[("442", "433")] == pytest.approx(c[("433", "442")])
    sub = out.subsampling.first()
    assert (sub.n_high, sub.n_low) == (40, 20) and sub.score_high_subsampled_mean > 0


def test_subsampling_draws_exactly_the_low_size(spark):
    df = spark.createDataFrame([(i, "h") for i in range(100)], "id int, g string").withColumn("__t", F.xxhash64("id")).withColumn("n", F.lit(17))
    assert similarity._smallest(df, ["g"], F.col("n")).count() == 17


def test_prediction_reports_scores(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(160):
        w = float(rng.random())
        rows.append((f"m{i % 8}", f"1_{i}", w, float(rng.random()), ("433", "442")[i % 2], 0.5, w * 2, [w, 1 - w, 0.5, float("nan")]))
    df = spark.createDataFrame(rows, "match_id string, window_id string, attacking_width_mean double, duration double, dominant_formation string, "
                               "formation_confidence double, xt_mean double, pc_map array<double>")
    out = analysis.prediction(df, regress.Boosting(rounds=6, depth=2, min_leaf=5, step=0.5), n_components=1, map_size=4, targets=("xt_mean",))
    s = {r.cat: r for r in out["scalars"].collect()}
    assert s["Cat 1"].r2 > 0.8 and s["Cat 1"].error is None and s["Cat 3"].r2 < 0.5
    m = {r.cat: r for r in out["maps"].collect()}
    assert m["Cat 1"].overall_r2 > m["baseline"].overall_r2
    assert regress.score_table(out["scalars"]).count() == 1


def test_cluster_job_end_to_end(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(90):
        g = i % 3
        rows.append((f"m{i % 6}", f"1_{i}", 1 + i, "home", 1, float(g * 4 + rng.normal() * 0.1), float(g + rng.normal() * 0.1), float(rng.random()), 3 + g))
    phases = spark.createDataFrame(rows, "match_id string, window_id string, sequence_id int, team string, period int, attacking_width_mean double, attacking_depth_mean double, duration double, goals int")
    move = spark.createDataFrame([("m0", 1, "home", 2.0)], "match_id string, sequence_id int, team string, mean_disp double")
    win = spark.createDataFrame([("m0", "home", 1, 1.0, 1.0, 1.0, 1.0, 1.0)], "match_id string, team string, period int, avgCostPerPlayer double, confidence double, mean_compactness double, mean_width double, mean_depth double")
    maps_ = phases.select("match_id", "window_id", F.array(F.col("attacking_width_mean"), F.rand(3) / 10).alias("rec"))
    cfg = analysis.ClusterSettings(ks=(3,), final_ks=(3,), n_init=3, repeats=1, ball_share=0.2, holdout=taxonomy.HOLDOUT_GROUPS + ("phase_duration",))
    ball = phases.select("match_id", "window_id", F.col("attacking_depth_mean").alias("ball_start_x"))
    out = analysis.cluster_phases(phases, move, win, None, cfg, recurrence_maps=maps_, ball=ball)
    assert out.retained["recurrence_map"] == 1.0 and 0 < out.retained["width"] <= 1
    truth = out.rows.withColumn("g", F.pmod(F.split("window_id", "_")[1].cast("int"), F.lit(3)))
    assert clusters.contingency_ari(truth, "g", "cluster_k3").first().ari > 0.9
    imp = {r.feature: r for r in out.importance(3).collect()}
    assert imp["attacking_width_mean"].eta_squared > 0.9 and imp["goals"].group == "match_events"
    assert out.profile(3).count() == 3 and out.group_importance(3).first().eta_squared > 0.5


def test_timeline_orders_by_counter(spark):
    df = spark.createDataFrame([("m", f"7_{i}", "home", 1 if i < 11 else 2) for i in (1, 10, 2, 12, 11)], "match_id string, window_id string, team string, period int")
    t = analysis.phase_timeline(df, "m", step=2, max_phases=2)
    assert [r.window_id for r in t.orderBy("position").collect()] == ["7_1", "7_10"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1, [0.5, 0.25]), ("m2", 2, [0.5])], "match_id string, v int, pc_map array<float>")
    writers.write_with_maps(df, str(tmp_path / "t"), size=2)
    back = {r.v: r.pc_map for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert back[1] == [0.5, 0.25] and all(np.isnan(back[2]))
    writers.write_summary(df.select("match_id", "v"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    assert writers.output_name("a.parquet", 8) == "a_8.parquet" and writers.output_name("a.parquet", 64) == "a.parquet"
    calls = []
    build = lambda: calls.append(1) or df.select("match_id", "v")
    for _ in range(2):
        assert writers.reuse_or_build(spark, str(tmp_path / "r"), build).count() == 2
    assert len(calls) == 1
    g = {r.group: r.features for r in writers.feature_group_table(spark, ["goals", "n_shots", "PC1"]).collect()}
    assert g == {"match_events": ["goals", "n_shots"], "positional_pca": ["PC1"]}
    writers.write_document(str(tmp_path / "d.json"), {"seed": 1}, {"rows": df.select("v")})
    assert '"seed": 1' in (tmp_path / "d.json").read_text()


def test_silhouette_of_all_rows(blobs):
    x, df = blobs
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    lab = np.arange(len(x)) // 60
    s = []
    for i in range(len(x)):
        own = d[i][(lab == lab[i]) & (np.arange(len(x)) != i)].mean()
        other = min(d[i][lab == k].mean() for k in set(lab) - {lab[i]})
        s.append((other - own) / max(own, other))
    assert clusters.silhouette(df, "label", "features") == pytest.approx(np.mean(s))


def test_wide_vectors_keep_all_components(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 2100))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    c = linear.fit_components(df, "v")
    assert len(c.loadings) == 149 and c.ratio.sum() == pytest.approx(1.0)
    assert np.cumsum(c.ratio)[c.count_for(0.9) - 1] >= 0.9
    with pytest.raises(ValueError):
        c.keep(100).count_for(0.9)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)[:149]
    np.testing.assert_allclose(c.variance, s ** 2 / 149, rtol=1e-8)


def test_components_of_maps_of_full_width(spark):
    """14,280 places: the residuals of the components of a share, against the rows themselves."""
    rng = np.random.default_rng(8)
    n, d, rank = 400, 14280, 40
    x = (rng.normal(size=(n, rank)) * 0.8 ** np.arange(rank)) @ rng.normal(size=(rank, d)) + 0.01 * rng.normal(size=(n, d)) + 3.0
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(8)
    c = linear.fit_components(df, "v", share=0.95)
    centred = x - x.mean(0)
    total = (centred ** 2).sum() / (n - 1)
    assert c.ratio.sum() >= 0.95 > c.ratio[:-1].sum() and c.variance.sum() / total == pytest.approx(c.ratio.sum())
    residual = centred.T @ (centred @ c.loadings.T) / (n - 1) - c.loadings.T * c.variance
    assert np.linalg.norm(residual, axis=0).max() <= 1e-7 * c.variance[0]
    np.testing.assert_allclose(c.loadings @ c.loadings.T, np.eye(len(c.loadings)), atol=1e-9)


def test_components_of_alike_and_of_few_rows(spark):
    same = spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>")
    assert len(linear.fit_components(same, "v").loadings) == 0
    two = spark.createDataFrame([([0.0, 0.0, 0.0],), ([1.0, 2.0, 2.0],)], "v array<double>")
    c = linear.fit_components(two, "v")
    np.testing.assert_allclose(c.loadings, [[1 / 3, 2 / 3, 2 / 3]])
    assert c.variance[0] == pytest.approx(4.5)


def test_residual_on_anchors(blobs):
    x, df = blobs
    for anchors in ([0], [1, 4], [2, 2]):
        got = np.array([r.f for r in prepare.residual_on(df.withColumn("f", F.col("features")), "f", anchors, "f").orderBy("id").collect()])
        a = np.column_stack([np.ones(len(x)), x[:, anchors]])
        np.testing.assert_allclose(got, x - a @ np.linalg.lstsq(a, x, rcond=None)[0], atol=1e-9)


def test_weighted_deviation_far_from_zero(spark):
    from playframe.functions import stats

    df = spark.range(100).select((F.lit(1.7e9) + F.col("id") * 0.01).alias("v"), F.lit(1.0).alias("w"), (F.col("id") % 7).cast("double").alias("u"))
    one = df.agg(*[c.alias(n) for n, c in zip("ms", stats.weighted_mean_std("v", "w"))]).first()
    v = 1.7e9 + np.arange(100) * 0.01
    assert one.s == pytest.approx(v.std(), rel=1e-4) and one.m == pytest.approx(v.mean(), abs=1e-5)
    w = (np.arange(100) % 7).astype(float)
    two = df.agg(*[c.alias(n) for n, c in zip("ms", stats.weighted_mean_std("v", "u"))]).first()
    mean = (v - 1.7e9) @ w / w.sum()
    assert two.s == pytest.approx(np.sqrt(w @ (v - 1.7e9 - mean) ** 2 / w.sum()), rel=1e-4)


def test_group_split_by_hash(spark):
    df = spark.range(400).withColumn("g", F.col("id") % 40)
    from playframe.ml import regress

    train, test = regress.group_split(df, "g", 0.2)
    a, b = {r.g for r in train.collect()}, {r.g for r in test.collect()}
    assert a | b == set(range(40)) and not a & b and 1 <= len(b) < 20
    one, none = regress.group_split(df.filter("g = 3"), "g", 0.2)
    assert one.count() + none.count() == 10


def lloyd(x, centres, tol, rounds=300):
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        fresh = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        done = np.sqrt(((fresh - centres) ** 2).sum(axis=1)).max() <= tol
        centres = fresh
        if done:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_shared_passes_of_kmeans(blobs, monkeypatch):
    """Every setting ends where a plain run from its start ends, and all settings
    together take as many passes as the slowest alone."""
    from playframe.ml import kmeans

    x, df = blobs
    parts = df.withColumn("p", F.array(F.col("id") % 2 == 0, F.col("id") < 100))
    settings = [kmeans.Setting(k, s) for k in (2, 3, 5) for s in range(3)] + [kmeans.Setting(3, 0, r, side) for r in (0, 1) for side in (True, False)]
    starts, passes, seeded, sums = [], [], kmeans._seeded, kmeans.Rows.sums
    monkeypatch.setattr(kmeans, "_seeded", lambda *a: starts.append(seeded(*a)) or starts[-1])
    monkeypatch.setattr(kmeans.Rows, "sums", lambda *a: passes.append(1) or sums(*a))
    fits = kmeans.fit_many(parts, "features", settings, "p", tol=1e-6)
    together, ids = len(passes), np.arange(len(x))
    for fit, start in zip(fits, list(starts)):
        s = fit.setting
        use = np.ones(len(x), dtype=bool) if s.part < 0 else ((ids % 2 == 0) if s.part == 0 else (ids < 100)) == s.side
        centres, cost = lloyd(x[use] - x.mean(0), start, 1e-6)
        np.testing.assert_allclose(fit.centres, centres + x.mean(0), atol=1e-9)
        assert fit.cost == pytest.approx(cost)
    alone = []
    for s in settings:
        passes.clear()
        kmeans.fit_many(parts, "features", [s], "p", tol=1e-6)
        alone.append(len(passes))
    assert together <= max(alone) + 3
    labels = kmeans.assigned(df, "features", {"a": fits[0], "b": fits[3]}).orderBy("id").collect()
    for name, fit in (("a", fits[0]), ("b", fits[3])):
        assert [r[name] for r in labels] == ((x[:, None] - fit.centres[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    both = kmeans.assigned(df, "features", {"a": fits[0], "b": fits[3]})
    assert kmeans.agreements(df, "features", [(fits[0], fits[3])])[0] == pytest.approx(clusters.contingency_ari(both, "a", "b").first().ari)
    assert kmeans.silhouettes(df, "features", [fits[0], fits[3]]) == pytest.approx([clusters.silhouette(both, c, "features") for c in "ab"])


def test_fewer_rows_than_clusters(spark):
    from playframe.ml import kmeans

    df = spark.createDataFrame([([0.0, 1.0],), ([0.0, 1.0],), ([5.0, 1.0],)], "features array<double>")
    fit = kmeans.best(kmeans.fit_many(df, "features", [kmeans.Setting(4, 0), kmeans.Setting(4, 1)]))
    assert fit.cost == pytest.approx(0.0) and len(fit.centres) == 4


def test_importance_of_values_far_from_zero(spark):
    rows = [(i % 3, [1e9 + (i % 3) * 0.01 + (i % 7) * 0.001, float(i % 3)]) for i in range(210)]
    df = spark.createDataFrame(rows, "c int, f array<double>")
    x, c = np.array([r[1] for r in rows]) - [1e9, 0.0], np.array([r[0] for r in rows])
    between = sum((c == k).sum() * (x[c == k].mean(0) - x.mean(0)) ** 2 for k in range(3))
    want = between / ((x - x.mean(0)) ** 2).sum(axis=0)
    got = [r.eta_squared for r in clusters.eta_squared(df, "c", "f").orderBy("i").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-4)
