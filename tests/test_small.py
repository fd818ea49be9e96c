"""Small operators that no other test touches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.config import EngineConfig
from playframe.plans import analysis, features, formations, merge, similarity
from playframe.sources import files


def test_find_table(tmp_path):
    (tmp_path / "pca_output").mkdir()
    (tmp_path / "pca_output" / "pca_scores.parquet").write_text("")
    (tmp_path / "run\\phases.parquet").write_text("")
    assert files.find_table("pca_scores.parquet", str(tmp_path)).endswith("pca_output/pca_scores.parquet")
    assert files.find_table("run_phases.parquet", str(tmp_path), ("run_", "run\\")).endswith("phases.parquet")
    with pytest.raises(FileNotFoundError):
        files.find_table("other.parquet", str(tmp_path))


def test_grid_reading(spark, tmp_path):
    assert files.read_grid(str(tmp_path / "no.csv")) is None
    (tmp_path / "g.csv").write_text("1,2\n3,4.5\n")
    assert files.read_grid(str(tmp_path / "g.csv")) == [[1.0, 2.0], [3.0, 4.5]]
    assert files.grid_table(spark, str(tmp_path / "g.csv")).filter("row = 1 AND col = 1").first().value == 4.5


def test_list_cells_as_text_or_array(spark):
    df = spark.createDataFrame([("[1.5, 2]",)], "t string")
    assert df.select(files.numbers_of("t").alias("v")).first().v == [1.5, 2.0]


def test_half_maps_are_upcast(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"k": [1], "pc_map": pa.array([np.array([0.5, 1.0], dtype=np.float16)], pa.list_(pa.float16()))})
    pq.write_table(t, tmp_path / "half.parquet")
    files.upcast_half_maps(str(tmp_path / "half.parquet"), str(tmp_path / "single.parquet"))
    assert spark.read.parquet(str(tmp_path / "single.parquet")).first().pc_map == [0.5, 1.0]


@pytest.mark.parametrize("mode,want", [("all", [1, 2, 3, 4]), ("filter", [2, 3, 4])])
def test_reliability_filter_falls_back(spark, mode, want):
    df = spark.createDataFrame([("m", "a", 1, 0.2), ("m", "a", 2, 0.8), ("m", "b", 3, 0.1), ("m", "b", 4, None)], "match_id string, unit string, i int, r double")
    rows = df.withColumn("rel", F.struct(F.col("r").alias("ratio")))
    cfg = EngineConfig(reliability_mode=mode)
    assert sorted(r.i for r in features._kept(rows, cfg).filter("used").collect()) == want


def test_hierarchy(spark):
    df = spark.createDataFrame([("343flat",), ("pyramid",), ("wm",), ("diamond",), (None,)], "f string")
    got = [tuple(r) for r in df.select(formations.variant("f"), formations.family("f")).collect()]
    assert got == [("343", "back-3"), ("pyramid", "back-2"), ("wm", "back-3"), ("diamond", "other"), (None, "other")]


def test_product_and_ramp(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.0), (2, 3.0)], "k int, w double")
    assert {r.k: r.p for r in df.groupBy("k").agg(formations.product("w").alias("p")).collect()} == {1: pytest.approx(0.25), 2: 0.0}
    r = spark.range(1).select(formations.ramp(F.lit(7.5), F.lit(0.0), F.lit(15.0)).alias("w"), formations.ramp(F.lit(99.0), F.lit(0.0), F.lit(15.0)).alias("x")).first()
    assert (r.w, r.x) == (0.5, 1.0)


def test_window_indices_are_closed(spark):
    df = spark.createDataFrame([(0.0,), (59.9,), (180.0,), (240.0,)], "s double")
    got = [r[0] for r in df.select(formations.sliding_windows("s", 60, 180)).collect()]
    assert got == [[0], [0], [0, 1, 2, 3], [1, 2, 3, 4]]


def test_formation_segments_merge_runs(spark):
    rows = [("m", "home", 1, k, k * 60, k * 60 + 180, f, c) for k, f, c in [(0, "442", 1.0), (1, "442", 3.0), (2, "433", 5.0), (9, "433", 7.0), (10, "442", 9.0)]]
    w = spark.createDataFrame(rows, "match_id string, team string, period int, windowIndex int, windowStartSec int, windowEndSec int, formation string, confidence double")
    s = formations.formation_segments(w)
    got = [(r.formation, r.start_sec, r.end_sec, r.mean_confidence) for r in s.orderBy("start_sec").collect()]
    assert got == [("442", 0.0, 240.0, 2.0), ("433", 120.0, 720.0, 6.0), ("442", 600.0, 780.0, 9.0)]
    p = spark.createDataFrame([("m", "home", 1, "a", 10.0, 130.0), ("m", "home", 1, "b", 900.0, 950.0)], "match_id string, team string, period int, unit string, start_sec_period double, end_sec_period double")
    out = {r.unit: r.dominant_formation for r in formations.attach_formation(p, s, ["match_id", "unit"]).collect()}
    assert out == {"a": "442", "b": None}


def test_cluster_maps_and_agreement(spark):
    v = spark.createDataFrame([("m", "1", [0.0, 2.0]), ("m", "2", [4.0, 2.0]), ("m", "3", [1.0, 1.0])], "match_id string, window_id string, cells array<double>")
    lab = spark.createDataFrame([("m", "1", 0), ("m", "2", 0), ("m", "3", 1)], "match_id string, window_id string, cluster_k2 int")
    got = {(r.cluster_k2, r.cell): r.value for r in analysis.cluster_maps(v, lab, "cluster_k2").collect()}
    assert got == {(0, 0): 2.0, (0, 1): 2.0, (1, 0): 1.0, (1, 1): 1.0}
    assert analysis.compare_clusterings(lab, lab, [2]).first().ari == 1.0


def test_display_labels_keep_list_order(spark):
    df = spark.createDataFrame([("wm",), ("999",), ("1423",)], "label string")
    got = [r.label for r in similarity.display_labels(df).orderBy("position").collect()]
    assert got == ["1423", "wm"]


def test_merge_keeps_rows_and_rejects_repeats(spark):
    phases = spark.createDataFrame([("m", "1_1", 1, "home", 1)], "match_id string, window_id string, sequence_id int, team string, period int")
    move = spark.createDataFrame([("m", 1, "home", 2.0), ("m", 1, "home", 4.0)], "match_id string, sequence_id int, team string, mean_disp double")
    win = spark.createDataFrame([("m", "home", 1, 1.0, 2.0, 3.0, 4.0, 5.0)], "match_id string, team string, period int, avgCostPerPlayer double, confidence double, mean_compactness double, mean_width double, mean_depth double")
    scores = spark.createDataFrame([("m", "1_1", "home", 1, 0.5)], "match_id string, window_id string, team string, period int, PC1 double")
    r = merge.merge_phase_features(phases, move, win, scores).first()
    assert (r.touch_mean_disp, r.formwin_mean_depth, r.PC1) == (3.0, 5.0, 0.5)
    with pytest.raises(ValueError):
        merge.merge_phase_features(phases, move, win, scores.union(scores))


def test_repeated_players_count_once(spark):
    from playframe.plans.movement import displacement_stats

    player = "array<struct<pid:string,x:double,y:double>>"
    df = spark.createDataFrame([([("a", 5.0, 0.0), ("a", 0.0, 0.0), ("b", 1.0, 1.0)], [("a", 9.0, 9.0), ("a", 0.0, 0.0)])], f"b {player}, a {player}")
    s = df.select(displacement_stats(F.col("b"), F.col("a"), "pid").alias("s")).first().s
    assert s.n_valid == 1 and s.mean_disp == 0.0


def test_all_match_folders_are_found(spark, tmp_path):
    from playframe.config import EngineConfig
    from playframe.sources.files import MATCH_FILES, discover

    for i in range(65):
        (tmp_path / f"m{i}").mkdir()
        for name in MATCH_FILES:
            (tmp_path / f"m{i}" / name).write_text("{}")
    assert discover(spark, str(tmp_path), EngineConfig.possession_preset().num_matches).count() == 65


def test_ids_past_the_doubles_stay_apart(spark):
    from playframe.sources.events import WHOLE, _typed

    df = spark.createDataFrame([("9007199254740993",), ("9007199254740992",), ("12.0",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(_typed(F.col("t"), WHOLE)).collect()] == [9007199254740993, 9007199254740992, 12, None, None]
