"""The wide feature row of a possession or phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playframe.config import EngineConfig
from playframe.functions import frames as fx
from playframe.functions.direction import relative_x
from playframe.functions.nulls import ratio
from playframe.functions.stats import SUFFIXES, series_stats
from playframe.operators import kernels
from playframe.operators.ordered import steps
from playframe.operators.ranges import points_in_intervals

KEY = ["match_id", "unit"]
RELATIONS = ("centroid_to_ball_distance", "players_ahead_of_ball", "players_behind_ball")


def frame_reliability() -> Column:
    """Reliable and present player slots of a frame, and their ratio."""
    both = F.concat(F.col("home"), F.col("away"))
    present = F.size(both)
    ok = F.size(F.filter(both, lambda p: p["reliable"]))
    return F.struct(ok.alias("ok"), present.alias("present"), F.when(present > 0, ok / present).alias("ratio"))


def frame_features(frames: DataFrame) -> DataFrame:
    """Everything the wide row needs from a frame, without the player arrays:
    shapes with hull area, ball relations for both directions, closest
    opponents, ball and reliability. Narrow; nothing is shuffled."""
    f = kernels.frame_geometry(frames.select("match_id", "frame_idx", "frame_num", "ball_x", "ball_y", "ball_z", "home", "away"))

    def side(s: str) -> Column:
        return F.struct(*[F.col(f"{s}_{n}").alias(n) for n in kernels.SHAPE_FIELDS + kernels.BALL_FIELDS + ("nearest_opponent",)])

    return f.select("match_id", "frame_idx", "frame_num", "ball_x", "ball_y", "ball_z", frame_reliability().alias("rel"),
                    side("home").alias("home_side"), side("away").alias("away_side"))


def unit_frames(frames: DataFrame, units: DataFrame, carry: list[str], width: float) -> DataFrame:
    """Frames of every unit by frame number."""
    spans = units.select(*KEY, "start_frame", "end_frame", *carry)
    return points_in_intervals(frames, spans, ["match_id"], "frame_num", "start_frame", "end_frame", width).drop("start_frame", "end_frame")


def _series() -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The 39 per-frame series in the view of the side in possession, the two
    side structs and the interaction struct that they read."""
    home, right = F.col("team") == "home", F.col("direction") > 0
    att = F.when(home, F.col("home_side")).otherwise(F.col("away_side"))
    dfn = F.when(home, F.col("away_side")).otherwise(F.col("home_side"))
    out: dict[str, Column] = {}
    for prefix in ("attacking", "defending"):
        own = F.col(f"__{prefix}")
        for name in kernels.SHAPE_FIELDS:
            out[f"{prefix}_{name}"] = relative_x(own[name], "direction", F.col("pitch_length")) if name == "centroid_x" else own[name]
        out[f"{prefix}_{RELATIONS[0]}"] = own[RELATIONS[0]]
        for name, word in zip(RELATIONS[1:], ("ahead", "behind")):
            out[f"{prefix}_{name}"] = F.when(right, own[f"{word}_right"]).otherwise(own[f"{word}_left"])
    inter = fx.interactions(F.col("__attacking"), F.col("__defending"), F.col("__attacking.nearest_opponent"))
    for name in fx.INTERACTION_FIELDS:
        out[name] = F.col("__inter")[name]
    long = out["longitudinal_centroid_difference"]
    out["longitudinal_centroid_difference"] = F.when(right, long).otherwise(-long)
    out["ball_x"] = relative_x("ball_x", "direction", F.col("pitch_length"))
    out["ball_y"], out["ball_z"] = F.col("ball_y"), F.col("ball_z")
    return out, {"__attacking": att, "__defending": dfn}, inter


def _kept(rows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Reliability mode: all frames, or those above the threshold unless none
    is. ``used`` marks the frames that count."""
    if cfg.reliability_mode != "filter":
        return rows.withColumn("used", F.lit(True))
    good = F.coalesce(F.col("rel.ratio") >= cfg.reliability_threshold, F.lit(False))
    some = rows.groupBy(*KEY).agg(F.max(good).alias("__some"))
    return rows.join(some, KEY).withColumn("used", good | ~F.col("__some")).drop("__some")


def shape_rows(features: DataFrame, units: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Frame statistics of every unit: one join and one aggregate."""
    rows = _kept(unit_frames(features, units, ["team", "direction", "pitch_length"], float(cfg.block_frames)), cfg)
    series, sides, inter = _series()
    picked = rows.withColumns(sides).withColumn("__inter", inter).select(*KEY, "frame_idx", "used", "rel", *[F.when(F.col("used"), v).alias(n) for n, v in series.items()])
    weight = F.coalesce("rel.ratio", F.lit(0.0)) if cfg.reliability_mode == "weighted" else None
    aggs = [F.count(F.lit(1)).alias("n_unique_frames"), ratio(F.sum("rel.ok"), F.sum("rel.present")).alias("reliability_ratio")]
    for name in series:
        aggs += series_stats(name, name, "frame_idx", weight)
    for prefix in ("attacking", "defending"):
        pos = F.when(F.col(f"{prefix}_centroid_x").isNotNull(), F.struct(F.col(f"{prefix}_centroid_x").alias("x"), F.col(f"{prefix}_centroid_y").alias("y")))
        at = F.when(pos.isNotNull(), F.col("frame_idx"))
        aggs += [F.min_by(pos, at).alias(f"__{prefix}_a"), F.max_by(pos, at).alias(f"__{prefix}_b"), F.count(pos).alias(f"__{prefix}_n")]
    g = picked.groupBy(*KEY).agg(*aggs).join(units.select(*KEY, "duration"), KEY)
    dur = F.when(F.col("duration") > 0, F.col("duration"))
    extra = {}
    for prefix in ("attacking", "defending"):
        a, b = F.col(f"__{prefix}_a"), F.col(f"__{prefix}_b")
        moved = F.when(F.col(f"__{prefix}_n") >= 2, F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        extra[f"{prefix}_centroid_displacement"] = moved
        extra[f"{prefix}_centroid_velocity"] = moved / dur
        for f in ("width", "depth", "compactness", "area"):
            extra[f"{prefix}_{f}_change_rate"] = F.col(f"{prefix}_{f}_change") / dur
    drop = [f"__{p}_{k}" for p in ("attacking", "defending") for k in "abn"]
    return g.withColumns(extra).drop("duration", *drop)


def speed_rows(frames: DataFrame, units: DataFrame, matches: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Player speeds of the side in possession between consecutive tracked
    positions inside the unit."""
    slim = frames.select("match_id", "frame_idx", "frame_num", "home", "away")
    if cfg.reliability_mode == "filter":
        slim = slim.withColumn("rel", frame_reliability())
    rows = _kept(unit_frames(slim, units, ["team"], float(cfg.block_frames)), cfg).filter("used")
    own = F.when(F.col("team") == "home", F.col("home")).otherwise(F.col("away"))
    players = rows.select(*KEY, "frame_idx", F.explode(own).alias("p")).select(*KEY, "frame_idx", "p.pid", "p.x", "p.y")
    moved = steps(players, KEY + ["pid"], ["frame_idx"], "x", "y", float(cfg.block_frames)).join(matches.select("match_id", "fps"), "match_id")
    v = F.col("step") * F.col("fps")
    return moved.groupBy(*KEY).agg(F.avg(v).alias("mean_player_speed"), F.stddev_pop(v).alias("std_player_speed"), F.max(v).alias("max_player_speed"))


def timed_rows(series: DataFrame, units: DataFrame, names: list[str], cfg: EngineConfig, same_team: bool = True) -> DataFrame:
    """Statistics of a sampled series over the seconds of every unit."""
    keys = ["match_id", "period"] + (["team"] if same_team else [])
    spans = units.select(*keys, "unit", "start_sec_period", "end_sec_period", *([] if same_team else ["team"]))
    held = points_in_intervals(series.select(*keys, "frame_idx", "elapsed", *names), spans, keys, "elapsed", "start_sec_period", "end_sec_period", cfg.block_seconds)
    if not same_team:
        held = held.withColumns({n: F.when(F.col("team") == "away", 1.0 - F.col(n)).otherwise(F.col(n)) for n in names})
    return held.groupBy(*KEY).agg(*[c for n in names for c in series_stats(n, n, "frame_idx")])


def control_maps(frames: DataFrame, units: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Mean control map of every unit as one flat array, x-major, in the view
    of the side in possession; units without a usable frame have none."""
    sampled = frames.filter(F.col("frame_idx") % cfg.control_stride == 0)
    spans = units.select("match_id", "period", "unit", "start_sec_period", "end_sec_period", "pitch_length", "pitch_width")
    held = points_in_intervals(sampled.select("match_id", "period", "elapsed", "home", "away"), spans, ["match_id", "period"], "elapsed",
                               "start_sec_period", "end_sec_period", cfg.block_seconds)
    nx, ny = cfg.control_nodes_x, cfg.control_nodes_y
    totals = kernels.control_totals(held, KEY, "nodes", cfg.control_min_players, nx, ny, order="elapsed", block=cfg.block_seconds)
    j = totals.join(units.select(*KEY, "team", "direction"), KEY)
    share = F.col("home_frames") / F.col("frames")
    own = F.when(F.col("team") == "home", share).otherwise(1.0 - share)
    ix, iy = F.floor(F.col("cell") / ny), F.col("cell") % ny
    place = F.when(F.col("direction") < 0, (nx - 1 - ix) * ny + iy).otherwise(F.col("cell"))
    packed = j.select(*KEY, F.struct(place.alias("i"), own.cast("float").alias("v")).alias("c")).groupBy(*KEY).agg(F.array_sort(F.collect_list("c")).alias("m"))
    return packed.select(*KEY, F.transform("m", lambda c: c["v"]).alias("pc_map"))


def series_columns(names: list[str]) -> list[str]:
    return [f"{n}_{s}" for n in names for s in SUFFIXES]
