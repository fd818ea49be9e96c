"""The two end-to-end jobs. Each is one plan over all matches: there is no
match loop, and a match is never held in one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from playframe.config import EngineConfig
from playframe.functions.direction import attack_direction
from playframe.operators import kernels
from playframe.operators.ranges import stamp_last
from playframe.plans import features, formations, maps, movement, possessions, resolve, series
from playframe.session import materialize
from playframe.sources.events import read_events
from playframe.sources.files import discover, read_grid
from playframe.sources.tracking import read_frames, read_matches

KEY = features.KEY


@dataclass
class Inputs:
    """Tables shared by the jobs."""

    matches: DataFrame
    frames: DataFrame
    events: DataFrame
    danger: list | None
    threat: list | None


def load_inputs(spark: SparkSession, folder: str, cfg: EngineConfig, danger_path: str | None = None, threat_path: str | None = None) -> Inputs:
    """Read every complete match folder."""
    ids = discover(spark, folder, cfg.num_matches)
    matches = materialize(read_matches(spark, folder, cfg).join(ids, "match_id", "left_semi"))
    frames = materialize(read_frames(spark, folder, matches, cfg))
    events = read_events(spark, folder).join(matches.select("match_id"), "match_id", "left_semi")
    events = materialize(resolve.id_lookup(events, frames))
    return Inputs(matches, frames, events, read_grid(danger_path) if danger_path else None, read_grid(threat_path) if threat_path else None)


def _owned(inp: Inputs, units: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Frames with the side of the last unit that covers them, direction and
    pitch size."""
    f = inp.frames
    spans = units.select("match_id", "start_frame", "end_frame", "team", F.col("written").alias("__order"))
    nums = f.select("match_id", "frame_num").distinct()
    owner = stamp_last(nums, spans, ["match_id"], "frame_num", "start_frame", "end_frame", "__order", "team", float(cfg.block_frames))
    j = f.join(owner.filter(F.col("team").isNotNull()), ["match_id", "frame_num"]).join(
        inp.matches.select("match_id", "pitch_length", "pitch_width", "start_left", "start_left_extra"), "match_id")
    d = attack_direction("team", "period", F.col("start_left"), F.col("start_left_extra"))
    return j.withColumn("direction", d).drop("start_left", "start_left_extra")


def value_series(inp: Inputs, units: DataFrame, cfg: EngineConfig) -> dict[str, DataFrame]:
    """Sampled value series of owned frames: obso, das, xt and signed epv."""
    owned = materialize(_owned(inp, units, cfg))
    out: dict[str, DataFrame] = {}
    threat = inp.threat if inp.threat is not None else inp.danger
    if inp.danger is not None:
        out["obso"] = series.obso_series(owned, inp.danger, cfg)
        out["epv"] = series.signed_values(owned, inp.danger, "epv")
        sampled = owned.filter((F.col("frame_idx") % cfg.das_stride == 0) & (F.size("home") + F.size("away") >= cfg.das_min_players))
        out["das"] = kernels.dangerous_space(sampled, inp.danger, inp.threat, nodes=cfg.das_nodes, carrier_radius=cfg.carrier_radius)
    if threat is not None:
        out["xt"] = series.signed_values(owned, threat, "xt")
    return out


def _wide(inp: Inputs, units: DataFrame, members: DataFrame, cfg: EngineConfig, identity: list[str]) -> DataFrame:
    located = materialize(resolve.event_frames(inp.events, inp.frames, cfg.ball_scan_frames, cfg.block_seconds).select("match_id", "ordinal", "frame"))
    shapes = features.shape_rows(materialize(features.frame_features(inp.frames)), units, cfg)
    out = units.select(*KEY, *identity).join(shapes, KEY)
    out = out.join(features.speed_rows(inp.frames, units, inp.matches, cfg), KEY, "left")
    out = out.join(possessions.event_aggregates(members, located, units, inp.frames, cfg), KEY, "left")
    out = out.withColumn("events_per_second", F.when(F.col("duration") > 0, F.col("n_events") / F.col("duration")))
    if cfg.control_kind == "map":
        out = out.join(features.control_maps(inp.frames, units, cfg), KEY, "left")
    else:
        sampled = inp.frames.filter(F.col("frame_idx") % cfg.control_stride == 0).join(
            inp.matches.select("match_id", "pitch_length", "pitch_width"), "match_id")
        share = kernels.control_share(sampled, cfg.control_share_nodes, cfg.control_min_players, out="pitch_control")
        out = out.join(features.timed_rows(share, units, ["pitch_control"], cfg, same_team=False), KEY, "left")
    values = value_series(inp, units, cfg)
    for name, columns in (("obso", ["obso"]), ("das", list(kernels.DAS_FIELDS)), ("xt", ["xt"])):
        if name in values:
            out = out.join(features.timed_rows(values[name], units, columns, cfg), KEY, "left")
    return out


IDENTITY = ["sequence_id", "period", "team", "opponent_team", "start_frame", "end_frame", "start_sec", "end_sec", "duration",
            "start_sec_period", "end_sec_period", "setpiece_type", "open_play_indicator", "video_missing"]


def _identified(units: DataFrame) -> DataFrame:
    open_play = F.col("setpiece_type").isNull() | (F.col("setpiece_type") == "O")
    return units.withColumns({"opponent_team": F.when(F.col("team") == "home", "away").otherwise("home"), "open_play_indicator": open_play})


@dataclass
class PossessionTables:
    possessions: DataFrame
    windows: DataFrame
    segments: DataFrame


def _windows(inp: Inputs, keeper: DataFrame, cfg: EngineConfig, templates) -> DataFrame:
    located = resolve.event_seconds(resolve.event_frames(inp.events, inp.frames, cfg.ball_scan_frames, cfg.block_seconds), inp.frames)
    weights = formations.frame_weights(inp.frames, formations.disruptions(located, cfg), cfg.block_seconds)
    return formations.formation_windows(inp.frames, keeper, weights, inp.matches, cfg, templates)


def build_possessions(inp: Inputs, cfg: EngineConfig, templates: dict | None = None) -> PossessionTables:
    """Possession rows, formation windows and formation segments."""
    units, members = possessions.possessions(inp.events, inp.frames, inp.matches, cfg)
    units = materialize(_identified(units))
    keeper = formations.keepers(inp.frames, inp.matches, cfg.keeper_min_frames, float(cfg.block_frames))
    windows = materialize(_windows(inp, keeper, cfg, templates))
    segments = formations.formation_segments(windows)
    rows = _wide(inp, units, members, cfg, IDENTITY)
    rows = formations.attach_formation(rows, segments, ["match_id", "unit"]).drop("unit")
    return PossessionTables(rows, windows, segments)


@dataclass
class PhaseTables:
    phases: DataFrame
    windows: DataFrame
    movement: DataFrame
    recurrence: DataFrame | None = None
    ball_cells: DataFrame | None = None
    ball_paths: DataFrame | None = None
    control: DataFrame | None = None


def build_phases(inp: Inputs, cfg: EngineConfig, templates: dict | None = None, scores: DataFrame | None = None) -> PhaseTables:
    """Phase rows with movement scores and, if asked for, the cell tables.
    ``scores`` reuses movement scores written before."""
    scores = materialize(movement.movement_scores(inp.events, cfg)) if scores is None else scores
    units, members = possessions.phases(inp.events, inp.frames, inp.matches, scores, cfg)
    units = materialize(_identified(units))
    identity = IDENTITY + ["window_id", "reason_closed", "threshold_mean", "threshold_max", "n_passes_in_window"]
    rows = _wide(inp, units, members, cfg, identity).filter(F.col("n_unique_frames") >= cfg.min_phase_frames)
    keeper = materialize(formations.keepers(inp.frames, inp.matches, cfg.keeper_min_frames, float(cfg.block_frames)))
    held = features.unit_frames(inp.frames.drop("period"), units, ["window_id", "sequence_id", "team", "period", "pitch_length", "pitch_width"], float(cfg.block_frames))
    long_enough = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= cfg.min_phase_frames)
    held = materialize(held.join(long_enough.select(*KEY), KEY, "left_semi"))
    fitted = formations.phase_formations(held, keeper, inp.matches, cfg, KEY, templates)
    rows = rows.join(fitted, KEY, "left").drop("unit")
    out = PhaseTables(rows, _windows(inp, keeper, cfg, templates), scores.filter(F.col("status") == "ok"))
    if cfg.emit_grids:
        out.recurrence = maps.occupancy(held, keeper, cfg.players_per_side)
        out.ball_cells = maps.ball_occupancy(held)
        out.ball_paths = maps.ball_paths(held)
        out.control = maps.phase_control(held, cfg.phase_control_stride, cfg.control_min_players)
    return out
