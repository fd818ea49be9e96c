"""Possessions and phases as intervals of frames, and their event aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playframe.config import EVENT_CODE_NAMES, ON_TARGET_OUTCOMES, PASS_CODES, PRESSURE_OUTCOMES, SHOT_CODE, EngineConfig
from playframe.functions.direction import attack_direction
from playframe.functions.nulls import ratio
from playframe.functions.stats import counts_as_json, majority_home
from playframe.operators import segments
from playframe.operators.ordered import ordered
from playframe.plans.resolve import by_clock, by_time, spread_null
from playframe.session import materialize
from playframe.sources.events import is_stoppage

KEY = ["match_id", "unit"]


def _first_game_events(events: DataFrame, moment: str, order: list[str]) -> DataFrame:
    """Setpiece of the first game event and the video flag of any, over the
    first event of every game-event id of a unit."""
    first = events.groupBy(*KEY, "game_event_id").agg(
        F.min_by(F.struct("setpiece_type", "video_missing", F.coalesce(moment, F.lit(0.0)).alias("t"), "ordinal"), F.struct(*order)).alias("g"))
    return first.groupBy(*KEY).agg(
        F.min_by("g.setpiece_type", F.struct("g.t", "g.ordinal")).alias("setpiece_type"),
        F.coalesce(F.bool_or("g.video_missing"), F.lit(False)).alias("video_missing"))


def _bounds(units: DataFrame, frames: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Frame bounds of a unit: from event ids, else game clocks, else seconds."""
    open_ = units.filter(F.col("lo").isNull())
    clocked = open_.filter(F.col("min_clock").isNotNull())
    lo = by_clock(clocked, frames, KEY, "min_clock", "clock_lo", cfg.block_seconds)
    hi = by_clock(clocked, frames, KEY, "max_clock", "clock_hi", cfg.block_seconds)
    j = units.join(lo, KEY, "left").join(hi, KEY, "left")
    both = F.col("clock_lo").isNotNull() & F.col("clock_hi").isNotNull()
    j = j.withColumns({"lo": F.coalesce("lo", F.when(both, F.col("clock_lo"))), "hi": F.coalesce("hi", F.when(both, F.col("clock_hi")))})
    timed = j.filter(F.col("lo").isNull())
    t_lo = by_time(timed, frames, KEY, "start_sec", "time_lo", cfg.block_seconds)
    t_hi = by_time(timed, frames, KEY, "end_sec", "time_hi", cfg.block_seconds)
    j = j.join(t_lo, KEY, "left").join(t_hi, KEY, "left")
    j = j.withColumns({"lo": F.coalesce("lo", "time_lo"), "hi": F.coalesce("hi", "time_hi")}).filter(F.col("lo").isNotNull() & F.col("hi").isNotNull())
    at = frames.select("match_id", "frame_idx", "frame_num", "elapsed")
    a = at.select("match_id", F.col("frame_idx").alias("lo"), F.col("frame_num").alias("start_frame"), F.col("elapsed").alias("start_sec_period"))
    b = at.select("match_id", F.col("frame_idx").alias("hi"), F.col("frame_num").alias("end_frame"), F.col("elapsed").alias("end_sec_period"))
    return j.join(a, ["match_id", "lo"]).join(b, ["match_id", "hi"]).drop("clock_lo", "clock_hi", "time_lo", "time_hi")


def _with_direction(units: DataFrame, matches: DataFrame) -> DataFrame:
    j = units.join(matches, "match_id")
    d = attack_direction("team", "period", F.col("start_left"), F.col("start_left_extra"))
    return j.withColumn("direction", d)


def possessions(events: DataFrame, frames: DataFrame, matches: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """One row per possession, and its events. ``unit`` is the sequence.

    ``events`` comes from ``resolve.id_lookup``.
    """
    play = events.filter(F.col("sequence").isNotNull()).withColumn("unit", F.col("sequence").cast("string"))
    g = play.groupBy(*KEY).agg(
        F.first("sequence").alias("sequence_id"), majority_home("home_ball", "home_team").alias("team"),
        F.min("start_time").alias("start_sec"), F.max("end_time").alias("end_sec"), F.min_by("period", "ordinal").alias("period"),
        F.min("game_clock").alias("min_clock"), F.max("game_clock").alias("max_clock"),
        F.min("id_lo").alias("lo"), F.max("id_hi").alias("hi"), F.min("ordinal").alias("first_ordinal"))
    last = frames.groupBy("match_id").agg(F.max("game_clock").alias("__last"))
    g = g.filter(F.col("team").isNotNull() & F.col("start_sec").isNotNull() & F.col("end_sec").isNotNull()).join(last, "match_id")
    phantom = F.coalesce(F.col("min_clock") > F.col("__last") + cfg.post_end_grace, F.lit(False))
    g = g.filter(~phantom).drop("__last").withColumn(
        "period", F.coalesce("period", F.when(F.col("start_sec") < 2700, 1).otherwise(2)))
    u = _bounds(g, frames, cfg).withColumns({
        "duration": F.col("end_sec") - F.col("start_sec"), "written": F.struct(F.col("start_frame").alias("a"), F.col("first_ordinal").alias("b"))})
    u = u.join(_first_game_events(play, "start_time", ["ordinal"]), KEY)
    return _with_direction(u, matches), play.join(u.select(*KEY), KEY, "left_semi")


def phases(events: DataFrame, frames: DataFrame, matches: DataFrame, scores: DataFrame, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """One row per tactical phase, and its events. ``unit`` is the phase.

    Movement scores are matched on match and event id.
    """
    team = events.filter(F.col("sequence").isNotNull()).groupBy("match_id", "sequence").agg(
        F.min_by("home_team", F.struct(F.coalesce("event_time", F.lit(0.0)), "ordinal")).alias("__home"),
        F.min("ordinal").alias("__seq_first"))
    ok = scores.filter(F.col("status") == "ok").groupBy("match_id", "possession_event_id").agg(
        F.max_by(F.struct("mean_disp", "max_disp"), "event_time").alias("__s"))
    keyed = events.withColumn("__pe", spread_null("possession_event_id"))
    j = keyed.join(ok.withColumnRenamed("possession_event_id", "__pe"), ["match_id", "__pe"], "left").drop("__pe")
    is_pass = F.coalesce(F.col("possession_event_type").isin(*PASS_CODES), F.lit(False))
    done = F.col("outcome").eqNullSafe(F.lit("C"))
    reason = segments.local_reason(is_pass, done, F.col("possession_event_type").eqNullSafe(F.lit(SHOT_CODE)),
                                   F.col("__s.mean_disp"), F.col("__s.max_disp"), cfg.threshold_mean, cfg.threshold_max)
    flagged = j.withColumns({"is_stop": is_stoppage(), "reason": reason, "counted": is_pass & done}).drop("__s")
    relevant = flagged.filter(F.col("is_stop") | F.col("sequence").isNotNull())
    assigned = segments.assign_windows(
        relevant, ["match_id"], ["sequence"], time="event_time", ordinal="ordinal", stop="is_stop", reason="reason", counted="counted",
        max_passes=cfg.max_window_passes, max_seconds=cfg.max_window_seconds, width=cfg.block_seconds, block_rows=cfg.block_rows)
    assigned = materialize(assigned)
    order = F.struct("event_time", "ordinal")
    extra = [
        F.min_by("period", order).alias("period"), F.min("game_clock").alias("min_clock"), F.max("game_clock").alias("max_clock"),
        F.min("id_lo").alias("lo"), F.max("id_hi").alias("hi"),
    ]
    windows = segments.summarise_windows(
        assigned, ["match_id"], ["sequence"], time="event_time", ordinal="ordinal", reason="reason", counted="counted",
        max_passes=cfg.max_window_passes, max_seconds=cfg.max_window_seconds, extra=extra)
    windows = windows.join(team, ["match_id", "sequence"]).filter(F.col("__home").isNotNull()).drop("n_events")
    # phases are numbered over the match: sequences by first appearance, then time
    windows = windows.withColumn("unit", F.concat_ws(":", "sequence", "run_stops", "run_closes", "win"))
    windows = windows.withColumns({"period": F.coalesce("period", F.lit(1)), "team": F.when(F.col("__home"), "home").otherwise("away")})
    bounded = materialize(_bounds(windows, frames, cfg))
    numbered = ordered(bounded, ["match_id"], ["__seq_first", "start_sec", "first_ordinal"], 4096.0, index="__n")
    named = numbered.withColumn("window_id", F.concat_ws("_", F.col("sequence").cast("string"), (F.col("__n") + 1).cast("string")))
    named = named.withColumn("written", F.struct(F.col("__n").alias("a"), F.col("first_ordinal").alias("b")))
    named = named.withColumnRenamed("sequence", "sequence_id").drop("__n", "__home", "__seq_first", "run_stops", "run_closes", "win")
    named = named.withColumns({"threshold_mean": F.lit(cfg.threshold_mean), "threshold_max": F.lit(cfg.threshold_max)})
    members = assigned.withColumn("unit", F.concat_ws(":", "sequence", "run_stops", "run_closes", "win"))
    members = members.join(named.select(*KEY), KEY, "left_semi")
    named = named.join(_first_game_events(members, "event_time", ["event_time", "ordinal"]), KEY)
    return _with_direction(named, matches), members


def event_aggregates(members: DataFrame, located: DataFrame, units: DataFrame, frames: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Counts, rates, value distributions and progression per unit.

    ``located`` has the frame of every event.
    """
    kind = F.col("possession_event_type")
    is_pass, is_carry, is_shot = kind.isin(*PASS_CODES), kind == "BC", kind == SHOT_CODE
    done = is_pass & F.col("outcome").eqNullSafe(F.lit("C"))
    counts = members.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_events"), *[F.count_if(kind == code).alias(f"n_{name}s") for code, name in EVENT_CODE_NAMES.items()],
        F.count_if(is_pass).alias("n_pass_attempts"), F.count_if(done).alias("n_completed_passes"),
        F.count_if(is_pass & F.col("lines_broken").isNotNull()).alias("lines_broken_count"),
        F.count_if(is_carry & F.col("carry_successful").eqNullSafe(F.lit(True))).alias("successful_carries"),
        F.count_if(is_shot & (F.col("shot_outcome") == "G")).alias("goals"),
        F.count_if(is_shot & F.col("shot_outcome").isin(*ON_TARGET_OUTCOMES)).alias("shots_on_target"),
        F.count_if(F.col("pressure_type").isin(*PRESSURE_OUTCOMES)).alias("n_pressured_actions"),
        F.count_if(F.col("opportunity_type") == "C").alias("n_chances_created"),
        F.count_if(F.col("opportunity_type") == "D").alias("n_dangerous_positions"))
    counts = counts.withColumns({
        "pass_completion_rate": ratio("n_completed_passes", "n_pass_attempts"), "carry_success_rate": ratio("successful_carries", "n_carrys"),
        "pressure_rate": ratio("n_pressured_actions", "n_events")})

    wanted = {"pass_type": is_pass, "accuracy_type": done, "incompletion_reason": is_pass & ~done, "carry_intent": is_carry, "carry_type": is_carry}
    pairs = F.array(*[F.struct(F.lit(n).alias("d"), F.when(c, F.col(n)).alias("k")) for n, c in wanted.items()])
    tall = members.select(*KEY, F.explode(pairs).alias("e")).filter(F.col("e.k").isNotNull())
    tall = tall.groupBy(*KEY, F.col("e.d").alias("d"), F.col("e.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    packed = tall.groupBy(*KEY).agg(*[F.collect_list(F.when(F.col("d") == n, F.struct("k", "n"))).alias(n) for n in wanted])
    packed = packed.select(*KEY, *[counts_as_json(n).alias(f"{n}_distribution") for n in wanted])

    moves = members.filter(is_pass | is_carry).select(*KEY, "ordinal", F.coalesce("start_time", F.lit(0.0)).alias("__t"))
    spot = located.filter(F.col("frame").isNotNull()).select("match_id", "ordinal", F.col("frame").alias("frame_idx"))
    ball = frames.select("match_id", "frame_idx", F.when(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull(), F.struct("ball_x", "ball_y")).alias("__pos"))
    moves = moves.join(spot.join(ball, ["match_id", "frame_idx"]).drop("frame_idx"), ["match_id", "ordinal"], "left")
    seen = ordered(moves, KEY, ["__t", "ordinal"], cfg.block_seconds, lag={"__was": F.col("__pos")})
    seen = seen.join(units.select(*KEY, "direction"), KEY)
    dx, dy = F.col("__pos.ball_x") - F.col("__was.ball_x"), F.col("__pos.ball_y") - F.col("__was.ball_y")
    dist, fwd = F.sqrt(dx * dx + dy * dy), F.col("direction") * dx
    prog = seen.groupBy(*KEY).agg(
        F.avg(dist).alias("mean_progression_distance"), F.sum(dist).alias("total_progression_distance"),
        F.avg(fwd).alias("mean_forward_progression"), F.sum(fwd).alias("total_forward_progression"))
    out = counts.join(packed, KEY, "left").join(prog, KEY, "left")
    return out.withColumns({f"{n}_distribution": F.coalesce(f"{n}_distribution", F.lit("{}")) for n in wanted})

