"""Movement of a team between two event snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playframe.config import PASS_CODES, EngineConfig
from playframe.functions.nulls import finite
from playframe.operators.ordered import ordered


def displacement_stats(before: Column, after: Column, key: str) -> Column:
    """Displacements of the players present in both snapshots, as a struct.

    Snapshots hold one squad, so matching inside the row is cheaper than two
    explodes and a join. Of entries that repeat a key the last counts, in both.
    """
    def moved(p: Column) -> Column:
        twin = F.element_at(F.filter(after, lambda q: q[key] == p[key]), -1)
        return F.hypot(twin["x"] - p["x"], twin["y"] - p["y"])

    last = F.filter(before, lambda p, i: ~F.exists(F.slice(before, i + 2, F.size(before)), lambda q: q[key] == p[key]))
    paired = F.filter(last, lambda p: F.exists(after, lambda q: q[key] == p[key]))
    d = F.sort_array(F.transform(paired, moved))

    def describe(s: Column) -> Column:
        n = F.size(s)
        mean = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / n
        half = F.floor(n / 2).cast("int")
        median = F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)
        return F.struct(
            n.alias("n_valid"), F.when(n > 0, mean).alias("mean_disp"), F.when(n > 0, median).alias("median_disp"),
            F.array_max(s).alias("max_disp"), F.array_min(s).alias("min_disp"),
            *[above(s, t).alias(f"n_above_{t}m") for t in (1, 2, 5)],
        )

    def above(s: Column, metres: int) -> Column:
        return F.size(F.filter(s, lambda v: v > metres))

    def with_std(b: Column) -> Column:
        # the deviation is taken about the mean, not from the square sums
        dev = F.aggregate(b["s"], F.lit(0.0), lambda a, v: a + (v - b["m"]["mean_disp"]) * (v - b["m"]["mean_disp"]))
        m = b["m"]
        return F.struct(
            *[m[c].alias(c) for c in ("n_valid", "mean_disp", "median_disp", "max_disp", "min_disp")],
            F.when(m["n_valid"] > 0, F.sqrt(dev / m["n_valid"])).alias("std_disp"),
            *[m[f"n_above_{t}m"].alias(f"n_above_{t}m") for t in (1, 2, 5)],
        )

    def both(s: Column) -> Column:
        return F.struct(s.alias("s"), describe(s).alias("m"))

    one = F.transform(F.array(d), both)
    return F.element_at(F.transform(one, with_std), 1)


def snapshot(players: Column) -> Column:
    """Outfield players of a snapshot with an id and a finite position."""
    good = F.filter(players, lambda p: ~p["positionGroupType"].eqNullSafe(F.lit("GK")) & p["playerId"].isNotNull()
                    & finite(p["x"]).isNotNull() & finite(p["y"]).isNotNull())
    return F.coalesce(good, F.filter(players, lambda p: F.lit(False)))


def movement_scores(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per completed pass or cross with a status: ok, no_next_event,
    missing_snapshot, empty_snapshot or few_valid.

    ``events`` is the flattened event table of ``sources.events``.
    """
    play = events.filter(F.col("sequence").isNotNull()).withColumn("__t", F.coalesce("event_time", F.lit(0.0)))
    nxt = ordered(
        play, ["match_id", "sequence"], ["__t", "ordinal"], cfg.block_seconds,
        lead={"n": F.struct("event_time", "homePlayers", "awayPlayers", "possession_event_type", "game_event_type")},
    )
    passes = nxt.filter(F.col("possession_event_type").isin(*PASS_CODES) & F.col("outcome").eqNullSafe(F.lit("C")) & F.col("home_team").isNotNull())

    def side(prefix: str) -> Column:
        return F.when(F.col("home_team"), F.col(f"{prefix}homePlayers")).otherwise(F.col(f"{prefix}awayPlayers"))

    def any_players(prefix: str) -> Column:
        return (F.coalesce(F.size(F.col(f"{prefix}homePlayers")), F.lit(0)) > 0) | (F.coalesce(F.size(F.col(f"{prefix}awayPlayers")), F.lit(0)) > 0)

    snaps = passes.withColumns({"__before": snapshot(side("")), "__after": snapshot(side("n."))})
    scored = snaps.withColumn("s", displacement_stats(F.col("__before"), F.col("__after"), "playerId"))
    empty = (F.coalesce(F.size("__before"), F.lit(0)) == 0) | (F.coalesce(F.size("__after"), F.lit(0)) == 0)
    status = (
        F.when(F.col("n").isNull(), "no_next_event")
        .when(~any_players("") | ~any_players("n."), "missing_snapshot")
        .when(empty, "empty_snapshot")
        .when(F.col("s.n_valid") < cfg.min_common_players, "few_valid")
        .otherwise("ok")
    )
    span = F.col("end_time") - F.col("start_time")
    ok = F.col("status") == "ok"
    shown = scored.withColumn("status", status)
    measures = ["mean_disp", "median_disp", "max_disp", "min_disp", "std_disp", "n_above_1m", "n_above_2m", "n_above_5m"]
    return shown.select(
        "match_id", F.col("sequence").alias("sequence_id"), "game_event_id", "possession_event_id", "period",
        F.when(F.col("home_team"), "home").otherwise("away").alias("team"), "setpiece_type",
        F.col("possession_event_type").alias("event_type"), F.col("start_time").alias("event_start_time"),
        F.col("end_time").alias("event_end_time"), "event_time", "status",
        F.when(ok, F.coalesce("n.possession_event_type", "n.game_event_type")).alias("next_event_type"),
        F.when(ok, F.col("n.event_time")).alias("next_event_time"),
        F.when(F.col("status").isin("ok", "few_valid"), F.col("s.n_valid")).alias("n_valid"),
        F.when(ok & span.between(0.0, cfg.max_touch_seconds), span).alias("touch_duration"),
        F.when(ok, F.col("n.event_time") - F.col("event_time")).alias("time_to_next"),
        *[F.when(ok, F.col(f"s.{m}")).alias(m) for m in measures],
    )
