"""From events to frames: id lookups, clocks, and the search for a ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playframe.operators.ranges import asof_forward, points_in_intervals


def nearest_ball_frame(anchors: DataFrame, frames: DataFrame, ids: list[str], anchor: str, reach: int) -> DataFrame:
    """Closest frame with a ball within ``reach`` frames of an anchor, the
    later one first at equal distance."""
    keep = list(dict.fromkeys(["match_id", *ids]))
    spans = anchors.select(*[F.col(c).alias(f"__a_{c}") if c != "match_id" else F.col(c) for c in keep],
                           F.col(anchor).alias("__at"), (F.col(anchor) - reach).alias("__lo"), (F.col(anchor) + reach).alias("__hi"))
    valid = frames.filter(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()).select("match_id", F.col("frame_idx").alias("__f"))
    held = points_in_intervals(valid, spans, ["match_id"], "__f", "__lo", "__hi", float(8 * reach))
    off = F.col("__f") - F.col("__at")
    grouped = [c if c == "match_id" else f"__a_{c}" for c in keep]
    hit = held.groupBy(*grouped).agg(F.min_by("__f", F.struct(F.abs(off), off < 0)).alias("hit"))
    return hit.select(*[F.col(g).alias(c) for g, c in zip(grouped, keep)], "hit")


def spread_null(key: str, spare: str = "ordinal") -> Column:
    """Key of a left join in which missing keys do not all meet in one task:
    they become negative numbers of their own, which no real id equals."""
    return F.coalesce(F.col(key), -1 - F.col(spare))


def id_lookup(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of every event by possession-event id, else by game-event id:
    first and last frame, and the first one with a ball.

    Ids are aggregated to one row each before the joins, so a hot id moves one
    row, not its frames.
    """
    ball = F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()

    def per_id(column: str, prefix: str) -> DataFrame:
        return frames.filter(F.col(column).isNotNull()).groupBy("match_id", column).agg(
            F.min("frame_idx").alias(f"{prefix}_lo"), F.max("frame_idx").alias(f"{prefix}_hi"),
            F.min(F.when(ball, F.col("frame_idx"))).alias(f"{prefix}_ball"))

    pe = per_id("pe_id", "pe").withColumnRenamed("pe_id", "__pe")
    ge = per_id("ge_id", "ge").withColumnRenamed("ge_id", "__ge")
    keyed = events.withColumns({"__pe": spread_null("possession_event_id"), "__ge": spread_null("game_event_id")})
    j = keyed.join(pe, ["match_id", "__pe"], "left").join(ge, ["match_id", "__ge"], "left").drop("__pe", "__ge")
    by_pe = F.col("pe_lo").isNotNull()
    for name in ("lo", "hi", "ball"):
        j = j.withColumn(f"id_{name}", F.when(by_pe, F.col(f"pe_{name}")).otherwise(F.col(f"ge_{name}")))
    return j.drop(*[f"{p}_{n}" for p in ("pe", "ge") for n in ("lo", "hi", "ball")])


def by_clock(rows: DataFrame, frames: DataFrame, ids: list[str], clock: str, out: str, width: float) -> DataFrame:
    """First frame at or after a game clock, clamped to the last one."""
    series = frames.filter(F.col("game_clock").isNotNull()).select("match_id", F.col("game_clock").alias("__gc"), F.col("frame_idx").alias(out))
    return asof_forward(rows.select(*ids, clock), series, ["match_id"], clock, "__gc", out, [out], width).drop(clock)


def by_time(rows: DataFrame, frames: DataFrame, ids: list[str], seconds: str, out: str, width: float) -> DataFrame:
    """First frame at or after a second of the period, clamped to the last one;
    over all frames of the match when the period has none."""
    per = frames.select("match_id", "period", F.col("elapsed").alias("__el"), F.col("frame_idx").alias(out))
    asked = rows.select(*ids, *([] if "period" in ids else ["period"]), seconds)
    hit = asof_forward(asked, per, ["match_id", "period"], seconds, "__el", out, [out], width)
    missed = asked.join(frames.select("match_id", "period").distinct(), ["match_id", "period"], "left_anti")
    whole = asof_forward(missed, per.drop("period"), ["match_id"], seconds, "__el", out, [out], width)
    return hit.select(*ids, out).unionByName(whole.select(*ids, out))


def event_frames(events: DataFrame, frames: DataFrame, reach: int, width: float) -> DataFrame:
    """Frame of every event: its first frame with a ball, else the closest frame
    with one, else the frame at its game clock. Adds ``frame`` to the rows of
    ``id_lookup``."""
    ids = ["match_id", "ordinal"]
    seek = events.filter(F.col("id_lo").isNotNull() & F.col("id_ball").isNull())
    near = nearest_ball_frame(seek.select(*ids, "id_lo"), frames, ids, "id_lo", reach).withColumnRenamed("hit", "__near")
    clock = by_clock(events.filter(F.col("game_clock").isNotNull() & F.col("id_ball").isNull()), frames, ids, "game_clock", "__clock", width)
    j = events.join(near, ids, "left").join(clock, ids, "left")
    return j.withColumn("frame", F.coalesce("id_ball", "__near", "__clock")).drop("__near", "__clock")


def event_seconds(located: DataFrame, frames: DataFrame) -> DataFrame:
    """Period and second of every event: from its frame, else from the first
    frame whose number reaches its start frame (clamped to the last)."""
    ids = ["match_id", "ordinal"]
    no_frame = located.filter(F.col("frame").isNull() & F.col("start_frame").isNotNull())
    numbered = frames.select("match_id", F.col("frame_num").alias("__fn"), F.col("frame_idx").alias("__by_num"))
    by_num = asof_forward(no_frame.select(*ids, "start_frame"), numbered, ["match_id"], "start_frame", "__fn", "__by_num", ["__by_num"], 4096.0)
    j = located.join(by_num.select(*ids, "__by_num"), ids, "left").withColumn("__f", F.coalesce("frame", "__by_num", -1 - F.col("ordinal")))
    at = frames.select("match_id", F.col("frame_idx").alias("__f"), F.col("period").alias("__p"), F.col("elapsed").alias("second"))
    return j.join(at, ["match_id", "__f"], "left").withColumn("period", F.col("__p")).drop("__p", "__f", "__by_num")
