"""Views that give the generic sample tables the shape of match data, so that
the operators can be run and checked on them.

events            -> event log: one match and sequence per user
lineitem, orders  -> tracking: five orders make one frame of up to 35 players
orders            -> ball track and possession intervals on those frames
lineitem          -> sparse cell maps (discount x quantity)
embeddings        -> feature vectors with a label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LENGTH, WIDTH = 105.0, 68.0
FRAMES_PER_MATCH = 500
FRAMES_PER_PERIOD = 250
SPAN_FRAMES = 10
SLOTS_PER_SIDE = 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _seconds(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Errors are stoppages, purchases above 60 shots, views and clicks passes
    (clicks above 60 fail), all else ball carries."""
    e = table(spark, folder, "events")
    kind, value = F.col("event_type"), F.col("value")
    is_shot = (kind == "purchase") & (value > 60)
    is_pass = kind.isin("view", "click")
    return e.select(
        F.col("user_id").alias("match_id"), F.col("user_id").alias("sequence_id"),
        F.col("event_id").alias("ordinal"), _seconds("ts").alias("t"), "event_type", "value",
        (kind == "error").alias("is_stop"), is_pass.alias("is_pass"), is_shot.alias("is_shot"),
        (is_pass & ~((kind == "click") & (value > 60))).alias("completed"),
        (value / 50).alias("mean_disp"), (F.pmod(F.col("event_id") * 37, F.lit(100)) / 20.0).alias("max_disp"),
        F.when(F.col("user_id") % 2 == 0, "home").otherwise("away").alias("team"),
    )


def ball_points(spark: SparkSession, folder: str) -> DataFrame:
    """A ball position per event."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("match_id"), F.col("event_id").alias("frame_idx"), _seconds("ts").alias("elapsed"),
        F.when(F.dayofmonth(F.col("ts").cast("timestamp")) <= 15, 1).otherwise(2).alias("period"),
        (F.pmod(F.col("event_id") * 37, F.lit(1050)) / 10.0).alias("x"),
        (F.pmod(F.col("event_id") * 53, F.lit(680)) / 10.0).alias("y"),
        F.when(F.col("user_id") % 2 == 0, "home").otherwise("away").alias("team"), "value",
    )


def player_points(spark: SparkSession, folder: str) -> DataFrame:
    """One row per player and frame; slots of a frame are unique. Every 97th
    position is missing and every 10th unreliable."""
    rows = table(spark, folder, "lineitem").select(
        F.expr("l_orderkey div 5").alias("frame"),
        ((F.col("l_orderkey") % 5) * 7 + F.col("l_linenumber") - 1).cast("int").alias("slot"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("code"),
    )
    best = rows.groupBy("frame", "slot").agg(F.max("code").alias("code"))
    known = F.col("code") % 97 != 0
    frame_in_match = F.col("frame") % FRAMES_PER_MATCH
    return best.select(
        F.expr(f"frame div {FRAMES_PER_MATCH}").alias("match_id"), frame_in_match.alias("frame_idx"),
        (F.lit(1) + F.floor(frame_in_match / FRAMES_PER_PERIOD)).cast("int").alias("period"),
        (frame_in_match % FRAMES_PER_PERIOD).cast("double").alias("elapsed"),
        F.when(F.col("slot") < SLOTS_PER_SIDE, "home").otherwise("away").alias("side"),
        (F.col("slot") % SLOTS_PER_SIDE).alias("player_rank"),
        F.when(known, (F.col("code") * 37 % 1051) / 10.0).alias("x"),
        F.when(known, (F.col("code") * 53 % 681) / 10.0).alias("y"),
        (F.col("code") % 10 != 0).alias("reliable"),
    )


def ball_track(spark: SparkSession, folder: str) -> DataFrame:
    """Ball per frame, from the customers of all five orders of a group. Every
    11th position is missing."""
    o = table(spark, folder, "orders").groupBy(F.expr("o_orderkey div 5").alias("frame")).agg(F.sum("o_custkey").alias("code"))
    in_match, code = F.col("frame") % FRAMES_PER_MATCH, F.col("code")
    known = code % 11 != 0
    return o.select(
        F.expr(f"frame div {FRAMES_PER_MATCH}").alias("match_id"), in_match.alias("frame_idx"),
        (F.lit(1) + F.floor(in_match / FRAMES_PER_PERIOD)).cast("int").alias("period"),
        (in_match % FRAMES_PER_PERIOD).cast("double").alias("elapsed"),
        F.when(known, (code * 37 % 1051) / 10.0).alias("ball_x"),
        F.when(known, (code * 53 % 681) / 10.0).alias("ball_y"),
        F.when(known, (code % 7) / 2.0).alias("ball_z"),
    )


def possession_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Frame intervals that overlap now and then: one starts in every ten frames
    and lasts 3 to 17 frames, by the customers of all orders of those frames."""
    per = FRAMES_PER_MATCH // SPAN_FRAMES
    o = table(spark, folder, "orders").groupBy(F.expr(f"o_orderkey div {5 * SPAN_FRAMES}").alias("poss_id")).agg(F.sum("o_custkey").alias("code"))
    start = F.col("poss_id") % per * SPAN_FRAMES + F.col("code") % 5
    return o.select(
        F.expr(f"poss_id div {per}").alias("match_id"), "poss_id", start.alias("start_frame"), (start + 3 + F.col("code") % 15).alias("end_frame"),
        F.when(F.col("code") % 2 == 0, "home").otherwise("away").alias("team"),
    )


def order_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals per customer: an order lasts until the next one (a day for the
    last). Orders of one moment keep key order."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("ordinal"),
        (_seconds("o_orderdate") / 86400.0).alias("day"), F.col("o_orderpriority").alias("label"),
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Tracking frames in the engine's layout: players as two arrays in rank
    order, missing positions left out. A side has at most 18 slots, so the
    arrays are bounded."""
    p = player_points(spark, folder)
    item = F.struct(F.col("player_rank").alias("rank"), F.col("player_rank").cast("string").alias("pid"), "x", "y", "reliable")
    sides = p.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("match_id", "frame_idx").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "home", item))).alias("home"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "away", item))).alias("away"),
    )
    joined = ball_track(spark, folder).join(sides, ["match_id", "frame_idx"], "left")
    return joined.withColumns({
        "frame_num": F.col("frame_idx"), "home": F.coalesce("home", F.expr("cast(array() as " + PLAYER_ARRAY + ")")),
        "away": F.coalesce("away", F.expr("cast(array() as " + PLAYER_ARRAY + ")")),
    })


PLAYER_ARRAY = "array<struct<rank:int,pid:string,x:double,y:double,reliable:boolean>>"


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse maps: one per supplier, on 11 x 50 cells."""
    li = table(spark, folder, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("map_id"), F.round(F.col("l_discount") * 100).cast("int").alias("row"),
        (F.col("l_quantity").cast("int") - 1).alias("col"), F.col("l_extendedprice").alias("amount"),
        F.col("l_returnflag").alias("side"), F.col("l_linestatus").alias("state"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").cast("array<double>").alias("features"),
        (F.col("vec_id") % 20).alias("match_id"),
    )
