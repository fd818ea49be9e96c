"""Raw match files to the engine's tables: match dimension and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from playframe.config import VISIBLE_VALUES, EngineConfig
from playframe.functions.nulls import finite
from playframe.session import materialize
from playframe.sources.files import match_of

_PLAYER = "array<struct<jerseyNum:string,jersey_num:string,x:double,y:double,visibility:string,confidence:string>>"
_BALL = "struct<x:double,y:double,z:double>"
FRAME_SCHEMA = (
    "frameNum bigint, period int, periodElapsedTime double, periodGameClockTime double, period_game_clock_time double, "
    "possession_event_id string, possessionEventId string, game_event_id string, gameEventId string, "
    f"homePlayers {_PLAYER}, awayPlayers {_PLAYER}, homePlayersSmoothed {_PLAYER}, awayPlayersSmoothed {_PLAYER}, "
    "balls string, ballsSmoothed string, _corrupt string"
)
META_SCHEMA = (
    "stadium struct<pitches:string>, pitch struct<length:double,width:double>, pitchLength double, pitchWidth double, fps double, "
    "homeTeamStartLeft boolean, homeTeamStartLeftExtraTime boolean, "
    "goalkeepers struct<home:struct<shirtNumber:string>,away:struct<shirtNumber:string>>"
)
_PITCH = "struct<length:double,width:double>"


def _object_or_list(text: Column, schema: str) -> Column:
    """JSON that is an object, or a list whose first element counts."""
    as_list = F.get(F.from_json(text, f"array<{schema}>"), F.lit(0))
    return F.when(F.ltrim(text).startswith("["), as_list).otherwise(F.from_json(text, schema))


def read_matches(spark: SparkSession, folder: str, cfg: EngineConfig) -> DataFrame:
    """One row per match: pitch size, frame rate, start sides, keepers."""
    raw = spark.read.text(f"{folder}/*/metadata.json", wholetext=True)
    schema = "struct<" + ", ".join(p.replace(" ", ":", 1) for p in META_SCHEMA.split(", ")) + ">"
    m = raw.select(match_of(F.col("_metadata.file_path")).alias("match_id"), _object_or_list(F.col("value"), schema).alias("m"))
    pitches = _object_or_list(F.col("m.stadium.pitches"), _PITCH)
    m = m.withColumn("p", pitches)

    def size(name: str, flat: str, default: float) -> Column:
        return F.coalesce(
            F.when(F.col("m.stadium.pitches").isNotNull(), F.coalesce(F.col(f"p.{name}"), F.lit(default)))
            .when(F.col("m.pitch").isNotNull(), F.coalesce(F.col(f"m.pitch.{name}"), F.lit(default))),
            F.col(f"m.{flat}"), F.lit(default))

    fps = F.col("m.fps")
    keeper = {s: F.col(f"m.goalkeepers.{s}.shirtNumber") for s in ("home", "away")}
    return m.select(
        "match_id", size("length", "pitchLength", cfg.default_pitch_length).alias("pitch_length"),
        size("width", "pitchWidth", cfg.default_pitch_width).alias("pitch_width"),
        F.when(fps.isNotNull() & (fps != 0), fps).otherwise(F.lit(cfg.default_fps)).alias("fps"),
        F.col("m.homeTeamStartLeft").alias("start_left"), F.col("m.homeTeamStartLeftExtraTime").alias("start_left_extra"),
        *[F.when(~k.isin("", "0"), k).alias(f"{s}_keeper") for s, k in keeper.items()],
    )


def _single(c: Column) -> Column:
    """Positions and clocks are kept in single precision."""
    return finite(c.cast("float").cast("double"))


def _players(frame: str, side: str, cfg: EngineConfig, length: Column, width: Column) -> Column:
    """Clean player array of a side: smoothed if present, without missing
    positions, the last entry of an id, in id order (numbers first)."""
    raw, smooth = F.col(f"{frame}.{side}Players"), F.col(f"{frame}.{side}PlayersSmoothed")
    source = F.when(F.size(smooth) > 0, smooth).otherwise(raw) if cfg.use_smoothed else raw

    def item(p: Column) -> Column:
        pid = F.coalesce(p["jerseyNum"], p["jersey_num"])
        numeric = pid.rlike(r"^\s*[+-]?\d+\s*$")
        return F.struct(
            F.when(numeric, 0).otherwise(1).alias("kind"), F.when(numeric, F.trim(pid).try_cast("bigint")).alias("number"),
            pid.alias("pid"), _single(p["x"] + length / 2).alias("x"), _single(p["y"] + width / 2).alias("y"),
            F.coalesce(p["visibility"], F.lit("VISIBLE")).isin(*VISIBLE_VALUES).alias("reliable"))

    items = F.transform(F.coalesce(source, F.array().cast(_PLAYER)), item)
    known = F.filter(items, lambda p: p["pid"].isNotNull() & ~p["pid"].isin("", "0") & p["x"].isNotNull() & p["y"].isNotNull())

    def unique(one: Column) -> Column:
        k = one
        return F.array_sort(F.filter(k, lambda p, i: ~F.exists(F.slice(k, i + 2, F.size(k)), lambda q: q["pid"] == p["pid"])))

    ordered_items = F.element_at(F.transform(F.array(known), unique), 1)
    return F.transform(ordered_items, lambda p, i: F.struct(
        i.cast("int").alias("rank"), p["pid"].alias("pid"), p["x"].alias("x"), p["y"].alias("y"), p["reliable"].alias("reliable")))


def read_frames(spark: SparkSession, folder: str, matches: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Tracking frames of all matches.

    Lines that are not JSON objects are skipped. ``frame_idx`` is the position
    of a frame in its file: rows of a file split carry increasing ids in read
    order, and splits are ordered by their offset. Parsed frames are written
    once; what is grouped and joined after that has one row per file split, so
    the frames themselves are never sorted or numbered by a window.
    """
    raw = spark.read.text(f"{folder}/*/tracking.jsonl.bz2").select(
        match_of(F.col("_metadata.file_path")).alias("match_id"), F.col("_metadata.file_block_start").alias("split"), "value")
    text = F.col("value")
    for name in "XYZ":
        text = F.when(text.contains(f'"{name}"'), F.regexp_replace(text, f'"{name}"\\s*:', f'"{name.lower()}":')).otherwise(text)
    f = F.from_json(text, FRAME_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = raw.select("match_id", "split", f.alias("f")).filter(F.col("f").isNotNull() & F.col("f._corrupt").isNull())
    parsed = good.select("match_id", "split", F.monotonically_increasing_id().alias("line"), "f")
    parsed = parsed.join(matches.select("match_id", "pitch_length", "pitch_width"), "match_id")
    pl, pw = F.col("pitch_length"), F.col("pitch_width")

    def positive_id(*names: str) -> Column:
        v = F.coalesce(*[F.col(f"f.{n}") for n in names])
        v = F.coalesce(v.try_cast("bigint"), v.try_cast("double").try_cast("bigint"))
        return F.when(v > 0, v)

    balls = F.when(F.length(F.col("f.ballsSmoothed")) > 2, F.col("f.ballsSmoothed")).otherwise(F.col("f.balls")) if cfg.use_smoothed else F.col("f.balls")
    parsed = parsed.withColumn("b", _object_or_list(balls, _BALL))
    both = F.col("b.x").isNotNull() & F.col("b.y").isNotNull()
    table = parsed.select(
        "match_id", "split", "line", F.col("f.frameNum").alias("frame_num"), F.coalesce("f.period", F.lit(0)).alias("period"),
        F.coalesce(_single(F.col("f.periodElapsedTime")), F.lit(0.0)).alias("elapsed"),
        _single(F.coalesce("f.periodGameClockTime", "f.period_game_clock_time")).alias("game_clock"),
        positive_id("possession_event_id", "possessionEventId").alias("pe_id"), positive_id("game_event_id", "gameEventId").alias("ge_id"),
        _players("f", "home", cfg, pl, pw).alias("home"), _players("f", "away", cfg, pl, pw).alias("away"),
        F.when(both, _single(F.col("b.x") + pl / 2)).alias("ball_x"), F.when(both, _single(F.col("b.y") + pw / 2)).alias("ball_y"),
        _single(F.col("b.z")).alias("ball_z"),
    )
    staged = materialize(table)
    # ids run on without gaps inside a split, so a position is the distance to
    # the first id of the split plus the rows of the splits before it
    splits = staged.groupBy("match_id", "split").agg(F.min("line").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("match_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.col("line") - F.col("__first") + F.col("__before")
    out = staged.join(splits, ["match_id", "split"]).withColumn("frame_idx", place).drop("split", "line", "__first", "__n", "__before")
    return out.withColumn("frame_num", F.coalesce("frame_num", "frame_idx"))


def quality_report(frames: DataFrame) -> DataFrame:
    """Coordinate ranges and coverage per match."""
    hx = F.transform("home", lambda p: p["x"])
    hy = F.transform("home", lambda p: p["y"])
    return frames.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min(F.array_min(hx)).alias("home_x_min"), F.max(F.array_max(hx)).alias("home_x_max"),
        F.min(F.array_min(hy)).alias("home_y_min"), F.max(F.array_max(hy)).alias("home_y_max"),
        F.min("ball_x").alias("ball_x_min"), F.max("ball_x").alias("ball_x_max"),
        F.count_if(F.size("home") > 0).alias("frames_with_home"), F.count_if(F.size("away") > 0).alias("frames_with_away"),
        F.count_if(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()).alias("frames_with_ball"),
        F.count("pe_id").alias("frames_with_possession_event"), F.count("game_clock").alias("frames_with_clock"))
