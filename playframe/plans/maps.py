"""Phase-level maps: player occupancy, ball occupancy and path, control share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playframe.functions.gridding import edge_bin, metre_cells
from playframe.functions.nulls import ratio
from playframe.operators import grids
from playframe.operators.kernels import control_arrays, open_totals
from playframe.operators.ordered import ordered
from playframe.session import materialize

PHASE_KEYS = ["match_id", "window_id"]
PHASE_INFO = ["sequence_id", "team", "period"]
TASK_FRAMES = 4096  # frames of phases dealt to a task


def path_summary(points: DataFrame, keys: list[str], order: str, x: str, y: str, width: float,
                 with_path: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Length, net displacement and straightness of ordered positions; with
    ``with_path`` also the coordinates as arrays (one entry per frame of a
    phase, which the phase rules bound)."""
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pos = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    seen = ordered(known, keys, [order], width, lag={"__p": pos})
    dx, dy = F.col(x) - F.col("__p.x"), F.col(y) - F.col("__p.y")
    aggs = [
        F.count(F.lit(1)).alias("n_points"), F.coalesce(F.sum(F.sqrt(dx * dx + dy * dy)), F.lit(0.0)).alias("path_length_m"),
        F.min_by(pos, order).alias("__a"), F.max_by(pos, order).alias("__b"),
        *[F.first(c).alias(c) for c in carry or []],
    ]
    if with_path:
        aggs.append(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("__path"))
    g = seen.groupBy(*keys).agg(*aggs)
    net = F.sqrt((F.col("__b.x") - F.col("__a.x")) ** 2 + (F.col("__b.y") - F.col("__a.y")) ** 2)
    out = g.select(
        *keys, *(carry or []), "n_points",
        *([F.transform("__path", lambda p: p["x"]).alias("path_x"), F.transform("__path", lambda p: p["y"]).alias("path_y")] if with_path else []),
        F.col("__a.x").alias("start_x"), F.col("__a.y").alias("start_y"), F.col("__b.x").alias("end_x"), F.col("__b.y").alias("end_y"),
        "path_length_m", net.alias("net_displacement_m"),
    )
    return out.withColumn("straightness", ratio("net_displacement_m", "path_length_m"))


def occupancy(phase_frames: DataFrame, keepers: DataFrame, players_per_side: int = 10, block: int = 2048) -> DataFrame:
    """Occupied cells of both sides per phase, on cells of about one metre, of
    the ``players_per_side`` players of each side with most valid frames, ties
    by id as text.

    ``phase_frames`` holds one row per phase and frame, with the player arrays
    and pitch size; ``keepers`` the goalkeeper id per match and side.

    Frames are dealt by phase over as many tasks as their number asks for, and
    a task does the rest of its phases without another exchange. Phases with
    over a thousandth of the frames (and over ``block`` of them) are counted
    per cell before they are dealt.
    """
    keeper = keepers.groupBy("match_id").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("pid"))).alias(f"__{s}_keepers") for s in ("home", "away")])
    sized = [F.col(c).cast("double").alias(c) for c in ("pitch_length", "pitch_width")]
    packed = materialize(phase_frames.join(keeper, "match_id", "left").select(
        *PHASE_KEYS, *PHASE_INFO, *sized, "__home_keepers", "__away_keepers",
        F.concat(F.array_repeat(F.lit("home"), F.size("home")), F.array_repeat(F.lit("away"), F.size("away"))).alias("side"),
        *[F.concat(f"home.{c}", f"away.{c}").alias(c) for c in ("pid", "x", "y")]))
    total = packed.count()
    # fewer than a thousand phases, so their table may be broadcast
    hot = F.broadcast(packed.groupBy(*PHASE_KEYS).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > block) & (F.col("n") * 1000 > total)).select(*PHASE_KEYS))
    n_tasks = max(int(phase_frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_FRAMES))
    whole = packed.join(hot, PHASE_KEYS, "left_anti").repartition(n_tasks, *PHASE_KEYS)
    return _occupied(whole, players_per_side).unionByName(_occupied(packed.join(hot, PHASE_KEYS, "left_semi"), players_per_side))


def _occupied(packed: DataFrame, players_per_side: int) -> DataFrame:
    home = F.col("side") == "home"
    opened = packed.select(
        *PHASE_KEYS, "pitch_length", "pitch_width", "__home_keepers", "__away_keepers", F.explode(F.arrays_zip("side", "pid", "x", "y")).alias("p"),
    ).select(*PHASE_KEYS, "pitch_length", "pitch_width", "__home_keepers", "__away_keepers", "p.*")
    is_keeper = F.array_contains(F.when(home, F.col("__home_keepers")).otherwise(F.col("__away_keepers")), F.col("pid"))
    # players without a position have no cell, but count as seen
    seen = F.col("x").isNotNull() & F.col("y").isNotNull()
    cells = opened.filter(~F.coalesce(is_keeper, F.lit(False))).groupBy(
        *PHASE_KEYS, "side", "pid",
        F.when(seen, edge_bin("y", F.col("pitch_width"), metre_cells("pitch_width"))).alias("row"),
        F.when(seen, edge_bin("x", F.col("pitch_length"), metre_cells("pitch_length"))).alias("col"),
    ).agg(F.count(F.lit(1)).alias("n"))
    valid = F.sum("n").over(Window.partitionBy(*PHASE_KEYS, "side", "pid"))
    rank = F.dense_rank().over(Window.partitionBy(*PHASE_KEYS, "side").orderBy(F.desc("n_valid"), "pid"))
    chosen = cells.withColumn("n_valid", valid).withColumn("rank", rank).filter(F.col("rank") <= players_per_side)
    counts = chosen.groupBy(*PHASE_KEYS, "side", "row", "col").agg(F.sum("n").alias("recurrence_count"), F.max("rank").alias("rank"))
    phase = Window.partitionBy(*PHASE_KEYS)
    counts = counts.withColumns({
        "valid_player_frame_count": F.sum("recurrence_count").over(phase),
        "__home": F.sum(F.when(home, F.col("recurrence_count")).otherwise(0)).over(phase),
        "n_home_outfielders": F.max(F.when(home, F.col("rank")).otherwise(0)).over(phase),
        "n_away_outfielders": F.max(F.when(home, 0).otherwise(F.col("rank"))).over(phase),
    }).filter(F.col("row").isNotNull())
    info = packed.groupBy(*PHASE_KEYS).agg(*[F.first(c).alias(c) for c in PHASE_INFO], F.count(F.lit(1)).alias("frame_count"))
    j = counts.join(info, PHASE_KEYS)
    side_total = F.when(home, F.col("__home")).otherwise(F.col("valid_player_frame_count") - F.col("__home"))
    return j.select(
        *PHASE_KEYS, "sequence_id", "team", "side", "period", "row", "col", "frame_count",
        "n_home_outfielders", "n_away_outfielders",
        (F.col("n_home_outfielders") + F.col("n_away_outfielders")).alias("n_outfielders"),
        F.when(home, F.col("n_home_outfielders")).otherwise(F.col("n_away_outfielders")).alias("n_side_outfielders"),
        "valid_player_frame_count", side_total.alias("side_valid_player_frame_count"), "recurrence_count",
        (F.col("recurrence_count") / side_total).alias("recurrence_frac"),
        (F.col("recurrence_count") / F.col("valid_player_frame_count")).alias("recurrence_frac_combined"),
    )


def ball_occupancy(phase_frames: DataFrame) -> DataFrame:
    """Cells the ball passed through per phase."""
    sized = phase_frames.withColumns({"__nc": metre_cells("pitch_length"), "__nr": metre_cells("pitch_width")})
    cells = grids.histogram2d(sized, PHASE_KEYS, "ball_x", "ball_y", F.col("pitch_length"), F.col("pitch_width"),
                              F.col("__nc"), F.col("__nr"), count="recurrence_count")
    info = phase_frames.groupBy(*PHASE_KEYS).agg(
        *[F.first(c).alias(c) for c in PHASE_INFO], F.count(F.lit(1)).alias("frame_count"),
        F.count(F.when(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull(), 1)).alias("valid_ball_frame_count"),
    )
    return cells.join(info, PHASE_KEYS).select(
        *PHASE_KEYS, *PHASE_INFO, "row", "col", "frame_count", "valid_ball_frame_count", "recurrence_count",
        (F.col("recurrence_count") / F.col("valid_ball_frame_count")).alias("recurrence_frac"),
    )


def ball_paths(phase_frames: DataFrame, width: float = 4096.0) -> DataFrame:
    """Ordered ball path and its summary per phase."""
    points = phase_frames.select(*PHASE_KEYS, *PHASE_INFO, "frame_idx", "ball_x", "ball_y")
    return path_summary(points, PHASE_KEYS, "frame_idx", "ball_x", "ball_y", width, with_path=True, carry=PHASE_INFO)


def phase_control(phase_frames: DataFrame, stride: int, min_players: int, width: float = 4096.0) -> DataFrame:
    """Share of sampled frames in which the side in possession controls each
    cell; cells it never controls are left out."""
    numbered = ordered(phase_frames, PHASE_KEYS, ["frame_idx"], width, index="__pos")
    sampled = numbered.filter(F.col("__pos") % stride == 0)
    info = phase_frames.groupBy(*PHASE_KEYS).agg(
        *[F.first(c).alias(c) for c in PHASE_INFO], F.count(F.lit(1)).alias("frame_count"),
        metre_cells(F.first("pitch_length")).alias("__nc"),
    )
    # frames meet their phase, since their maps are far larger than they are
    told = sampled.drop(*PHASE_INFO).join(info, PHASE_KEYS)
    j = open_totals(control_arrays(told, [*PHASE_KEYS, *PHASE_INFO, "frame_count", "__nc"], "centres", min_players))
    own = F.when(F.col("team") == "home", F.col("home_frames")).otherwise(F.col("frames") - F.col("home_frames"))
    return j.filter(own > 0).select(
        *PHASE_KEYS, *PHASE_INFO, F.floor(F.col("cell") / F.col("__nc")).cast("int").alias("row"),
        (F.col("cell") % F.col("__nc")).alias("col"), "frame_count",
        F.col("frames").alias("valid_pitch_control_frame_count"), (own / F.col("frames")).alias("pitch_control_frac"),
    )


def dense_map(cells: DataFrame, value: str, n_rows: int, n_cols: int, match_id=None, window_id=None, side=None) -> DataFrame:
    """Dense arrays of stored maps, optionally of one phase or one side."""
    for name, wanted in (("match_id", match_id), ("window_id", window_id), ("side", side)):
        if wanted is not None:
            cells = cells.filter(F.col(name).cast("string") == str(wanted))
    keys = PHASE_KEYS + (["side"] if side is not None else [])
    return grids.densify(cells, keys, value, n_rows, n_cols)


def sum_violations(cells: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Maps whose cells do not add up to one."""
    s = cells.groupBy(*keys).agg(F.sum(value).alias("total"))
    return s.filter((F.col("total") != 0) & (F.abs(F.col("total") - 1.0) > tolerance + 1e-5))


def range_violations(cells: DataFrame, value: str, tolerance: float = 1e-6) -> DataFrame:
    """Cells outside [0, 1]."""
    return cells.filter((F.col(value) < -tolerance) | (F.col(value) > 1 + tolerance))


def home_attack_direction(sides: DataFrame, rows: Column | None = None) -> DataFrame:
    """Detected direction of the home side per match and period.

    ``sides`` has one row per phase with ``team`` and ``mid_x``, the mean x of
    play. Play drifts towards the goal the side in possession attacks, so the
    sign of the gap between home and away phases tells the direction; without
    evidence the first period counts as rightwards.
    """
    g = sides.groupBy("match_id", "period").agg(
        (F.avg(F.when(F.col("team") == "home", F.col("mid_x"))) - F.avg(F.when(F.col("team") == "away", F.col("mid_x")))).alias("margin")
    )
    fallback = F.when(F.col("period") == 1, 1).otherwise(-1)
    known = F.col("margin").isNotNull() & (F.col("margin") != 0)
    return g.select("match_id", "period", "margin", F.when(known, F.signum("margin").cast("int")).otherwise(fallback).alias("home_dir"),
                    known.alias("detected"))


def attack_oriented(cells: DataFrame, value: str, n_rows, n_cols, length: float) -> DataFrame:
    """Turn every phase map so that the side in possession attacks right, and
    name its sides ``in`` and ``out`` of possession. Adds ``attack_dir``."""
    centre = grids.centroid_x(cells, PHASE_KEYS + ["team", "period", "side"], value, n_cols, length, "cx")
    sides = centre.groupBy(*PHASE_KEYS, "team", "period").agg(
        (0.5 * (F.max(F.when(F.col("side") == "home", F.col("cx"))) + F.max(F.when(F.col("side") == "away", F.col("cx"))))).alias("mid_x")
    )
    direction = home_attack_direction(sides).select("match_id", "period", "home_dir")
    j = cells.join(direction, ["match_id", "period"])
    attack = F.when(F.col("team") == "home", F.col("home_dir")).otherwise(-F.col("home_dir"))
    turned = grids.rotate(j.withColumn("attack_dir", attack).drop("home_dir"), F.col("attack_dir") == -1, n_rows, n_cols)
    return turned.withColumn("block", F.when(F.col("team") == F.col("side"), "in").otherwise("out"))
