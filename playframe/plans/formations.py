"""Formations: keepers, disruption weights, sliding windows, template match,
segments and the dominant formation of a possession or phase."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from playframe.config import FOUL_TYPES, EngineConfig
from playframe.operators.kernels import cheapest_assignment
from playframe.operators.ordered import islands, steps
from playframe.operators.ranges import best_overlap, points_in_intervals
from playframe.session import materialize

TASK_ROWS = 5_000  # rows matched by one task

# Shapes that make up the default template library: outfield line sizes from
# the own goal forwards. Coordinates follow from the rule in ``line_template``.
SHAPES = (
    "442", "433", "4231", "4141", "4321", "4222", "4312", "4411", "451", "41212",
    "42211", "343", "3421", "352", "3511", "3412", "3142", "3331", "532", "541",
    "523", "5221", "424", "4132", "1423", "1234", "1432", "1324", "2233", "2431",
    "235", "2323", "3223", "32221", "343flat", "3421flat", "3511flat",
)
NAMED_SHAPES = {"pyramid": "235", "metodo": "2323", "wm": "3223"}
NAMED_FAMILIES = {"pyramid": "back-2", "metodo": "back-3", "wm": "back-3"}


def line_template(shape: str, length: float, width: float) -> list[tuple[float, float]]:
    """Slots of a shape: lines evenly from 0.16 to 0.80 of the length, the
    players of a line evenly over the width. In a flat shape the outer players of
    the second line stand half-way back to the first."""
    sizes = [int(ch) for ch in shape.removesuffix("flat")]
    depth = np.linspace(0.16, 0.80, len(sizes))
    back = (depth[1] - depth[0]) / 2 if shape.endswith("flat") else 0.0
    return [((d - back * (k == 1 and i in (0, n - 1))) * length, width * (i + 1) / (n + 1))
            for k, (d, n) in enumerate(zip(depth, sizes)) for i in range(n)]


def default_templates(length: float = 1.0, width: float = 1.0) -> dict[str, list[tuple[float, float]]]:
    """Template name to ten slots; a library of one's own has the same form."""
    shapes = {s: s for s in SHAPES if s not in NAMED_SHAPES.values()} | NAMED_SHAPES
    return {name: line_template(s, length, width) for name, s in shapes.items()}


def read_templates(path: str) -> dict[str, list[tuple[float, float]]]:
    """Library from a CSV file with formation, x, y in unit pitch coordinates;
    only shapes with ten slots are kept."""
    table = pd.read_csv(path, dtype={"formation": str})
    slots = {name: list(zip(g.x, g.y)) for name, g in table.groupby("formation", sort=False)}
    return {name: s for name, s in slots.items() if len(s) == 10}


def match_templates(df: DataFrame, xs: str, ys: str, flipped: Column, length: str, width: str,
                    templates: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Cheapest template per row of averaged player positions.

    Adds ``formation`` and ``cost`` (mean distance per assigned player). All
    rows of a batch with the same number of players go together; templates whose
    lower bound is above a cost already found are not assigned. The first
    template wins ties.
    """
    names = list(templates)
    unit = np.array([templates[n] for n in names], dtype=float)           # (T, 10, 2)
    keep = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", formation string, cost double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            formation = np.full(len(pdf), None, dtype=object)
            cost = np.full(len(pdf), np.nan)
            counts = pdf[xs].map(len).to_numpy()
            for n in np.unique(counts):
                rows = np.flatnonzero(counts == n)
                if n == 0:
                    continue
                for start in range(0, len(rows), 256):
                    r = rows[start:start + 256]
                    pos = np.stack([np.stack(pdf[xs].iloc[r].to_numpy()), np.stack(pdf[ys].iloc[r].to_numpy())], axis=2)
                    size = np.column_stack([pdf[length].iloc[r], pdf[width].iloc[r]]).astype(float)
                    slots = unit[None] * size[:, None, None, :]
                    turn = pdf["__flip"].iloc[r].to_numpy(bool)
                    slots = np.where(turn[:, None, None, None], size[:, None, None, :] - slots, slots)
                    diff = pos[:, None, :, None, :] - slots[:, :, None, :, :]
                    d = np.sqrt((diff ** 2).sum(-1))                       # (rows, T, players, slots)
                    if d.shape[2] > d.shape[3]:
                        d = d.transpose(0, 1, 3, 2)
                    best, total = cheapest_assignment(d)
                    formation[r] = np.array(names, dtype=object)[best]
                    cost[r] = total / d.shape[2]
            yield pdf[keep].assign(formation=formation, cost=cost)

    # rows cost far more time than bytes, so their number tells the partitions
    held = materialize(df.withColumn("__flip", flipped))
    n_tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // TASK_ROWS))
    return held.repartition(n_tasks).mapInPandas(run, schema)


def variant(formation: Column | str) -> Column:
    f = F.col(formation) if isinstance(formation, str) else formation
    return F.regexp_replace(f, "flat$", "")


def family(formation: Column | str) -> Column:
    v = variant(formation)
    out = F.when(v.rlike("^[0-9]"), F.concat(F.lit("back-"), F.substring(v, 1, 1))).otherwise(F.lit("other"))
    for name, value in NAMED_FAMILIES.items():
        out = F.when(v == name, value).otherwise(out)
    return F.when(v.isNotNull(), out).otherwise(F.lit("other"))


def sliding_windows(seconds: Column | str, stride: int, length: int) -> Column:
    """Indices of the windows that hold a moment, closed at both ends."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    last = F.floor(s / F.lit(float(stride)))
    first = F.greatest(F.ceil((s - F.lit(float(length))) / F.lit(float(stride))), F.lit(0))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def player_rows(frames: DataFrame, carry: list[str]) -> DataFrame:
    """Player arrays to rows; the number per frame is bounded by the roster."""
    def tag(side: str) -> Column:
        return F.transform(side, lambda p: F.struct(F.lit(side).alias("side"), p["pid"].alias("pid"), p["rank"].alias("rank"),
                                                    p["x"].alias("x"), p["y"].alias("y"), p["reliable"].alias("reliable")))

    return frames.select(*carry, F.explode(F.concat(tag("home"), tag("away"))).alias("p")).select(*carry, "p.*")


def keepers(frames: DataFrame, meta: DataFrame, min_frames: int, block_frames: float) -> DataFrame:
    """Goalkeeper per match and side: from metadata, else the player who moves
    least per tracked frame, first among those seen in ``min_frames`` frames,
    else among all."""
    rows = player_rows(frames, ["match_id", "frame_idx"])
    moved = steps(rows, ["match_id", "side", "pid"], ["frame_idx"], "x", "y", block_frames)
    per = moved.groupBy("match_id", "side", "pid").agg(
        F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("d"))
    per = per.withColumn("enough", F.when(F.col("n") >= min_frames, 0).otherwise(1))
    quiet = per.groupBy("match_id", "side").agg(
        F.min_by("pid", F.struct(F.col("enough"), F.col("d") / F.col("n"), F.col("rank"))).alias("__quiet"))
    named = meta.select("match_id", F.explode(F.array(
        F.struct(F.lit("home").alias("side"), F.col("home_keeper").alias("__named")),
        F.struct(F.lit("away").alias("side"), F.col("away_keeper").alias("__named")))).alias("s")).select("match_id", "s.*")
    both = named.join(quiet, ["match_id", "side"], "left")
    return both.select("match_id", "side", F.coalesce("__named", "__quiet").alias("pid")).filter(F.col("pid").isNotNull())


def disruptions(located: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Fouls and substitutions as intervals over which a side's weight recovers
    from zero to one. ``located`` has the event's period and second."""
    kind = F.col("game_event_type")
    seconds = F.when(kind.isin(*FOUL_TYPES), cfg.foul_decay_seconds).when(kind == "SUB", cfg.sub_decay_seconds)
    side = F.when(F.coalesce("home_team", F.lit(False)), "home").otherwise("away")
    out = located.filter(F.col("second").isNotNull()).select(
        "match_id", "period", "ordinal", F.col("second").alias("from_sec"), (F.col("second") + seconds).alias("to_sec"), side.alias("side"))
    return out.filter(F.col("to_sec").isNotNull())


def ramp(moment: Column, start: Column, end: Column, base: float = 0.0) -> Column:
    """Linear recovery from ``base`` at the start to one at the end."""
    part = F.greatest(F.least((moment - start) / (end - start), F.lit(1.0)), F.lit(0.0))
    return F.lit(base) + F.lit(1.0 - base) * part


def product(values: Column | str) -> Column:
    """Product as an aggregate; zero if any factor is zero."""
    v = F.col(values) if isinstance(values, str) else values
    logs = F.sum(F.when(v > 0, F.ln(v)))
    return F.when(F.min(v) <= 0, F.lit(0.0)).otherwise(F.exp(logs))


def frame_weights(frames: DataFrame, breaks: DataFrame, width: float) -> DataFrame:
    """Weight per frame and side: the product of the ramps that cover the
    frame; frames without a disruption are absent and count as one."""
    spans = breaks.select("match_id", "period", "side", "from_sec", "to_sec")
    held = points_in_intervals(frames.select("match_id", "period", "frame_idx", "elapsed"), spans,
                               ["match_id", "period"], "elapsed", "from_sec", "to_sec", width)
    w = ramp(F.col("elapsed"), F.col("from_sec"), F.col("to_sec"))
    return held.groupBy("match_id", "frame_idx", "side").agg(product(w).alias("weight"))


def average_positions(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weighted mean position per key and player, then one row per key with the
    players as arrays in rank order; players without weight drop out."""
    w = F.col(weight)
    per = rows.groupBy(*keys, "pid").agg(
        F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"),
        F.sum(F.col("x") * w).alias("sx"), F.sum(F.col("y") * w).alias("sy"))
    item = F.when(F.col("sw") > 0, F.struct("rank", (F.col("sx") / F.col("sw")).alias("x"), (F.col("sy") / F.col("sw")).alias("y")))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("n_observations"), F.sum(F.when(F.col("sw") > 0, F.col("sw"))).alias("weight_sum"),
        F.array_sort(F.collect_list(item)).alias("players"))


def formation_windows(frames: DataFrame, keeper: DataFrame, weights: DataFrame, meta: DataFrame, cfg: EngineConfig,
                      templates: dict | None = None) -> DataFrame:
    """Formation per side, period and sliding window."""
    sampled = frames.filter(F.col("frame_idx") % cfg.formation_frame_stride == 0)
    rows = player_rows(sampled, ["match_id", "period", "frame_idx", "elapsed"])
    rows = rows.join(keeper.withColumnRenamed("pid", "__keeper"), ["match_id", "side"], "left")
    rows = rows.filter(~F.coalesce(F.col("pid") == F.col("__keeper"), F.lit(False))).drop("__keeper")
    rows = rows.join(weights, ["match_id", "frame_idx", "side"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = rows.withColumn("k", F.explode(sliding_windows("elapsed", cfg.window_stride, cfg.window_seconds)))
    keys = ["match_id", "side", "period", "k"]
    avg = average_positions(rows, keys, "weight").filter(
        (F.col("n_observations") >= cfg.window_min_observations) & (F.size("players") >= max(1, cfg.min_outfielders)))
    avg = _with_pitch(avg, meta)
    fitted = match_templates(avg, "xs", "ys", F.col("direction") < 0, "pitch_length", "pitch_width", templates or default_templates())
    fit = 1.0 / (1.0 + F.col("cost"))
    confidence = F.col("weight_sum") * fit
    start = F.col("k") * cfg.window_stride
    n = F.size("xs")
    mx = F.aggregate("xs", F.lit(0.0), lambda a, v: a + v) / n
    my = F.aggregate("ys", F.lit(0.0), lambda a, v: a + v) / n
    shaped = fitted.withColumns({"__mx": mx, "__my": my})
    spread = F.aggregate(F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")), F.lit(0.0),
                         lambda a, p: a + F.sqrt((p["x"] - F.col("__mx")) ** 2 + (p["y"] - F.col("__my")) ** 2)) / n
    return shaped.filter(confidence >= cfg.min_window_confidence).select(
        "match_id", F.col("side").alias("team"), "period", F.col("k").alias("windowIndex"), start.alias("windowStartSec"),
        (start + cfg.window_seconds).alias("windowEndSec"), n.alias("nOutfieldPlayers"), F.col("n_observations").alias("nFrames"),
        "formation", F.when(F.col("direction") > 0, "normal").otherwise("flipped").alias("orientation"),
        F.bround("cost", 3).alias("avgCostPerPlayer"), F.bround(confidence, 4).alias("confidence"),
        spread.alias("mean_compactness"), (F.array_max("ys") - F.array_min("ys")).alias("mean_width"),
        (F.array_max("xs") - F.array_min("xs")).alias("mean_depth"))


def _with_pitch(avg: DataFrame, meta: DataFrame, team: str = "side") -> DataFrame:
    from playframe.functions.direction import attack_direction

    m = meta.select("match_id", "pitch_length", "pitch_width", "start_left", "start_left_extra")
    direction = attack_direction(F.col(team), F.col("period"), F.col("start_left"), F.col("start_left_extra"))
    return avg.join(m, "match_id").withColumns({
        "direction": direction, "xs": F.transform("players", lambda p: p["x"]), "ys": F.transform("players", lambda p: p["y"]),
    }).drop("players", "start_left", "start_left_extra")


def phase_formations(phase_frames: DataFrame, keeper: DataFrame, meta: DataFrame, cfg: EngineConfig,
                     keys: list[str], templates: dict | None = None) -> DataFrame:
    """Formation of the side in possession over the frames of a phase."""
    rows = player_rows(phase_frames, keys + ["team", "period"]).filter(F.col("side") == F.col("team"))
    rows = rows.join(keeper.withColumnRenamed("pid", "__keeper"), ["match_id", "side"], "left")
    rows = rows.filter(~F.coalesce(F.col("pid") == F.col("__keeper"), F.lit(False))).drop("__keeper")
    group = keys + ["team", "period"]
    per = rows.groupBy(*group, "pid").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    avg = per.filter(F.col("n") >= cfg.phase_player_min_frames).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("rank", "x", "y"))).alias("players")).filter(F.size("players") >= cfg.min_outfielders)
    fitted = match_templates(_with_pitch(avg, meta, "team"), "xs", "ys", F.col("direction") < 0, "pitch_length", "pitch_width",
                             templates or default_templates())
    return fitted.select(*keys, F.col("formation").alias("dominant_formation"), variant("formation").alias("formation_variant"),
                         family("formation").alias("formation_family"), (1.0 / (1.0 + F.col("cost"))).alias("formation_confidence"))


def formation_segments(windows: DataFrame) -> DataFrame:
    """Runs of equal formations per side and period, with the mean confidence
    of the windows inside a run. Time gaps do not end a run."""
    keys = ["match_id", "team", "period"]
    labelled = windows.withColumns({"formation": F.trim(F.col("formation").cast("string")),
                                    "windowStartSec": F.col("windowStartSec").cast("double")})
    runs = islands(labelled, keys, ["windowStartSec"], "formation", 3600.0)
    seg = runs.groupBy(*keys, "island").agg(
        F.first("formation").alias("formation"), F.min("windowStartSec").alias("__s"),
        F.max_by("windowEndSec", "windowStartSec").cast("double").alias("__e"))
    inside = points_in_intervals(
        labelled.select(*keys, "windowStartSec", "windowEndSec", "confidence"), seg.select(*keys, "island", "__s", "__e"),
        keys, "windowStartSec", "__s", "__e", 3600.0).filter(F.col("windowEndSec") <= F.col("__e"))
    mean = inside.groupBy(*keys, "island").agg(F.avg("confidence").alias("mean_confidence"))
    return seg.join(mean, keys + ["island"], "left").select(
        *keys, "formation", variant("formation").alias("variant"), family("formation").alias("family"),
        F.bround("__s", 2).alias("start_sec"), F.bround("__e", 2).alias("end_sec"),
        F.bround(F.col("__e") - F.col("__s"), 2).alias("duration"), "mean_confidence")


def attach_formation(rows: DataFrame, segments: DataFrame, row_id: list[str]) -> DataFrame:
    """Formation of the segment that overlaps a possession most."""
    keys = ["match_id", "team", "period"]
    s = segments.select(*keys, F.col("start_sec").alias("__s"), F.col("end_sec").alias("__e"),
                        F.col("formation").alias("dominant_formation"), F.col("variant").alias("formation_variant"),
                        F.col("family").alias("formation_family"), F.col("mean_confidence").alias("formation_confidence"))
    carry = ["dominant_formation", "formation_variant", "formation_family", "formation_confidence"]
    ids = [c for c in row_id if c not in keys]
    best = best_overlap(rows, s, keys, ("start_sec_period", "end_sec_period"), ("__s", "__e"), ids, carry, 600.0)
    return rows.join(best.drop("overlap"), keys + ids, "left")
