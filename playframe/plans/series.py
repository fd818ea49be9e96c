"""Per-frame value series and the statistics of a possession over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playframe.config import EngineConfig
from playframe.functions.frames import disk_offsets
from playframe.functions.gridding import surface_lookup
from playframe.operators.ranges import points_in_intervals


def obso(frames: DataFrame, surface: list[list[float]], radius: float, ball=("ball_x", "ball_y"),
         direction: str = "direction", length="pitch_length", width="pitch_width", out: str = "obso") -> DataFrame:
    """Best value within a radius of the ball. Probe points off the pitch are
    dropped, the ball's own cell always counts. The probes are a literal array,
    so the frame stays one row."""
    bx, by, pl, pw = F.col(ball[0]), F.col(ball[1]), F.col(length), F.col(width)
    probes = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disk_offsets(radius)])

    def value(o):
        x, y = bx + o["dx"], by + o["dy"]
        return F.when(x.between(0, pl) & y.between(0, pw), surface_lookup(surface, x, y, pl, pw, direction))

    around = F.array_max(F.transform(probes, value))
    here = surface_lookup(surface, bx, by, pl, pw, direction)
    return frames.filter(bx.isNotNull() & by.isNotNull()).withColumn(out, F.greatest(around, here))


def signed_values(frames: DataFrame, surface: list[list[float]], name: str, owner: str = "team",
                  direction: str = "direction", ball=("ball_x", "ball_y"), length="pitch_length", width="pitch_width") -> DataFrame:
    """Surface value at the ball of owned frames, and the same with the sign of
    the owner (home plus, away minus)."""
    bx, by = F.col(ball[0]), F.col(ball[1])
    v = surface_lookup(surface, bx, by, F.col(length), F.col(width), direction)
    owned = frames.filter(bx.isNotNull() & by.isNotNull() & F.col(owner).isNotNull())
    return owned.withColumn(name, v).withColumn(f"signed_{name}", F.when(F.col(owner) == "home", F.col(name)).otherwise(-F.col(name)))


def mean_per_second(series: DataFrame, value: str, keys: list[str], out: str = "meanSignedEPV") -> DataFrame:
    """Mean of a series per period and whole second."""
    return series.groupBy(*keys, "period", F.floor("elapsed").alias("secondIntoPeriod")).agg(F.avg(value).alias(out))


def possession_peaks(possessions: DataFrame, series: DataFrame, keys: list[str], moment: str, start: str, end: str,
                     value: str, threshold: float, min_duration: float, width: float, ids: list[str]) -> DataFrame:
    """Peak of the signed series over each possession, from the view of its
    side; zero when the series has no rows there. Short possessions drop out."""
    long = possessions.filter(F.col("duration") >= min_duration)
    spans = long.select(*keys, *ids, F.col("team").alias("__team"), start, end)
    held = points_in_intervals(series.select(*keys, moment, value), spans, keys, moment, start, end, width)
    own = F.when(F.col("__team") == "home", F.col(value)).otherwise(-F.col(value))
    peak = held.groupBy(*keys, *ids).agg(F.max(own).alias("__peak"))
    out = long.join(peak, keys + ids, "left").withColumn("peak_value", F.coalesce("__peak", F.lit(0.0))).drop("__peak")
    return out.withColumn("is_das", F.col("peak_value") >= threshold)


def obso_series(frames: DataFrame, surface: list[list[float]], cfg: EngineConfig) -> DataFrame:
    """OBSO of every sampled owned frame."""
    sampled = frames.filter((F.col("frame_idx") % cfg.obso_stride == 0) & F.col("team").isNotNull())
    return obso(sampled, surface, cfg.obso_radius)
