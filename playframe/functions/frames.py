"""Per-frame geometry as column expressions.

A frame holds its players as two arrays of structs (rank, pid, x, y, reliable),
in rank order and without missing positions. A roster bounds the arrays, so
everything here is a narrow projection: no explode, no join, no shuffle. The
measures over all pairs of players are made by ``operators.kernels``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playframe.functions.nulls import col, ratio

# fixed values: names of output columns
INTERACTION_FIELDS = (
    "centroid_distance", "longitudinal_centroid_difference", "lateral_centroid_difference",
    "width_difference", "width_ratio", "depth_difference", "depth_ratio",
    "compactness_difference", "compactness_ratio", "area_difference", "area_ratio",
    "nearest_opponent_distance",
)
EPS = 1e-6


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression that uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distance(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def interactions(attack: Column, defence: Column, opponent: Column) -> Column:
    """Twelve attacker-defender measures from two shape structs that also carry
    ``area``, and from the distance to the closest opponent."""
    def compare(s: Column) -> Column:
        a, d = s["a"], s["d"]
        out = [
            distance(a["centroid_x"], a["centroid_y"], d["centroid_x"], d["centroid_y"]).alias("centroid_distance"),
            (a["centroid_x"] - d["centroid_x"]).alias("longitudinal_centroid_difference"),
            (a["centroid_y"] - d["centroid_y"]).alias("lateral_centroid_difference"),
        ]
        for name in ("width", "depth", "compactness", "area"):
            out += [(a[name] - d[name]).alias(f"{name}_difference"), ratio(a[name], d[name], EPS).alias(f"{name}_ratio")]
        return F.struct(*out, s["opp"].alias("nearest_opponent_distance"))

    return let(F.struct(attack.alias("a"), defence.alias("d"), opponent.alias("opp")), compare)


def closest(players: Column | str, x: Column, y: Column) -> Column:
    """Closest player as (d, rank, pid); the lowest rank wins ties."""
    p = col(players)
    return F.array_min(F.transform(
        p, lambda q: F.struct(distance(q["x"], q["y"], x, y).alias("d"), q["rank"].alias("rank"), q["pid"].alias("pid"))
    ))


def ball_owner(home: Column | str, away: Column | str, x: Column, y: Column, threshold: float) -> Column:
    """Side whose closest player is nearer to the ball than the threshold;
    home wins ties."""
    def pick(s: Column) -> Column:
        h, a = s["h"], s["a"]
        return F.when((h < threshold) & ~F.coalesce(a < h, F.lit(False)), "home").when(a < threshold, "away")

    return let(F.struct(closest(home, x, y)["d"].alias("h"), closest(away, x, y)["d"].alias("a")), pick)


def disk_offsets(radius: float, step: float = 1.0) -> list[tuple[float, float]]:
    """Lattice offsets inside a disk."""
    k = int(radius / step)
    line = [i * step for i in range(-k, k + 1)]
    return [(dx, dy) for dx in line for dy in line if dx * dx + dy * dy <= radius * radius]
