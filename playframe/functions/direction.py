"""Attack direction and pitch orientation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playframe.functions.nulls import col


def home_left(period: Column | str, start_left: Column | str, start_left_extra: Column | str) -> Column:
    """Start-side flag that applies to the period."""
    base = F.coalesce(col(start_left), F.lit(True))
    return F.when(col(period).isin(3, 4), F.coalesce(col(start_left_extra), base)).otherwise(base)


def attack_direction(team: Column | str, period: Column | str, start_left: Column | str,
                     start_left_extra: Column | str) -> Column:
    """+1 when the team attacks towards larger x, else -1."""
    p = col(period)
    towards_right = (
        home_left(p, start_left, start_left_extra) == (F.pmod(p, F.lit(2)) == 1)
    ) == (col(team) == "home")
    return F.when(towards_right, F.lit(1)).otherwise(F.lit(-1))


def orientation(direction: Column | str) -> Column:
    """Template orientation for a direction."""
    return F.when(col(direction) > 0, F.lit("normal")).otherwise(F.lit("flipped"))


def relative_x(x: Column | str, direction: Column | str, length: Column | float) -> Column:
    """x as seen by a team that always attacks towards larger x."""
    length = F.lit(length) if isinstance(length, (int, float)) else length
    return F.when(col(direction) < 0, length - col(x)).otherwise(col(x))
