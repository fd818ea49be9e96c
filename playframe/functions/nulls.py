"""Missing-value helpers: only null stands for "missing" inside the engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and the infinities become null."""
    v = col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(INF)), v)


def ratio(num: Column | str, den: Column | str, eps: float = 0.0) -> Column:
    """num / den, null unless den > eps."""
    d = col(den)
    return F.when(d > F.lit(eps), col(num) / d)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)

