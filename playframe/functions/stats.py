"""Aggregate factories. They return column lists for one ``groupBy().agg``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playframe.functions.nulls import col

SUFFIXES = ("mean", "std", "min", "max", "range", "start", "end", "change")


def series_stats(name: str, value: Column | str, order: Column | str,
                 weight: Column | str | None = None) -> list[Column]:
    """Eight statistics of a null-skipping ordered series.

    The mean and the population deviation take weights when given; they fall
    back to the plain ones when no positive weight is present.
    """
    v, o = col(value).cast("double"), col(order)
    key = F.when(v.isNotNull(), o)
    lo, hi = F.min(v), F.max(v)
    first, last = F.min_by(v, key), F.max_by(v, key)
    mean, std = F.avg(v), F.stddev_pop(v)
    if weight is not None:
        mean, std = weighted_mean_std(v, weight)
    return [
        mean.alias(f"{name}_mean"), std.alias(f"{name}_std"),
        lo.alias(f"{name}_min"), hi.alias(f"{name}_max"), (hi - lo).alias(f"{name}_range"),
        first.alias(f"{name}_start"), last.alias(f"{name}_end"),
        (last - first).alias(f"{name}_change"),
    ]


def weighted_mean_std(value: Column | str, weight: Column | str) -> tuple[Column, Column]:
    """Weighted mean and population deviation in one pass.

    They are put together from plain means and co-moments, which Spark merges
    about their means: so values far from zero keep their deviation, and the map
    side can combine. With m the plain mean, sum(w (v - m)) / n is covar(w, v) and
    sum(w (v - m)^2) / n is covar(w v, v) - m covar(w, v).
    """
    v = col(value).cast("double")
    w = col(weight)
    w = F.when(v.isNotNull(), F.when(~F.isnan(w) & (w > 0), w).otherwise(F.lit(0.0)))
    plain, share, shift = F.avg(v), F.avg(w), F.covar_pop(w, v)
    mean = plain + shift / share
    var = F.greatest((F.covar_pop(w * v, v) - plain * shift) / share - (shift / share) * (shift / share), F.lit(0.0))
    return (
        F.when(share > 0, mean).otherwise(plain),
        F.when(share > 0, F.sqrt(var)).otherwise(F.stddev_pop(v)),
    )


def majority_home(vote: Column | str, fallback: Column | str) -> Column:
    """Home or away by vote; ties go home; the second ballot counts only when
    the first is empty, and no ballot at all gives null."""
    v, f = col(vote), col(fallback)

    def side(b: Column) -> Column:
        return F.when(F.count_if(b) >= F.count_if(~b), F.lit("home")).otherwise(F.lit("away"))

    return F.when(F.count(v) > 0, side(v)).when(F.count(f) > 0, side(f))


def counts_as_json(entries: Column | str) -> Column:
    """Array of (key, n) structs to a JSON object, most frequent first; an
    empty array gives ``{}``."""
    e = col(entries)
    ordered = F.array_sort(
        F.transform(e, lambda s: F.struct((-s["n"]).alias("m"), s["k"].alias("k"), s["n"].alias("n")))
    )
    pairs = F.map_from_entries(F.transform(ordered, lambda s: F.struct(s["k"], s["n"])))
    return F.when(F.size(e) > 0, F.to_json(pairs)).otherwise(F.lit("{}"))
