"""Key joins of the analysis stage that must not change the row count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def means_by_key(df: DataFrame, keys: list[str], columns: list[str], prefix: str) -> DataFrame:
    """Mean of every column per key, with prefixed names."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(prefix + c) for c in columns])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, from the schema alone."""
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in kinds and f.name not in exclude]


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a left join on them adds rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def merge_phase_features(phases: DataFrame, movement: DataFrame, windows: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Phases with movement means, formation-window means and map scores. The
    first two right sides are grouped by the join keys, so they are unique."""
    skip = ("sequence_id", "game_event_id", "possession_event_id", "period")
    touch = means_by_key(movement, ["match_id", "sequence_id", "team"], numeric_columns(movement, skip), "touch_")
    shape = means_by_key(windows, ["match_id", "team", "period"],
                         ["avgCostPerPlayer", "confidence", "mean_compactness", "mean_width", "mean_depth"], "formwin_")
    out = phases.join(touch, ["match_id", "sequence_id", "team"], "left").join(shape, ["match_id", "team", "period"], "left")
    if scores is not None:
        keys = ["match_id", "window_id", "team", "period"]
        if not repeated_keys(scores, keys).isEmpty():
            raise ValueError("map scores repeat a phase key")
        pcs = [c for c in scores.columns if c.startswith("PC")]
        out = out.join(scores.select(*keys, *pcs), keys, "left")
    return out
