"""Output of the produced tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

from playframe.functions import taxonomy


FILES_PER_MATCH = 4


def output_name(base: str, num_matches: int | None, default: int = 64) -> str:
    """Base name, with the number of matches before the suffix when it is not
    the default."""
    if num_matches in (None, default):
        return base
    stem, dot, suffix = base.rpartition(".")
    return f"{stem}_{num_matches}{dot}{suffix}" if dot else f"{base}_{num_matches}"


def write_table(df: DataFrame, path: str, partition_by: str | None = "match_id", mode: str = "overwrite") -> None:
    """Parquet, one folder per match when there is a match column. Rows of a
    match are brought together first, in ``FILES_PER_MATCH`` parts at most, so
    files do not multiply with the tasks."""
    if partition_by in df.columns:
        plain = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct"))]
        part = F.pmod(F.xxhash64(*plain), F.lit(FILES_PER_MATCH))
        df = df.withColumn("__part", part).repartition(partition_by, "__part").drop("__part")
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by in df.columns else w).parquet(path)


def write_with_maps(df: DataFrame, path: str, column: str = "pc_map", size: int = 3375, mode: str = "overwrite") -> None:
    """Parquet with a map column of one fixed length; maps of another length
    become maps of missing values."""
    missing = F.array_repeat(F.lit(float("nan")).cast("float"), size)
    fixed = F.when(F.size(column) == size, F.col(column).cast("array<float>")).otherwise(missing)
    write_table(df.withColumn(column, fixed), path, mode=mode)


def write_summary(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, for small summaries."""
    df.write.mode(mode).option("header", True).csv(path)


def write_document(path: str, config: dict, tables: dict[str, DataFrame]) -> None:
    """JSON document of settings and small result tables."""
    doc = {"config": config, **{k: [r.asDict(recursive=True) for r in t.collect()] for k, t in tables.items()}}
    Path(path).write_text(json.dumps(doc, indent=2))


def feature_group_table(spark, columns: list[str], with_ball: bool = False) -> DataFrame:
    """Feature names per group."""
    rows = [(c, taxonomy.group_of(c, with_ball)) for c in columns]
    tagged = spark.createDataFrame(rows, "feature string, group string")
    return tagged.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("feature")).alias("features")).orderBy("group")


def reuse_or_build(spark, path: str, build, recompute: bool = False) -> DataFrame:
    """Read a table written before, else build and write it."""
    from pyspark.errors import AnalysisException

    if not recompute:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    write_table(build(), path)
    return spark.read.parquet(path)
