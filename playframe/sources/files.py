"""Where the input files are: match folders, value grids, named tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MATCH_FILES = ("metadata.json", "tracking.jsonl.bz2", "events.json")


def match_of(path: Column | str) -> Column:
    """Folder name of a file, which is the match id."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def discover(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Ids of the match folders that hold all files, in order. The listing is
    Spark's own; file contents are not read."""
    files = spark.read.format("binaryFile").load(f"{folder}/*/*").select("path")
    named = files.select(match_of("path").alias("match_id"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    full = named.filter(F.col("name").isin(*MATCH_FILES)).groupBy("match_id").agg(F.count_distinct("name").alias("n"))
    ids = full.filter(F.col("n") == len(MATCH_FILES)).select("match_id").orderBy("match_id")
    return ids.limit(limit) if limit else ids


def read_grid(path: str) -> list[list[float]] | None:
    """Value surface from a CSV matrix without header, None when absent. It is
    a model parameter of a few hundred numbers and ends up as a literal."""
    if not Path(path).exists():
        return None
    return [[float(v) for v in line.split(",")] for line in Path(path).read_text().splitlines() if line.strip()]


def grid_table(spark: SparkSession, path: str) -> DataFrame:
    """The same matrix as (row, col, value) rows."""
    grid = read_grid(path)
    rows = [(i, j, v) for i, line in enumerate(grid or []) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def find_table(name: str, folder: str = ".", renamed: tuple[str, str] | None = None) -> str:
    """Path of a produced table: in the folder or its ``pca_output``, under its
    own name or with one beginning of the name in place of another."""
    names = [name]
    if renamed and name.startswith(renamed[0]):
        names.append(renamed[1] + name[len(renamed[0]):])
    for place in (Path(folder), Path(folder) / "pca_output"):
        for n in names:
            if (place / n).exists():
                return str(place / n)
    raise FileNotFoundError(f"{name} is not in {folder}")


def numbers_of(column: Column | str) -> Column:
    """List column stored as JSON text or as an array, as an array."""
    c = F.col(column) if isinstance(column, str) else column
    return F.from_json(c.cast("string"), "array<double>")


def upcast_half_maps(source: str, target: str, column: str = "pc_map") -> None:
    """Rewrite a file whose map column is half precision, which Spark cannot
    read, with single precision, one row group at a time."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    reader = pq.ParquetFile(source)
    writer = None
    for i in range(reader.num_row_groups):
        t = reader.read_row_group(i)
        at = t.schema.get_field_index(column)
        t = t.set_column(at, column, t.column(column).cast(pa.list_(pa.float32())))
        writer = writer or pq.ParquetWriter(target, t.schema, compression="zstd")
        writer.write_table(t)
    if writer:
        writer.close()
