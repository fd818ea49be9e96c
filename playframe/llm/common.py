"""Helpers the operators share: shared scratch tables and input shaping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space, the separators of words
SPACES = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Only a local
    session without that setting, as in tests, gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written once under the shared folder and read back, so that a
    lost executor costs a task and never the lineage before the table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.made:03d}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete kept tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            if t is not None and hasattr(t, "_kept_at"):
                path = jvm.org.apache.hadoop.fs.Path(t._kept_at)
                path.getFileSystem(conf).delete(path, True)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system, as Hadoop resolves it on the driver, so
    that tasks which open it by other means find the same place."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def spread_join(many: DataFrame, few: DataFrame, key: str, by: list[str], parts: int = 1024) -> DataFrame:
    """``many`` left joined with ``few``, which has at most one row per key. Keys
    with over 1/``parts`` of the rows are cut by a hash of the columns ``by`` and
    meet a copy of their row in each piece; rows without a key meet nothing and are
cut as well. There are fewer than ``parts`` such
    keys, so their table (a key and a number each) may be broadcast."""
    cut, pieces = "_j_cut", "_j_pieces"
    total = many.count()
    hot = F.broadcast(many.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") * parts > total).select(
        key, F.ceil(F.col("n") * parts / F.lit(max(total, 1))).cast("int").alias(pieces)))
    own = F.pmod(F.xxhash64(*by), F.when(F.col(key).isNull(), F.lit(parts)).otherwise(F.coalesce(pieces, F.lit(1)))).cast("int")
    left = many.join(hot, key, "left").withColumn(cut, own).drop(pieces)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1))
    right = few.join(hot, key, "left").withColumn(cut, every).drop(pieces)
    return left.join(right, [key, cut], "left").drop(cut)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def batch_of(**columns):
    """A record batch of named arrays; numpy arrays and lists are converted."""
    import pyarrow as pa

    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """At most ``most`` rows of a kept table, those with the largest counts. The
    counts are put in steps of 1/16 of a factor of two; whole steps are taken from
    the top for as long as they fit, so no task sorts or takes them all."""
    step = F.floor(F.log2(F.col(n)) * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()  # at most 1024
    least, taken = None, 0
    for row in sizes:
        taken += row["rows"]
        if taken > most:
            break
        least = row["step"]
    return counts.filter(F.lit(False) if least is None else step >= least)
