"""Session settings and the helpers that touch cluster configuration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a frame costs far more time than bytes, so small partitions are kept apart
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(app: str = "playframe", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the engine relies on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _set_checkpoint_dir(spark: SparkSession) -> None:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="playframe-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder the cluster names.

    A private temporary folder is set only when neither the session nor the
    context names one, which is the case in local tests.
    """
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        _set_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table under the shared checkpoint folder and read
    it back, so that later branches read only the columns they need."""
    import uuid

    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        _set_checkpoint_dir(df.sparkSession)
    root = sc._jsc.sc().getCheckpointDir().get()
    path = f"{root}/playframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
