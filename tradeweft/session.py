"""Session helper and the shared scratch folder for materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tradeweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on. ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint directory.

    It has to be shared by all executors. Only a local session, where none is set,
    gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tradeweft-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The part of the scratch folder that belongs to this application alone."""
    return f"{scratch_dir(spark)}/tradeweft/{spark.sparkContext.applicationId}"


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    This cuts the lineage with data that outlives lost executors, and freezes columns
    that are not a pure function of the row (such as the partition a row landed in).
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that :func:`written_table` has written in this application."""
    root = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
