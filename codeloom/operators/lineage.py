"""Cutting lineage through tables in the cluster's shared checkpoint folder."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}   # numbers that rise and texts that share a beginning are stored as differences


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``. Without one, a session of a single machine gets a folder of its own; on a cluster it is an error,
    as executors would write to their own disks."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if configured is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="codeloom-ckpt-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Rows written once to shared storage, so that later steps neither recompute nor lose them.

    A columnar table rather than a row checkpoint: later reads take only the columns they need.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.options(**PACKED).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """Rows of a result that a limit already cut, held by the driver for further small joins."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
