"""Reliable lineage cuts for iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FOLDER = "/tmp/kinetable-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Where the setting is missing, a local master (one process, as in tests) gets a folder of its
    own; on a cluster its absence is an error, since no default would be seen by all executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_FOLDER
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eagerly checkpoint ``df`` in the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """Write an intermediate table that several later branches read.

    Block scans read their input twice, so chains of them stage in between; the cost then
    grows with the length of the chain instead of doubling at every link.
    """
    return cut_lineage(df)


def scratch_folder(df_or_spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for tables written on the way."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Like ``stage``, as a Parquet table: a fraction of a checkpoint's bytes where rows are many."""
    path = scratch_folder(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, place = located(spark, path)
    return files.exists(place)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = located(spark, path)
    files.delete(place, True)
