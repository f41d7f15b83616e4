"""Where jobs put written tables: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset, a local master, as in tests, gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="refledger-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def workspace(spark: SparkSession) -> str:
    """The application's own folder within the shared one."""
    return f"{shared_folder(spark)}/refledger-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Drop all tables that this application has written on its way; DataFrames that read them end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(workspace(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a written table in the shared folder.

    For rows that several later steps read: they are computed once, and a lost executor costs a read of
    the table, not the whole lineage.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
