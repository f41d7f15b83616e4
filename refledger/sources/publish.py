"""Write-once publishing of dataset versions, and the test for drift.

A version's files are written aside, complete, and then moved to their place in one step that fails if the place is
taken. So readers see a version whole or not at all, of two writers one publishes, and a job that dies leaves nothing
but files that no reader lists. A replaced version is moved aside before, and kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.operators.contracts import stop_on_any

VERSION = "dataset_version"


def drift(published: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows that only one side holds, with `side` and the number of copies. Both have the same columns.

    Sides are added up per distinct row in one aggregate, so copies never travel one by one.
    """
    cols = [F.col(f"`{c}`") for c in published.columns]
    both = published.select(*cols, F.lit(1).alias("__side")).unionByName(derived.select(*cols, F.lit(-1).alias("__side")))
    odd = both.groupBy(*cols).agg(F.sum("__side").alias("__n")).where("__n <> 0")
    return odd.select(
        *cols,
        F.when(F.col("__n") > 0, "published").otherwise("derived").alias("side"),
        F.abs("__n").alias("copies"),
    )


def read_version(df: DataFrame, path: str, version: str) -> DataFrame | None:
    """The published rows of a version by their own schema, or None if it is not there."""
    try:
        return df.sparkSession.read.parquet(f"{path}/{VERSION}={version}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _move(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder to a place that must be free; False if it is taken or the folder is gone."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    source, target = fs.Path(old), fs.Path(new)
    context = fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, none)
        return True
    except Py4JJavaError as e:
        # What is there now tells a lost race from a store that cannot move folders.
        taken = context.util().exists(target) or not context.util().exists(source)
        if taken:
            return False
        raise OSError(str(e.java_exception)) from e


def _stage(rows: DataFrame, path: str, version: str) -> str:
    """Write rows aside; names that start with an underscore are listed by no reader."""
    staged = f"{path}/_staged/{version}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(staged)
    return staged


def publish(
    df: DataFrame,
    path: str,
    version: str,
    *,
    checks: DataFrame | None = None,
    on_conflict: str = "refuse",
    drop: Sequence[str] = (),
) -> str:
    """Publish a version once: "written", "unchanged", or "replaced".

    Any violation in `checks` stops it. Columns in `drop` are checked but not published. If the version
    is there with other content, "refuse" raises and "replace" puts the new rows in its place; the old ones
    stay under `_replaced`. `df` may read from the version that it replaces. Of several writers of a version one
    writes it, and the others find it there; of several that replace it one does, and the others are told.
    """
    if on_conflict not in ("refuse", "replace"):
        raise ValueError(f"unknown on_conflict {on_conflict}")
    if checks is not None:
        stop_on_any(checks)
    rows, spark = df.drop(*drop), df.sparkSession
    target = f"{path}/{VERSION}={version}"
    there, staged = read_version(rows, path, version), None
    if there is None:
        staged = _stage(rows, path, version)
        if _move(spark, staged, target):
            return "written"
        # Another writer was first: its version counts like any that was there before.
        there = read_version(rows, path, version)
    # Another schema is other content, whatever the rows.
    same = [(f.name, f.dataType) for f in there.schema] == [(f.name, f.dataType) for f in rows.schema]
    # Another number of rows is other content, which counts tell without a shuffle of whole rows.
    if same and there.count() == rows.count() and not drift(there, rows).limit(1).collect():
        return "unchanged"
    if on_conflict == "refuse":
        raise ValueError(f"version {version} is published with other content")
    staged = staged or _stage(rows, path, version)
    aside = f"{path}/_replaced/{version}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_replaced")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    if not _move(spark, target, aside):
        raise ValueError(f"version {version} is being replaced by another writer")
    if not _move(spark, staged, target):
        raise ValueError(f"version {version} was published anew by another writer")
    return "replaced"


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; absent values are written as null."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)
