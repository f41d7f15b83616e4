"""Keeping costly columns computed once, and rows in parts that a task can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed(rows: DataFrame) -> DataFrame:
    """The same rows, each column computed once.

    A filter on a later column would otherwise be pushed down with all the logic above written out in
    it, many times over. Filters do not pass a generator, here one that gives one row per row.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))


def dealt(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt out by columns, over the session's number of shuffle partitions.

    Parts that Spark deals out on its own are put together up to a size as compressed, which sorted or hashed is many
    times that; and keys that are nearly unique, added up before a shuffle, fill memory with a whole split of a file.
    These parts stay as they are, and what is added up by the columns is added up in them, once.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
