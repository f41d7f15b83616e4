"""Running folds over ordered groups in which one group may hold much of the table.

A plain window sorts a whole group in one task. Here each group is cut into chunks along its own order
(say, by year or by block of lines). The fold runs inside each chunk, the chunk totals are folded per
group, and each chunk takes over what the chunks before it carry. Chunk totals are pre-aggregated on the
map side, and a group's list of chunks is small, so no task ever sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

CHUNK, GROUP = "__chunk", "__group"
BLOCK, CHUNKS = 1 << 16, 1 << 12


def block(order: str, size: int = BLOCK) -> Column:
    """Chunks of a row number or line number."""
    return F.floor(F.col(order) / size)


def one_block(df: DataFrame, order: str, size: int = BLOCK) -> bool:
    """Do all rows lie in one block? Then no group has a second one, and a fold needs no chunks. Reads the rows once."""
    ends = df.agg(F.min(block(order, size)).alias("low"), F.max(block(order, size)).alias("high")).first()
    return ends.low == ends.high


def year(order: str) -> Column:
    """Chunks of a date."""
    return F.year(order)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    folds: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    reverse: bool = False,
    nested: bool = False,
    whole: bool = False,
) -> DataFrame:
    """Add one column per fold: `sum`, `max`, or `last` (the last value that is not NULL).

    `order` must be total within a key and `chunk` must rise with it; a NULL key is a group like any other. With
    `inclusive=False` a row's own value does not count, so `last` of a struct is a lag. With
    `reverse=True` the fold runs from the far end, so the same is a lead. With `whole=True`, for rows that are known
    to lie in one chunk (see `one_block`), rows that are dealt by some of the keys stay where they are and are read once.
    """
    keys = list(keys)
    way = F.desc if reverse else F.asc
    if whole:
        window = Window.partitionBy(*keys).orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        plain = {"sum": lambda v: F.coalesce(F.sum(v).over(window), F.lit(0)), "max": lambda v: F.max(v).over(window), "last": lambda v: F.last(v, ignorenulls=True).over(window)}
        return df.select(*[F.col(c) for c in df.columns], *[plain[kind](value).alias(name) for name, (kind, value) in folds.items()])
    values = {name: f"__v_{name}" for name in folds}
    # One struct of all keys: unlike its fields it is never NULL, so rows with NULL keys meet in joins as well.
    base = df.withColumn(CHUNK, chunk).withColumn(GROUP, F.struct(*keys) if keys else F.lit(True))
    for name, (_, value) in folds.items():
        base = base.withColumn(values[name], value)

    local_window = (
        Window.partitionBy(GROUP, CHUNK)
        .orderBy(*[way(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    before = Window.partitionBy(GROUP).orderBy(way(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)

    local, total, carried, merged = [], [], [], []
    for name, (kind, _) in folds.items():
        value, here, sofar = F.col(values[name]), f"__l_{name}", f"__c_{name}"
        if kind == "sum":
            local.append(F.sum(value).over(local_window).alias(here))
            total.append(F.sum(value).alias(sofar))
            carried.append(F.sum(sofar).over(before).alias(sofar))
            zero = F.lit(0)
            merged.append((F.coalesce(F.col(here), zero) + F.coalesce(F.col(sofar), zero)).alias(name))
        elif kind == "max":
            local.append(F.max(value).over(local_window).alias(here))
            total.append(F.max(value).alias(sofar))
            carried.append(F.max(sofar).over(before).alias(sofar))
            merged.append(F.greatest(here, sofar).alias(name))
        elif kind == "last":
            nearest = F.min_by if reverse else F.max_by
            local.append(F.last(value, ignorenulls=True).over(local_window).alias(here))
            total.append(nearest(value, F.when(value.isNotNull(), place)).alias(sofar))
            carried.append(F.last(sofar, ignorenulls=True).over(before).alias(sofar))
            merged.append(F.coalesce(here, sofar).alias(name))
        else:
            raise ValueError(f"unknown fold {kind}")

    rows = base.select(*df.columns, GROUP, CHUNK, *local)
    totals = base.groupBy(GROUP, CHUNK).agg(*total)
    if keys or nested:
        carry = totals.select(GROUP, CHUNK, *carried)
    else:
        # A table without keys has one total for each chunk of all its rows: these are folded in chunks again.
        again = {f"__c_{name}": (kind, F.col(f"__c_{name}")) for name, (kind, _) in folds.items()}
        totals = totals.withColumnRenamed(CHUNK, "__at").withColumnsRenamed({f"__c_{name}": f"__t_{name}" for name in folds})
        again = {name: (kind, F.col(name.replace("__c_", "__t_", 1))) for name, (kind, _) in again.items()}
        carry = running(totals.drop(GROUP), [], ["__at"], F.floor(F.col("__at") / CHUNKS), again, inclusive=False, reverse=reverse, nested=True)
        carry = carry.select(F.lit(True).alias(GROUP), F.col("__at").alias(CHUNK), *again)
    # A first chunk takes over nothing. Most groups have no other, so what is left to join is small.
    carry = carry.where(reduce(or_, [F.col(f"__c_{name}").isNotNull() for name in folds]))
    return rows.join(carry, [GROUP, CHUNK], "left").select(*[F.col(c) for c in df.columns], *merged)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Row number per key along any order, from one; ties are numbered anyhow.

    Rows are dealt out by ranges of keys and order and written, each with the range it fell into. Ranges are numbered on
    their own, and their sizes added up: one small row per key and range is all that meets in one task.
    """
    keys = list(keys)
    spread = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(CHUNK, F.spark_partition_id()), "ranges")
    spread = spread.withColumn(GROUP, F.struct(*keys) if keys else F.lit(True))
    before = Window.partitionBy(GROUP).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy(GROUP, CHUNK).agg(F.count("*").alias("__size"))
    sizes = sizes.select(GROUP, CHUNK, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(GROUP, CHUNK).orderBy(*order))
    rows = spread.withColumn("__place", place).join(sizes, [GROUP, CHUNK])
    return rows.select(*df.columns, (F.col("__before") + F.col("__place")).cast("bigint").alias(name))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str, *, whole: bool = False) -> DataFrame:
    """Row number per key, from one."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("bigint"))}, whole=whole)
