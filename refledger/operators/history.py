"""Effective-dated histories: building them, checking them, and resolving them as of a date.

A period row holds `start_date` and `end_date`, both inclusive; an open end is 9999-12-31.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refledger.functions.dates import OPEN_END
from refledger.operators.prefix import numbered, running, year
from refledger.operators.stage import computed, dealt

START, END = "start_date", "end_date"


def first_attributes(rows: DataFrame, key: str, attrs: Sequence[str], ord: str = "ord") -> DataFrame:
    """One row per key, holding the attributes of its first source row."""
    first = F.min_by(F.struct(*attrs), F.col(ord))
    return rows.groupBy(key).agg(first.alias("first"), F.count("*").alias("n_periods")).select(
        key, "first.*", "n_periods"
    )


def numbered_periods(periods: DataFrame, key: str, ord: str = "ord") -> DataFrame:
    """Each key's periods with their place `seq` in order of start, end and source row."""
    return numbered(periods, [key], [START, END, ord], year(START), "seq")


def to_history(rows: DataFrame, key: str, attrs: Sequence[str], ord: str = "ord") -> DataFrame:
    """Flat rows as a history: the first row's attributes, and the numbered periods under them.

    The history stays one row per period, since a nested array per key has no size bound.
    """
    periods = numbered_periods(rows.drop(*attrs), key, ord)
    return periods.join(first_attributes(rows, key, attrs, ord), key)


def _marks(periods: DataFrame, on: str, payload: Sequence[str]) -> DataFrame:
    """Per key and day: how many periods start less how many ended the day before, and the last of those that start."""
    body = F.struct(F.col(END), F.col(START), *payload)
    nobody = F.lit(None).cast(periods.select(body.alias("b")).schema["b"].dataType)
    events = F.array(
        F.struct(F.col(START).alias("day"), F.lit(1).alias("step"), body.alias("period")),
        F.struct(F.date_add(END, 1).alias("day"), F.lit(-1).alias("step"), nobody.alias("period")),
    )
    closed = F.filter(events, lambda e: (e.step == 1) | (F.col(END) < F.lit(OPEN_END).cast("date")))
    return (
        periods.where(F.col(START) <= F.col(END))
        .select(on, F.inline(closed))
        .groupBy(on, "day")
        .agg(F.sum("step").alias("step"), F.max("period").alias("period"))
    )


@dataclass(frozen=True)
class StoredHistory:
    """Marks of periods in a table that is bucketed and sorted by key: see `store_history`."""

    table: str
    path: str
    on: str
    payload: tuple[str, ...]
    buckets: int

    def marks(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.table)

    def drop(self, spark: SparkSession) -> None:
        """Forget the table's name; its files stay for as long as their folder does."""
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def store_history(periods: DataFrame, on: str, payload: Sequence[str], path: str, buckets: int | None = None) -> StoredHistory:
    """Store a history once by its key, so that any number of later as-of joins shuffles the asked dates only.

    What is stored are the marks of the sweep, which are added up per key and calendar day before they are shuffled: a
    key with a third of all periods has no more rows than days. A bucket is one file. `buckets`, by default the number
    of shuffle partitions, should leave a bucket within a task's memory, as a shuffle partition should be. Periods
    without a key answer nothing and are not stored.
    """
    spark = periods.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"refledger_history_{uuid.uuid4().hex}"
    marks = _marks(periods.where(F.col(on).isNotNull()), on, payload)
    # In the order in which `asof_one` reads them, so that nothing stands between the scan and its union.
    marks = marks.select(on, "day", F.lit(False).alias("asked"), "step", "period").repartition(buckets, on)
    marks.write.bucketBy(buckets, on).sortBy(on, "day").format("parquet").option("path", path).saveAsTable(table)
    return StoredHistory(table, path, on, tuple(payload), buckets)


def open_history(spark: SparkSession, path: str, on: str, buckets: int) -> StoredHistory:
    """A history that another application stored at `path`, with the key and number of buckets it was stored with."""
    schema, table = spark.read.parquet(path).schema, f"refledger_history_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {table} ({schema.toDDL()}) USING parquet LOCATION '{path}' "
        f"CLUSTERED BY (`{on}`) SORTED BY (`{on}`, day) INTO {buckets} BUCKETS"
    )
    payload = tuple(f for f in schema["period"].dataType.names if f not in (START, END))
    return StoredHistory(table, path, on, payload, buckets)


def asof_one(
    asks: DataFrame,
    periods: DataFrame | StoredHistory,
    on: str,
    as_of: str,
    payload: Sequence[str],
) -> DataFrame:
    """The one period that covers each asked date. None or several covering periods give no row.

    A sweep, not a join on the key: each period marks its start (+1) and the day after its end (-1).
    Marks are first added up per key and day, so a key has at most one mark and one ask per calendar
    day however many rows it holds, and no pairs of asks and periods are formed. Where the running
    count is one, the covering period is the started one that ends last. A period that ends before it
    starts, or lacks a date, covers no day. Marks of a stored history are read where they lie: the asked
    dates are dealt out to its buckets, and nothing of the history is shuffled.
    """
    asked = asks.select(on, F.col(as_of).alias("day")).distinct().withColumn("asked", F.lit(True))
    if isinstance(periods, StoredHistory):
        if periods.on != on or not set(payload) <= set(periods.payload):
            raise ValueError(f"the history is stored by {periods.on} with {periods.payload}")
        marks, asked = periods.marks(asks.sparkSession), asked.repartition(periods.buckets, on)
    else:
        marks = _marks(periods, on, payload).withColumn("asked", F.lit(False))
    sweep = (
        Window.partitionBy(on).orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        marks.unionByName(asked, allowMissingColumns=True)
        .select(on, "day", "asked", F.sum("step").over(sweep).alias("covering"), F.max("period").over(sweep).alias("period"))
        .where("asked AND covering = 1")
        .select(on, F.col("day").alias(as_of), *[F.col(f"period.{c}") for c in (END, START, *payload)])
    )
    if isinstance(periods, StoredHistory):
        # A union knows the buckets of a bare scan only: so `asked` is stored, and the join's test for nulls stays above.
        answers = computed(answers)
    return asks.join(answers, [on, as_of])


def covered_once(periods: DataFrame, on: str, payload: Sequence[str]) -> DataFrame:
    """Stretches of days that exactly one of a key's periods covers: `from_day`, `next_day` (open if NULL), payload."""
    marks = dealt(_marks(periods, on, payload), on)
    sweep = Window.partitionBy(on).orderBy("day")
    running = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stretches = marks.select(
        on, F.col("day").alias("from_day"), F.lead("day").over(sweep).alias("next_day"),
        F.sum("step").over(running).alias("covering"), F.max("period").over(running).alias("period"),
    )
    return stretches.where("covering = 1").select(on, "from_day", "next_day", *[F.col(f"period.{c}") for c in payload])


def counted_as_of(stretches: DataFrame, asks: DataFrame, on: str, by: Sequence[str], as_of: str) -> DataFrame:
    """How many stretches of `covered_once` hold each asked day: (on, as_of, by, n), n over zero.

    `stretches`: on, by, from_day, next_day, and a number `n` of them; `asks`: distinct on, as_of as text, and as a date
    `as_of_date`. A sweep as in `asof_one`: stretches are added up per day, so no stretch meets the days that it holds.
    """
    steps = F.array(F.struct(F.col("from_day").alias("day"), F.col("n").alias("step")), F.struct(F.col("next_day").alias("day"), (-F.col("n")).alias("step")))
    marks = stretches.select(on, *by, F.inline(steps)).where("day IS NOT NULL").groupBy(on, *by, "day").agg(F.sum("step").alias("step"))
    asked = asks.select(on, F.col(as_of), F.col("as_of_date").alias("day")).join(stretches.select(on, *by).distinct(), on)
    sofar = Window.partitionBy(on, *by).orderBy("day", F.col(as_of).isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(asked, allowMissingColumns=True)
    return both.select(on, as_of, *by, F.sum("step").over(sofar).alias("n")).where(F.col(as_of).isNotNull() & (F.col("n") > 0))


def covering_one(history: Column, as_of: Column) -> Column:
    """The same for a nested ARRAY of periods: no shuffle, for rows that carry their own history."""
    covering = F.filter(history, lambda p: (p[START] <= as_of) & (as_of <= p[END]))
    return F.when(F.size(covering) == 1, covering[0])


def overlaps(periods: DataFrame, key: str, ord: str = "ord") -> DataFrame:
    """Periods that start on or before the latest end of the periods before them, with that period."""
    earlier = F.struct(END, F.col(ord).alias("ord"))
    scanned = running(
        periods, [key], [START, END, ord], year(START), {"__earlier": ("max", earlier)}, inclusive=False
    )
    return scanned.where(F.col(START) <= F.col(f"__earlier.{END}")).select(
        *periods.columns,
        F.col("__earlier.ord").alias("earlier_ord"),
        F.col(f"__earlier.{END}").alias("earlier_end"),
    )


def gaps(periods: DataFrame, key: str, ord: str = "ord") -> DataFrame:
    """Stretches between a key's periods that no period covers."""
    scanned = running(
        periods, [key], [START, END, ord], year(START), {"__covered": ("max", F.col(END))}, inclusive=False
    )
    return scanned.where(F.datediff(START, "__covered") > 1).select(
        key,
        F.date_add("__covered", 1).alias("gap_start"),
        F.date_sub(START, 1).alias("gap_end"),
        (F.datediff(START, "__covered") - 1).cast("bigint").alias("gap_days"),
    )
