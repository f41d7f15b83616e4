"""Versions compared by digests, and histories stored by key."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from refledger.operators import history
from refledger.operators.reconcile import snapshot_diff
from refledger.sources.publish import drift
from refledger.sources.versions import changed_leaves, keyed_diff, keyed_drift, only_changed, publish_keyed, read_keyed

BITS = {"folder_bits": 3, "leaf_bits": 8}


def folders(df):
    return {re.search(r"__folder=(\d+)", f).group(1) for f in df.inputFiles()}


def rows_of(df):
    return sorted(map(str, df.collect()))


def published(spark, path, **versions):
    for name, df in versions.items():
        assert publish_keyed(df, path, name, "k", **BITS) == "written"
    return [read_keyed(spark, path, name) for name in versions]


def test_one_changed_row_reads_one_leaf(spark, tmp_path):
    old = spark.range(20_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
    new = old.withColumn("x", F.when(F.col("k") == 777, "other").otherwise(F.col("x")))
    a, b = published(spark, str(tmp_path), a=old, b=new)
    assert changed_leaves(a, b).count() == 1
    part = only_changed(a, b)
    # Of 256 leaves in 8 folders one is read: folders and leaves are filters of the scan.
    assert part.old.count() == part.new.count() < 200
    plan = part.new._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(__folder" in plan and "__leaf" in plan.split("PushedFilters")[1]
    assert [tuple(r) for r in keyed_diff(a, b, "k").collect()] == [(777, "changed")]
    assert part.untouched.count() + part.new.count() == 20_000
    assert len(folders(a.rows)) == 8


def test_diff_against_the_whole_join(spark, tmp_path):
    old = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"))
    new = spark.range(3, 510).select(F.col("id").alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") % 7).alias("x"))
    a, b = published(spark, str(tmp_path), a=old, b=new)
    assert rows_of(keyed_diff(a, b, "k", same=True)) == rows_of(snapshot_diff(old, new, "k"))
    assert rows_of(keyed_diff(a, b, "k")) == rows_of(snapshot_diff(old, new, "k").where("change <> 'same'"))
    assert rows_of(keyed_drift(a, b)) == rows_of(drift(old, new))
    assert keyed_diff(a, a, "k").count() == 0 and only_changed(a, a).new.count() == 0


def test_what_rows_must_tell_apart(spark, tmp_path):
    """Microseconds, nulls beside empty texts, equal texts in other columns, and the number of copies."""
    schema = "k int, t timestamp, x string, `y.z` string"
    at = dt.datetime(2020, 1, 1, 0, 0, 0, 1)
    base = [(1, at, "", None), (2, at, "a", "b"), (3, at, "c", None), (3, at, "c", None), (None, None, None, None)]
    others = [
        [(1, at.replace(microsecond=2), "", None)], [(1, at, None, None)], [(1, at, None, "")], [(1, at, "", None)] * 2,
    ]
    first = spark.createDataFrame(base, schema)
    (a,) = published(spark, str(tmp_path), a=first)
    for i, other in enumerate(others):
        df = spark.createDataFrame(other + base[1:], schema)
        (b,) = published(spark, str(tmp_path), **{f"v{i}": df})
        assert changed_leaves(a, b).count() == 1
        assert rows_of(keyed_drift(a, b)) == rows_of(drift(first, df))
    assert publish_keyed(first.repartition(7).orderBy("x"), str(tmp_path), "a", "k", **BITS) == "unchanged"


def test_empty_versions_other_layouts_and_columns(spark, tmp_path):
    some, none = spark.range(40).toDF("k"), spark.range(0).toDF("k")
    path = str(tmp_path)
    a, e = published(spark, path, a=some, e=none)
    assert e.rows.count() == 0 and e.root["n_rows"] == 0
    assert {r.change for r in keyed_diff(e, a, "k").collect()} == {"added"}
    assert {r.change for r in keyed_diff(a, e, "k", same=True).collect()} == {"removed"}
    assert publish_keyed(none, path, "e", "k", **BITS) == "unchanged"
    # Another layout is read whole; the same rows are the same version.
    assert publish_keyed(some, path, "a", "k", folder_bits=1, leaf_bits=4) == "unchanged"
    assert publish_keyed(some.where("k > 0"), path, "c", "k", folder_bits=1, leaf_bits=4) == "written"
    assert [tuple(r) for r in keyed_diff(a, read_keyed(spark, path, "c"), "k").collect()] == [(0, "removed")]
    for other in (some.where("k > 1"), some.withColumn("x", F.lit(1)), some.select(F.col("k").cast("int"))):
        with pytest.raises(ValueError):
            publish_keyed(other, path, "a", "k", **BITS)
    with pytest.raises(ValueError):
        publish_keyed(some, path, "d", "k", folder_bits=5, leaf_bits=4)
    with pytest.raises(ValueError):
        publish_keyed(some.withColumn("__leaf", F.lit(1)), path, "d", "k")


@pytest.mark.parametrize("reopened", [False, True])
def test_a_stored_history_is_not_shuffled(spark, tmp_path, reopened):
    rnd = random.Random(9)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rnd.randrange(60))
    rows = []
    for i in range(400):
        since, until = sorted((day(), day()))
        rows.append((rnd.choice(["H", "H", "H", "A", "B", None]), since, None if i % 50 == 0 else until, str(i), i))
    df = spark.createDataFrame(rows, "code string, start_date date, end_date date, price_raw string, ord long")
    asks = spark.createDataFrame([(rnd.choice("HABC"), day()) for _ in range(200)], "code string, d date")
    stored = history.store_history(df, "code", ["price_raw", "ord"], str(tmp_path / "h"), 3)
    if reopened:
        stored.drop(spark)
        stored = history.open_history(spark, str(tmp_path / "h"), "code", 3)
    for payload in (["price_raw"], ["ord", "price_raw"]):
        got = history.asof_one(asks, stored, "code", "d", payload)
        due = history.asof_one(asks, df, "code", "d", payload)
        assert got.columns == due.columns and rows_of(got) == rows_of(due) and got.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    window = max(i for i, line in enumerate(lines[:scan]) if "Window" in line)
    assert not [line for line in lines[window:scan] if "Exchange" in line]
    with pytest.raises(ValueError):
        history.asof_one(asks, stored, "code", "d", ["end"])
    stored.drop(spark)
    assert not spark.catalog.tableExists(stored.table)
