"""Strict scans under any projection, periods that cover nothing, seams over several lines, NULL keys."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from refledger.functions import text
from refledger.functions.dates import is_stale
from refledger.operators import history, lines
from refledger.operators.prefix import block, running
from refledger.sources import scans
from refledger.sources.publish import publish

SCHEMA = StructType([StructField(c, StringType()) for c in ("a", "b", "c")])


def narrow_reads(df):
    return (lambda: df.select("a").collect(), df.count, lambda: df.groupBy().count().collect())


@pytest.mark.parametrize("body", ["a,b,c\n1,2\n", "a,b,c\n1,2,3,4\n", 'a,b,c\n1,2,"x"y\n'])
def test_csv_is_strict_under_any_projection(spark, tmp_path, body):
    (tmp_path / "f.csv").write_text(body)
    for read in narrow_reads(scans.scan_csv_strict(spark, str(tmp_path / "f.csv"), SCHEMA)):
        with pytest.raises(Exception):
            read()


@pytest.mark.parametrize("body", ['{"a":"1","b":"2"}', '{"a":"1","b":"2","c":"3","d":"4"}', "no json", "[1]"])
def test_jsonl_is_strict_under_any_projection(spark, tmp_path, body):
    (tmp_path / "f.jsonl").write_text('{"a":"1","b":"2","c":null}\n' + body + "\n")
    for read in narrow_reads(scans.scan_jsonl_strict(spark, str(tmp_path / "f.jsonl"), SCHEMA)):
        with pytest.raises(Exception):
            read()


def test_clean_files_pass_narrow_reads(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,b,c\n1,2,3\n4,5,6\n")
    (tmp_path / "f.jsonl").write_text('{"c":"1","b":"2","a":null}\n{"a":"1","b":"2","c":"3"}\n')
    for df in (scans.scan_csv_strict(spark, str(tmp_path / "f.csv"), SCHEMA), scans.scan_jsonl_strict(spark, str(tmp_path / "f.jsonl"), SCHEMA)):
        assert df.count() == 2 and len(df.select("a").collect()) == 2


def test_asof_ignores_periods_that_cover_no_day(spark):
    day = datetime.date
    rows = [
        ("x", day(2020, 1, 1), day(2020, 12, 31), "A"), ("x", day(2020, 6, 1), day(2020, 3, 1), "B"), ("x", day(2020, 2, 1), None, "C"),
        ("y", day(2020, 6, 1), day(2020, 3, 1), "D"), ("z", day(2020, 1, 1), day(2020, 6, 1), "E"), ("z", day(2020, 3, 1), day(2020, 9, 1), "F"),
    ]
    periods = spark.createDataFrame(rows, "code string, start_date date, end_date date, name string")
    asked = [(c, day(2020, m, 1)) for c in "xyz" for m in (1, 2, 3, 4, 6, 7, 9, 10)]
    asks = spark.createDataFrame(asked, "code string, as_of date")
    got = {(r.code, r.as_of): r.name for r in history.asof_one(asks, periods, "code", "as_of", ["name"]).collect()}
    due = {}
    for code, at in asked:
        hits = [n for c, s, e, n in rows if c == code and e is not None and s <= at <= e]
        if len(hits) == 1:
            due[code, at] = hits[0]
    assert got == due


def rejoined(spark, value, exceptions=()):
    return spark.createDataFrame([(value,)], "v array<string>").select(text.rejoin(F.col("v"), exceptions).alias("r")).first().r


def joined_by_hand(parts, exceptions=()):
    """The published way: one line after the other, looking at the text so far."""
    latin = lambda c: c != "" and c.isascii() and c.isalnum()
    tight = set(text.FULL_WIDTH_PUNCTUATION) | {"-"}
    out = ""
    for line in parts:
        if out == "":
            out = line
            continue
        left, right = out[-1], line[:1]
        named = any(out.endswith(a) and line.startswith(b) for a, b in exceptions)
        spaced = not named and left not in tight and right not in tight and (latin(left) or latin(right))
        out += (" " if spaced else "") + line
    return out


@pytest.mark.parametrize(
    "parts",
    [["", "abc"], ["ab", "", "c"], ["ab", "", "", "："], ["x", ""], ["：", "", "b"], ["", ""], [], ["ab", "cd", "ef"], ["a-", "b", "", "c"], ["一", "二", "三x"]],
)
def test_rejoin_blank_lines(spark, parts):
    assert rejoined(spark, parts) == joined_by_hand(parts)


def test_exceptions_look_at_the_text_so_far(spark):
    for parts, exceptions in (
        (["ab", "cd", "ef"], [("b cd", "ef")]),
        (["ab", "cd", "ef"], [("cd", "ef"), ("ab", "cd")]),
        (["a", "b", "c", "d"], [("a b c", "d")]),
        (["", "a", "b"], [("a", "b")]),
    ):
        assert rejoined(spark, parts, exceptions) == joined_by_hand(parts, exceptions)
    items = spark.createDataFrame([(["ab", "cd", "ef"],)], "lines array<string>")
    assert [tuple(r) for r in lines.unfired(items, [("b cd", "ef"), ("x", "y")]).collect()] == [("x", "y")]


def test_full_matches_end_at_the_end(spark):
    df = spark.createDataFrame([("ABCDEFGHIJ", "2020-01-02"), ("ABCDEFGHIJ\n", "2020-01-02\n")], "code string, day string")
    got = [tuple(r) for r in df.select(text.is_code(F.col("code")), is_stale(F.col("day"), "2019-01-01")).collect()]
    assert got == [(True, True), (False, False)]


def test_long_thresholds(spark):
    df = spark.createDataFrame([("≧1234567890123456789012",), ("≧190",), ("none",)], "v string")
    got = [r.t for r in df.select(text.threshold(F.col("v"), r"≧(\d+)").alias("t")).collect()]
    assert got == [1234567890123456789012, 190, None]


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_over_null_keys_and_whole_tables(spark, monkeypatch, keys):
    from refledger.operators import prefix

    monkeypatch.setattr(prefix, "CHUNKS", 2)
    rows = [(None if i % 3 == 0 else i % 2, i, i if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    folds = {"n": ("sum", F.lit(1)), "big": ("max", F.col("v")), "was": ("last", F.col("v"))}
    for reverse in (False, True):
        got = {r.o: (r.n, r.big, r.was) for r in running(df, keys, ["o"], block("o", 4), folds, reverse=reverse).collect()}
        for k, o, _ in rows:
            seen = [(p, v) for x, p, v in rows if (not keys or x == k) and (p >= o if reverse else p <= o)]
            held = [(p, v) for p, v in seen if v is not None]
            last = (min if reverse else max)(held)[1] if held else None
            assert got[o] == (len(seen), max((v for _, v in held), default=None), last)


def test_another_schema_is_other_content(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    path = str(tmp_path / "t")
    assert publish(rows, path, "v1") == "written" and publish(rows, path, "v1") == "unchanged"
    for other in (rows.select("id"), rows.withColumn("id", F.col("id").cast("long")), rows.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError):
            publish(other, path, "v1")
    assert publish(rows.select("id"), path, "v1", on_conflict="replace") == "replaced"


def test_written_tables_are_dropped(spark):
    """In a session of its own setting: other tests still read theirs."""
    import os

    from refledger.sources import workspace

    own = workspace.workspace
    try:
        workspace.workspace = lambda spark: own(spark) + "-alone"
        path = workspace.fresh_path(spark, "t")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path.removeprefix("file:"))
        assert workspace.clear(spark) and not os.path.exists(path.removeprefix("file:"))
    finally:
        workspace.workspace = own
