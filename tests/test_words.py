"""Word tables beside a plain search, with one automaton and without."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from refledger.operators import contracts, words

TEXTS = [None, "", "abc", "naïve café", "AbC \U0001f600 x", "aaaaaaaaaaaaaaaaaaaaaaa", "the end", "x" * 50_000 + " needle in hay " + "y" * 50_000]
LISTED = [None, "a", "aa", "aaaaaaaaaaaaaaaaaa", "abc", "bc", "é", "\U0001f600", "needle in hay y", "xx need", "zz", "end", "End"]


def table(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def brute(texts, listed):
    return sorted({w for w in listed if w is not None for t in texts if t is not None and w in t})


@pytest.mark.parametrize("at_once", [1 << 20, 3])
@pytest.mark.parametrize("listed", [LISTED, LISTED + [""], [], [None]])
def test_words_of_two_columns(spark, at_once, listed):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(TEXTS, reversed(TEXTS)))] + [(99, "abc", "abc")] * 2
    df = spark.createDataFrame(rows, "id long, a string, b string").withColumn("held_by", F.lit(1))
    got = words.held_words(df, ["a", "b"], table(spark, listed * 2, "word") if listed else table(spark, [], "word"), at_once=at_once)
    assert got.columns == [*df.columns, "held"]
    assert sorted((r.id, r.held) for r in got.collect()) == sorted((i, brute((a, b), listed)) for i, a, b in rows)


@pytest.mark.parametrize("at_once", [1 << 20, 3])
def test_labels(spark, at_once):
    df = spark.createDataFrame([(1, "Some Statin 5 mg"), (2, None), (3, "plain"), (3, "plain"), (4, "statin + EZE")], "id long, text string")
    labels = spark.createDataFrame([("s", "STATIN"), ("s", "SOME"), ("combo", "EZE"), ("five", "5 MG")], "label string, word string")
    got = sorted((r.id, r.label) for r in words.label_rows(df, "text", labels, "other", at_once=at_once).collect())
    assert got == [(1, "five"), (1, "s"), (2, "other"), (3, "other"), (3, "other"), (4, "combo"), (4, "s")]


@pytest.mark.parametrize("at_once", [1 << 21, 1 << 10])
def test_many_words(spark, at_once):
    """100,000 words: the plan stays as it is for one word."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(100_000)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(300)]
    df, listed = spark.createDataFrame(texts, "id long, text string"), table(spark, vocabulary, "word").repartition(4)
    held = words.held_words(df, ["text"], listed, at_once=at_once)
    due, distinct = {}, set(vocabulary)
    for i, t in texts:
        due[i] = sorted({t[a : a + k] for k in range(3, 10) for a in range(len(t) - k + 1)} & distinct)
    assert {r.id: r.held for r in held.collect()} == due
    one = words.held_words(df, ["text"], table(spark, ["a"], "word"))
    if at_once > 1 << 20:
        assert len(held._jdf.queryExecution().optimizedPlan().toString()) == pytest.approx(len(one._jdf.queryExecution().optimizedPlan().toString()), abs=100)


def test_forbidden_words_of_a_long_sequence(spark):
    df = spark.createDataFrame([(1, "x w7 y"), (2, None), (3, "w33")], "k long, t string")
    found = contracts.expect_absent(df, ["t"], [f"w{i}" for i in range(40)], "d", ["k"]).collect()
    assert sorted((r.key, r.detail) for r in found) == [("1", "w7"), ("3", "w3"), ("3", "w33")]
