from __future__ import annotations

import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from refledger.functions import dates, mentions, numbers, text, truth


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, due",
    [("2026-02-30", None), ("2026-02-29", None), ("2024-02-29", "2024-02-29"), ("10000-01-01", None), ("", None), ("2024-2-9", None)],
)
def test_strict_date(spark, raw, due):
    got = one(spark, raw, dates.strict_date)
    assert (got and got.isoformat()) == due


@pytest.mark.parametrize(
    "raw, due",
    [("  991231", "2010-12-31"), ("1000101", "2011-01-01"), ("1130229", "2024-02-29"), ("9991231", "9999-12-31"), ("1120229", None), ("99123", None)],
)
def test_era_packed_date(spark, raw, due):
    got = one(spark, raw, dates.era_packed_date)
    assert (got and got.isoformat()) == due


def test_era_date_and_month_day(spark):
    assert one(spark, "115/9/1", dates.era_date).isoformat() == "2026-09-01"
    assert one(spark, "115/13/1", dates.era_date) is None
    assert one(spark, "9/1", lambda c: dates.month_day(c, F.lit("2026-08-06"))).isoformat() == "2026-09-01"
    assert one(spark, "2/30", lambda c: dates.month_day(c, F.lit("2026-08-06"))) is None


def test_nfkc_equals_python(spark):
    texts = ["ＡＢ１２－３　x", "①ﬁ㎎", "é", "plain", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(text.nfkc(F.col("v")).alias("r")).collect()
    assert [r.r for r in rows] == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_code_and_name(spark):
    assert one(spark, " ａc-12　34 ", text.norm_code) == "AC1234"
    assert one(spark, " Big \t Name　", text.norm_name) == "big name"


@pytest.mark.parametrize(
    "raw, mode, due",
    [
        ("x 20 mg y", "reference", "x 20mg y"), ("20 mgs", "reference", "20 mgs"), ("20 毫克", "reference", "20 毫克"),
        ("20 毫克", "unicode", "20毫克"), ("20 毫克a", "reference", "20毫克a"), ("20 mcg,5 g", "reference", "20mcg,5g"),
    ],
)
def test_close_gap(spark, raw, mode, due):
    assert one(spark, raw, lambda c: text.close_gap(c, mode)) == due


@pytest.mark.parametrize("raw, due", [("0.00", True), (" 0.00 ", True), ("-", False), ("1.00", False), ("0", True), ("1e-400", True)])
def test_is_zero(spark, raw, due):
    assert one(spark, raw, numbers.is_zero) is due


@pytest.mark.parametrize(
    "raw, due",
    [
        ("A 20.00 MG", ["20mg"]), ("20mg and 20 mg", ["20mg"]), ("444.4 MG/GM", ["444.4mg/g"]), ("4 GM", ["4g"]),
        ("10 Tablets", []), ("5 mgx", []), ("0.50 iu / 3 %", ["0.5IU", "3%"]), ("6.94 MG+10.85 MG", ["6.94mg", "10.85mg"]), ("100 MG", ["100mg"]),
    ],
)
def test_mentions(spark, raw, due):
    assert one(spark, raw, lambda c: mentions.mentions(c).getField("key")) == due


def test_rejoin(spark):
    def joined(lines, exceptions=()):
        df = spark.createDataFrame([(lines,)], "v array<string>")
        return df.select(text.rejoin(F.col("v"), exceptions).alias("r")).first().r

    assert joined(["ATP citrate", "lyase"]) == "ATP citrate lyase"
    assert joined(["包含：", "ezetimibe"]) == "包含：ezetimibe"
    assert joined(["non-", "statin"]) == "non-statin"
    assert joined(["合併", "ezetimibe", "治療"]) == "合併 ezetimibe 治療"
    assert joined(["單一6-8", "週未達"], [("6-8", "週未達")]) == "單一6-8週未達"
    assert joined(["one"]) == "one"


def test_ordinals_and_numerals(spark):
    assert tuple(one(spark, "(一) body", text.split_ordinal)) == ("(一)", "body")
    assert one(spark, "body", text.split_ordinal) is None
    assert one(spark, "三", text.numeral) == 3 and one(spark, "百", text.numeral) is None
    assert one(spark, "符合以下至少三項：", text.required_count) == 3 and one(spark, "other", text.required_count) is None
    assert one(spark, "LDL-C≧190mg/dL", lambda c: text.threshold(c, r"≧(\d+)mg/dL$")) == 190
    assert one(spark, "pre 一、a 二、b", text.split_steps) == ["pre", "一、a", "二、b"]


def kleene_any(vs):
    return True if True in vs else None if None in vs else False


def kleene_all(vs):
    return False if False in vs else None if None in vs else True


def test_truth_tables(spark):
    triples = list(itertools.product([True, False, None], repeat=3))
    rows = [(i, v) for i, t in enumerate(triples) for v in t]
    got = spark.createDataFrame(rows, "i int, v boolean").groupBy("i").agg(
        truth.any_of(F.col("v")).alias("any"), truth.all_of(F.col("v")).alias("all"), truth.k_of_n(F.col("v"), 2).alias("two")
    ).collect()
    for r in got:
        vs = triples[r.i]
        yes, unknown = vs.count(True), vs.count(None)
        assert r["any"] is kleene_any(vs) and r["all"] is kleene_all(vs)
        assert r.two is (True if yes >= 2 else False if yes + unknown < 2 else None)


def test_same_fact(spark):
    pairs = list(itertools.product([True, False, None], repeat=2))
    rows = spark.createDataFrame(pairs, "a boolean, b boolean").select("a", "b", truth.same_fact(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        due = r.b if r.a is None else r.a if r.b is None or r.a == r.b else None
        assert r.r is due


def test_at_least_ignores_nan(spark):
    assert one(spark, float("nan"), lambda c: numbers.at_least(c, 190), "double") is None
    assert one(spark, float("inf"), lambda c: numbers.at_least(c, 190), "double") is None
    assert one(spark, 190.0, lambda c: numbers.at_least(c, 190), "double") is True
