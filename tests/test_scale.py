"""Steps whose work must grow no faster than their input."""

from __future__ import annotations

import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta
from unicodedata import normalize

import pytest

from pyspark.sql import functions as F

from refledger.functions import text
from refledger.operators import bitrules, contracts, facets, history, lines, mining
from refledger.operators.rules import RuleSet
from refledger.plans.q_facets import _listing
from refledger.plans.q_lines import MARKERS, PAGE, SUFFIXES, TIERS, k12_bare, k12_violations, markers
from refledger.plans.registry import Tables
from refledger.sources import publish, scans
from tests.test_bitrules import answers_of, rule_set

SF = "/root/testdata/sf0.001"



@pytest.mark.parametrize("exceptions", [(), (("x.", "The"),)])
def test_long_texts_are_joined_in_linear_time(spark, exceptions):
    n = 12_000
    rows = spark.createDataFrame([("\n".join(["word x.", "The end-", "", "more"] * (n // 4)),)], "text string")
    start = time.monotonic()
    (got,) = rows.select(text.rejoin(F.split("text", "\n"), exceptions)).first()
    assert time.monotonic() - start < 15
    seam = "" if exceptions else " "
    assert got.startswith(f"word x.{seam}The end-more word x.{seam}The end-more")


def test_fold_of_many_texts_at_once(spark):
    told = [None if i % 5 == 0 else f"ﬁ{i}Å" * 3 for i in range(text.FOLDED_AT_ONCE * 3 + 1)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i int, t string").coalesce(1)
    got = {r.i: r.n for r in rows.select("i", text.nfkc(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else normalize("NFKC", t) for i, t in enumerate(told)}


def test_rule_lines_are_shuffled_once(spark):
    """Each kind of row comes from lines dealt out by document, with no other shuffle of lines or items."""
    t = Tables(spark, "/root/testdata/sf0.1")
    built = lines.lines_to_rules(t["rule_lines"], "doc", markers(), TIERS, SUFFIXES, PAGE)
    for df in (built.tiers, built.criteria, built.factors):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x), plan


def test_long_documents_are_folded_in_blocks(spark):
    """A document of several blocks of lines gives the rows of the same document in one block."""
    t = Tables(spark, SF)
    some = t["rule_lines"].where("doc % 50 = 0")
    far = some.withColumn("ord", (F.col("ord") * 100_000).cast("bigint"))
    near = lines.lines_to_rules(some, "doc", markers(), TIERS, SUFFIXES, PAGE)
    wide = lines.lines_to_rules(far, "doc", markers(), TIERS, SUFFIXES, PAGE)
    for a, b, unit in zip(near, wide, (100_000,) * 4):
        plain = lambda df, by: sorted(str({**r.asDict(), "ord": None if r.ord is None else r.ord * by}) for r in df.collect())
        assert plain(a, unit) == plain(b, 1)
    assert len(MARKERS) == 3 and near.criteria.count() > 0


def test_periods_are_dealt_out_before_they_are_added_up(spark):
    for name in ("ship_days", "listed"):
        plan = Tables(spark, SF)[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") < plan.index("RepartitionByExpression"), plan


def test_other_content_is_told_by_its_size(spark, tmp_path, monkeypatch):
    rows = spark.range(5).toDF("a")
    assert publish.publish(rows, str(tmp_path), "v1") == "written"
    assert publish.publish(rows, str(tmp_path), "v1") == "unchanged"
    with pytest.raises(ValueError):
        publish.publish(rows.withColumn("a", F.col("a") + 1), str(tmp_path), "v1")
    monkeypatch.setattr(publish, "drift", lambda *_: pytest.fail("whole rows are compared"))
    with pytest.raises(ValueError):
        publish.publish(rows.where("a > 0"), str(tmp_path), "v1")


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "part-0").write_text(str(i))
    name = F.regexp_extract("path", "part=([0-9]+)/", 1)
    found = scans.streamed_fingerprint(spark, str(tmp_path), name=name, nested=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert f", {4 * spark.sparkContext.defaultParallelism}" in plan[plan.index("RepartitionByExpression") :].split("\n")[0]
    due = scans.fingerprint(spark, f"{tmp_path}/part=*/part-*", name=name)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, due.collect()))
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") != str(scans.LISTERS)


def test_shared_facets(spark):
    counts = spark.createDataFrame([("q", "5mg", "5 mg", 3), ("q", "6mg", "6 mg", 1)], "q string, key string, label string, n long")
    asks = spark.createDataFrame([("q", "5mg"), ("q", "7mg"), ("q", "")], "q string, dose string")
    chosen = asks.where("dose <> ''").withColumns({"key": F.col("dose"), "label": F.lit("?")})
    got = facets.facet_options(counts, chosen, ["q", "dose"], asks, ["q"])
    due = {("q", d, k, n) for d in ("5mg", "7mg", "") for k, n in (("5mg", 3), ("6mg", 1))} | {("q", "7mg", "7mg", 0)}
    assert {(r.q, r.dose, r.key, r.n) for r in got.collect()} == due


def tables_of(spark, ruleset: RuleSet) -> bitrules.RuleTables:
    def table(rows, ddl):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, " + ddl)

    return bitrules.rule_tables(
        table(ruleset.tiers, "tier_id string, `order` int, label string, count_rule string"),
        table(ruleset.criteria, "criterion_id string, tier_id string, group_id string, heading string, prerequisite string, text string"),
        table(ruleset.factors, "factor_id string, text string, parent_id string, required int"),
        criterion_tiers=ruleset.criterion_tiers, measure=ruleset.measure, breaks=ruleset.breaks,
    )


@pytest.mark.parametrize("seed", range(4))
def test_standing_counts_what_stratify_lists(spark, seed):
    rng = random.Random(seed)
    ruleset = rule_set(rng, (0, 5, 30, 70)[seed], 3)
    subjects = [(i, rng.choice([None, float("nan"), float("inf"), 5.0, 10.0])) for i in range(120)] + [(1, 5.0), (None, 10.0)]
    rows = [x for share in (0.0, 0.4, 0.9, 1.0) for x in answers_of(rng, ruleset, [s for s in range(120) if s % 4 == int(share * 3.4)], share)]
    people = spark.createDataFrame(subjects, "s long, measure double")
    answers = spark.createDataFrame([*rows, (1, "criterion", "no such id", True)], "s long, kind string, id string, answer boolean")
    due = bitrules.stratify(people, answers, ruleset, ["s"]).withColumn("n_missing", F.when(F.col("missing").isNotNull(), F.size("missing")).cast("bigint")).drop("missing")
    got = bitrules.standing(people, answers, tables_of(spark, ruleset), ["s"]).select(*due.columns)
    plain = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    assert plain(got) == plain(due)


def test_standing_of_many_rules(spark):
    """Rules beyond what may travel with a task, of which a subject knows few."""
    n = bitrules.MOST_RULES + 7
    criteria = spark.range(n).selectExpr("id AS ord", "'c' || id AS criterion_id", "'t' || id % 2 AS tier_id", "'g' || id % 10 AS group_id", "'h' AS heading", "'p' || id % 10 AS prerequisite", "'x' AS text")
    tiers = spark.createDataFrame([(i, t, i, t, None) for i, t in enumerate(("t0", "t1", "rest"))], "ord long, tier_id string, `order` int, label string, count_rule string")
    factors = spark.createDataFrame([], "ord long, factor_id string, text string, parent_id string, required int")
    rules = bitrules.rule_tables(tiers, criteria, factors, criterion_tiers=("t0", "t1"), measure=None, breaks=((0, "rest"),))
    told = [(1, "criterion", "c0", True), (1, "prerequisite", "g0", True), (2, "criterion", "c1", True), (2, "prerequisite", "g1", True), (2, "prerequisite", "g2", False)]
    got = {r.s: r for r in bitrules.standing(spark.range(1, 4).toDF("s"), spark.createDataFrame(told, "s long, kind string, id string, answer boolean"), rules, ["s"]).collect()}
    assert (got[1].path, got[1].tier_id, got[1].reason.criterion_id, got[1].n_missing) == ("criterion", "t0", "c0", None)
    in_g2 = len(range(2, n, 10))
    assert (got[2].path, got[2].possible, got[2].n_missing) == ("blocked", ["t0", "t1"], (n + 1) // 2 + 5 - in_g2 - 1)
    assert (got[3].path, got[3].n_missing) == ("open", n + 10)




def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]


def test_class_listing_is_dealt_out_before_it_is_added_up(spark):
    """Items of all classes and dates, and lines of all parts, are in parts that are not put together again."""
    t = Tables(spark, SF)
    listing = _listing(t)
    matches = _exchanges(listing.matches)
    assert [x for x in matches if "hashpartitioning(code" in x and "as_of_date" in x and "REPARTITION_BY_NUM" in x], matches
    for rows, key in ((listing.matches, "l_partkey"), (listing.counts, "l_partkey"), (listing.counts, "code")):
        assert [x for x in _exchanges(rows) if f"hashpartitioning({key}" in x and "REPARTITION_BY_NUM" in x], _exchanges(rows)


def test_checks_on_keys_are_dealt_out_by_key(spark):
    """Nearly unique keys are not added up within a split before they are shuffled, nor put together afterwards."""
    t = Tables(spark, SF)
    checks = [
        contracts.expect_unique(t["lineitem"], ["l_orderkey", "l_linenumber"], "lineitem"),
        contracts.expect_ref(t["lineitem"], t["part"], "l_partkey", "p_partkey", "lineitem"),
        contracts.expect_children(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey", "orders"),
        contracts.expect_same_text(t["orders"], "o_custkey", "o_orderstatus", "orders"),
    ]
    for check in checks:
        found = _exchanges(check)
        assert found and not [x for x in found if "ENSURE_REQUIREMENTS" in x], found


def test_each_row_as_often_as_it_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 7), (None, 6), ("d", 3)], "k string, n long")
    got = contracts._each(rows, "n", step=3).groupBy("k", "n").count().collect()
    assert {(r.k, r.n, r["count"]) for r in got} == {("a", 1, 1), ("b", 7, 7), (None, 6, 6), ("d", 3, 3)}


def test_references_are_reported_row_by_row(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,)], "k int")
    parent = spark.createDataFrame([(2,), (2,), (None,)], "p int")
    got = [r.key for r in contracts.expect_ref(child, parent, "k", "p", "c").collect()]
    assert sorted(map(str, got)) == ["1", "1", "3", "None", "None"]


def test_listing_threads_leave_the_setting_as_it_was(spark):
    name, inside = "spark.sql.sources.parallelPartitionDiscovery.parallelism", threading.Barrier(2)
    before = spark.conf.get(name)

    def listed(_):
        inside.wait()
        for _ in range(20):
            with scans._few_listers(spark):
                time.sleep(0.002)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(listed, range(2)))
    assert spark.conf.get(name) == before


def test_layout_violations_are_found_where_lines_lie(spark):
    """Lines are not written and read again, which put them all into as few tasks as their compressed size gives."""
    found = k12_violations(Tables(spark, SF))
    assert all("/testdata/" in path for path in found.inputFiles()), found.inputFiles()


def test_items_without_ordinal_come_from_one_reading(spark):
    """No join tells a line its document's first number: it comes with the line."""
    plan = k12_bare(Tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert all("l_partkey" in x for x in plan.split("\n") if "Join Inner" in x), plan


def test_lost_digits_of_one_block_and_of_several(spark):
    first, second, end = MARKERS
    texts = {
        1: [first, "一、Tier A：", "(二) flat item", "  2", "(一)abc", "   9", "(二) more", "       3", "x", "  2", second, "一、one", "3", end],
        2: [first, "2", second, "  3", end],
        3: [first, "(二) lost", second],
        4: ["2", "3", second, first, "一、Tier A：", "(二) a", "5", "2", "(二) b", second, "一、two", end, second, end],
        None: [first, "一、Tier A：", second, end],
    }
    for scale in (1, 70_000):
        rows = spark.createDataFrame([(d, i * scale, x) for d, held in texts.items() for i, x in enumerate(held)], "doc long, ord long, line string")
        built = lines.lines_to_rules(rows, "doc", markers(), TIERS, SUFFIXES, PAGE)
        got = [sorted(str({**r.asDict(), "ord": None if r.ord is None else r.ord // scale}) for r in df.collect()) for df in built]
        if scale == 1:
            near = got
    assert near == got
    assert sum("orphan digit" in x for x in near[3]) >= 5


def test_stretches_are_counted_as_of_dates(spark):
    rng = random.Random(5)
    day = lambda n: date(2000, 1, 1) + timedelta(n)
    spans = [(rng.choice("ab"), rng.choice([True, False, None]), (since := rng.randrange(40)), rng.choice([None, since + rng.randrange(1, 9)]), rng.randrange(1, 4)) for _ in range(60)]
    rows = [(q, c, day(a), None if b is None else day(b), n) for q, c, a, b, n in spans]
    stretches = spark.createDataFrame(rows, "q string, c boolean, from_day date, next_day date, n long")
    asks = spark.createDataFrame([(q, str(day(i)), day(i)) for q in "abz" for i in range(0, 50, 3)], "q string, as_of string, as_of_date date")
    got = {(r.q, r.as_of, r.c): r.n for r in history.counted_as_of(stretches, asks, "q", ["c"], "as_of").collect()}
    due = {}
    for q, c, a, b, n in spans:
        for i in range(0, 50, 3):
            if a <= i and (b is None or i < b):
                due[q, str(day(i)), c] = due.get((q, str(day(i)), c), 0) + n
    assert got == due and len(due) > 50


def test_detectors_without_hits_need_no_gaps(spark):
    rows = spark.createDataFrame([("bolt 5.50 MG 2000-01-02 x",), ("nothing here",), ("",), (None,)], "line string")
    found = mining.detect(rows.withColumns({"t": F.lit("2000-06-15"), "a": F.lit("2000-09-01")}), "line", "t", "a")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("CASE WHEN (size(__hit" in x for x in plan.split("\n") if "split(line" in x), plan
    assert [len(r.hits or []) for r in found.collect()] == [2, 0, 0, 0]
