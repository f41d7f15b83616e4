from __future__ import annotations

import datetime as dt
import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from refledger.operators import contracts, history, lines, mining, rules
from refledger.operators.prefix import block, numbered, running
from refledger.operators.search import search
from refledger.plans.ruleset import RULES

D = dt.date


def periods(spark, rows):
    return spark.createDataFrame(
        [(c, D.fromisoformat(a), D.fromisoformat(b), p, i) for i, (c, a, b, p) in enumerate(rows)],
        "code string, start_date date, end_date date, price_raw string, ord long",
    )


def test_asof_edges(spark):
    table = periods(spark, [("A", "2020-01-01", "2020-01-31", "1"), ("A", "2020-02-10", "9999-12-31", "2"), ("B", "2020-01-01", "2020-12-31", "3"), ("B", "2020-06-01", "2020-06-30", "4")])
    days = ["2019-12-31", "2020-01-01", "2020-01-31", "2020-02-01", "2020-02-09", "2020-02-10", "2500-01-01"]
    asks = [("A", D.fromisoformat(d)) for d in days] + [("B", D(2020, 5, 31)), ("B", D(2020, 6, 1)), ("B", D(2020, 6, 30)), ("B", D(2020, 7, 1)), ("C", D(2020, 1, 1))]
    got = history.asof_one(spark.createDataFrame(asks, "code string, d date"), table, "code", "d", ["price_raw"]).collect()
    assert {(r.code, r.d.isoformat(), r.price_raw) for r in got} == {
        ("A", "2020-01-01", "1"), ("A", "2020-01-31", "1"), ("A", "2020-02-10", "2"), ("A", "2500-01-01", "2"), ("B", "2020-05-31", "3"), ("B", "2020-07-01", "3"),
    }


def test_asof_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(5)
    day = lambda: D(2020, 1, 1) + dt.timedelta(rnd.randrange(60))
    rows = []
    for i in range(300):
        a, b = sorted((day(), day()))
        rows.append((rnd.choice("HHHHAB"), a, b, str(i), i))
    asks = [(rnd.choice("HAB"), day()) for _ in range(200)]
    df = spark.createDataFrame(rows, "code string, start_date date, end_date date, price_raw string, ord long")
    got = history.asof_one(spark.createDataFrame(asks, "code string, d date"), df, "code", "d", ["price_raw"]).collect()
    due = []
    for c, d in asks:
        cover = [p for k, a, b, p, _ in rows if k == c and a <= d <= b]
        if len(cover) == 1:
            due.append((c, d, cover[0]))
    assert sorted((r.code, r.d, r.price_raw) for r in got) == sorted(due)


def test_nested_history(spark):
    df = periods(spark, [("A", "2020-01-01", "2020-01-31", "1"), ("A", "2020-01-31", "2020-02-09", "2")])
    nested = df.groupBy("code").agg(F.collect_list(F.struct("start_date", "end_date", "price_raw")).alias("h"))
    row = nested.select(
        history.covering_one(F.col("h"), F.lit(D(2020, 1, 30))).alias("a"), history.covering_one(F.col("h"), F.lit(D(2020, 1, 31))).alias("b")
    ).first()
    assert row.a.price_raw == "1" and row.b is None


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_folds_across_chunks(spark, size):
    """One group holds most rows; blocks of every size give the plain result."""
    rnd = random.Random(size)
    rows = [(rnd.choice("HHHHx"), i, rnd.choice([None, rnd.randrange(100)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    folds = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}
    got = {r.i: r for r in running(df, ["k"], ["i"], block("i", size), folds).collect()}
    lag = {r.i: r.p for r in running(df, ["k"], ["i"], block("i", size), {"p": ("last", F.struct("i"))}, inclusive=False).collect()}
    lead = {r.i: r.p for r in running(df, ["k"], ["i"], block("i", size), {"p": ("last", F.struct("i"))}, inclusive=False, reverse=True).collect()}
    nth = {r.i: r.n for r in numbered(df, ["k"], ["i"], block("i", size), "n").collect()}
    for key in "Hx":
        group = [r for r in rows if r[0] == key]
        for n, (_, i, _) in enumerate(group):
            given = [v for _, _, v in group[: n + 1] if v is not None]
            assert got[i].s == sum(given) and got[i].m == (max(given) if given else None)
            assert got[i].l == (given[-1] if given else None) and nth[i] == n + 1
            assert (lag[i] and lag[i].i) == (group[n - 1][1] if n else None)
            assert (lead[i] and lead[i].i) == (group[n + 1][1] if n + 1 < len(group) else None)


@pytest.mark.parametrize("phrase", [False, True])
def test_search_against_brute_force(spark, phrase):
    rnd = random.Random(3)
    words = ["ab", "abc", "bca", "c", "cab", "abcab", "é", "éa", "zz"]
    texts = [" ".join(rnd.choices(words, k=3)) + "\n" + rnd.choice(words) for _ in range(60)] + ["abc abc\nabc"] * 20
    queries = [" ".join(rnd.choices(words + ["qqq", "a"], k=rnd.randrange(0, 3))) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, hay string")
    got = search(spark.createDataFrame([(q,) for q in queries], "q string"), "q", items, "hay", phrase=phrase).collect()
    due = set()
    for q in queries:
        terms = [q] if phrase else q.split()
        due |= {(q, i) for i, t in enumerate(texts) if q and all(w in t for w in terms)}
    assert sorted((r.q, r.id) for r in got) == sorted(due)


def mined(spark, line):
    df = spark.createDataFrame([(line, "2026-08-06", "2026-09-01")], "line string, today string, ann string")
    return mining.mine(df, "line", "today", "ann").first()


@pytest.mark.parametrize(
    "line, search_text, facets, dose, flt, day",
    [
        ("atorvastatin 40mg 這次調價的", "atorvastatin", ["40mg", "這次調價", "的"], "40mg", "priceChanged", None),
        ("未調價 x", "x", ["未調價"], None, "priceUnchanged", None),
        ("x 115/9/1", "x", ["115/9/1"], None, None, "2026-09-01"),
        ("x 9/1 y", "x y", ["9/1"], None, None, "2026-09-01"),
        ("a 10/20mg", "a 10/", ["20mg"], "20mg", None, None),
        ("2026-02-30 x", "2026-02-30 x", [], None, None, None),
        ("x 444.4 mg/g today", "x", ["444.4 mg/g", "today"], "444.4mg/g", None, "2026-08-06"),
        ("x 新制 2026-08-01", "x", ["新制", "2026-08-01"], None, None, "2026-08-01"),
        ("20毫克 x 5 公克", "x", ["20毫克", "5 公克"], "5g", None, None),
        ("plain words", "plain words", [], None, None, None),
        ("", "", [], None, None, None),
    ],
)
def test_mining(spark, line, search_text, facets, dose, flt, day):
    r = mined(spark, line)
    assert r.search_text == search_text
    assert [s.raw for s in r.spans] == facets
    assert all(line[s.start : s.end] == s.raw for s in r.spans)
    assert (r.dose_key, r["filter"], r.mined_as_of) == (dose, flt, day)


def brute(answers, measure):
    """The rule set of `ruleset`, evaluated directly."""
    get = answers.get
    any_ = lambda vs: True if True in vs else None if None in vs else False
    all_ = lambda vs: False if False in vs else None if None in vs else True
    own, twin = get(("criterion", "a-3")), get(("prerequisite", "a-1"))
    fact = twin if own is None else own if twin is None or own == twin else None
    crit = {c.criterion_id: get(("criterion", c.criterion_id)) for c in RULES.criteria}
    crit["a-3"], crit["c-2"] = fact, None if measure is None else measure >= 200
    pre = {"a-1": fact, "a-2": get(("prerequisite", "a-2"))}
    possible, missing = [], []
    for tier in RULES.criterion_tiers:
        truths, asked = [], []
        for gid, members in RULES.groups(tier).items():
            p = True if gid is None else pre[gid]
            vs = [crit[m.criterion_id] for m in members]
            g = all_([p, any_(vs)])
            truths.append(g)
            if g is None:
                asked += [gid] if gid is not None and p is None else []
                asked += [] if p is False else [m.criterion_id for m, v in zip(members, vs) if v is None]
        t = any_(truths)
        if t is True:
            return ("determined", tier, None, None) if not possible else ("undetermined", None, [*possible, tier], missing)
        if t is None:
            possible.append(tier)
            missing += asked
    f = {x.factor_id: get(("factor", x.factor_id)) for x in RULES.factors}
    parts = [f["f-4-1"], f["f-4-2"], f["f-4-3"]]
    f["f-4"] = True if parts.count(True) >= 2 else False if parts.count(True) + parts.count(None) < 2 else None
    top = [f[i] for i in ("f-1", "f-2", "f-3", "f-4")]
    name = lambda n: "many" if n >= 2 else "one" if n == 1 else "none"
    lo, hi = name(top.count(True)), name(top.count(True) + top.count(None))
    if not possible and lo == hi:
        return "determined", lo, None, None
    for i in ("f-1", "f-2", "f-3", "f-4"):
        if f[i] is None:
            missing += [i] if i != "f-4" else [p for p in ("f-4-1", "f-4-2", "f-4-3") if f[p] is None]
    order = {t.tier_id: t.order for t in RULES.tiers}
    reach = set(possible) | {t for t in order if order[hi] <= order[t] <= order[lo]}
    return "undetermined", None, [t.tier_id for t in RULES.tiers if t.tier_id in reach], missing


def test_stratify_against_brute_force(spark):
    rnd = random.Random(11)
    subjects, log, due = [], [], {}
    for s in range(400):
        # Mostly "no", so that every path down to the factor count is taken.
        p_unknown, p_yes = rnd.choice([(0, 0.1), (0.1, 0.1), (0.4, 0.3), (1, 0)])
        given = {k: rnd.random() < p_yes for k in RULES.ids() if rnd.random() >= p_unknown and k != ("factor", "f-4")}
        measure = rnd.choice([None, 100.0, 100.0, 100.0, 250.0])
        subjects.append((s, measure))
        log += [(s, kind, i, v) for (kind, i), v in given.items()]
        due[s] = brute(given, measure)
    sheet = rules.answer_sheet(
        spark.createDataFrame(subjects, "s int, measure double"), spark.createDataFrame(log, "s int, kind string, id string, answer boolean"), RULES, ["s"]
    )
    got = rules.stratify(sheet, RULES, ["s"]).collect()
    assert len(got) == 400 and len({due[s][:2] for s in due}) >= 7
    for r in got:
        missing = None if r.missing is None else [q.id for q in r.missing]
        assert (r.status, r.tier_id, r.possible, missing) == due[r.s], r


def test_latest_answers_withdraw(spark):
    log = spark.createDataFrame([(1, "criterion", "x", True, 1), (1, "criterion", "x", None, 2), (1, "criterion", "y", False, 1), (1, "criterion", "y", True, 3)], "s int, kind string, id string, answer boolean, ts int")
    got = rules.latest_answers(log, ["s"]).collect()
    assert [(r.id, r.answer) for r in got] == [("y", True)]


def test_each_contract_reports_its_breach(spark):
    df = spark.createDataFrame(
        [(1, "a", "p", None, 1, "x", ["l"], True), (2, "a", "q", "h", 3, "", [], None), (3, "b", "r", "h", 3, "bad", ["bad"], False)],
        "id int, k string, t string, h string, n int, s string, arr array<string>, flag boolean",
    )
    checks = [
        contracts.expect_count(df, 2, "d"),
        contracts.expect_valid(df, {"s": F.col("s") != "bad"}, "d", ["id"]),
        contracts.expect_invariant(df, "k", ["t"], "d", "id"),
        contracts.expect_cardinality(df, ["t"], 2, "d"),
        contracts.expect_contiguous(df, ["k"], "id", "n", "d"),
        contracts.expect_unique(df, ["k"], "d"),
        contracts.expect_ref(df, df.select(F.col("id").alias("p")), "n", "p", "d").unionByName(contracts.expect_ref(df.where("id = 1"), df.where("id = 2"), "id", "id", "d")),
        contracts.expect_parent_first(df, "id", "n", "id", "d"),
        contracts.expect_one_owner(df, "k", "t", "d"),
        contracts.expect_children(df, df, "id", "n", "d"),
        contracts.expect_enough(df, df.select(F.col("n").alias("c")), "id", "c", "n", "d"),
        contracts.expect_null_together(df, "h", "flag", "d", ["id"]),
        contracts.expect_same_text(df, "h", "t", "d"),
        contracts.expect_nonempty(df, ["s", "arr"], "d", ["id"]),
        contracts.expect_absent(df, ["s"], ["ba"], "d", ["id"]),
        contracts.expect_framed(df, F.lit("b"), "d", "s", "d", ["id"]),
        contracts.expect_verbatim(df, "s", "arr", "d", ["id"]),
        contracts.expect_partition(df, "flag", "d"),
    ]
    found = {}
    for r in contracts.all_of_checks(checks).collect():
        found.setdefault(r.check_id, set()).add((r.key, r.detail))
    assert found["count"] == {("", "3")}
    assert found["valid"] == {("3", "s")}
    assert found["invariant"] == {("a", "rows 1 and 2 differ in t")}
    assert found["cardinality"] == {("t", "3")}
    assert found["contiguous"] == {("a|2", "place 2 carries 3"), ("b|3", "place 1 carries 3")}
    assert found["unique"] == {("a", "2")}
    assert found["reference"] == {("1", "unknown")}
    assert found["parent_first"] == {("1", "1"), ("2", "3"), ("3", "3")}
    assert found["one_owner"] == {("a", "p q")}
    assert found["children"] == {("2", "none")}
    assert found["enough"] == {("2", "0 of 3"), ("3", "2 of 3")}
    assert found["null_together"] == {("1", "flag without h"), ("2", "h without flag")}
    assert found["same_text"] == {("h", "texts differ")}
    assert found["nonempty"] == {("2", "s"), ("2", "arr")}
    assert found["absent"] == {("3", "ba")}
    assert found["framed"] == {("1", "head"), ("1", "tail"), ("2", "head"), ("2", "tail")}
    assert found["verbatim"] == {("1", "differs from its lines")}
    assert found["partition"] == {("flag", "1")}
    with pytest.raises(ValueError):
        contracts.stop_on_any(checks[0])
    contracts.stop_on_any(contracts.expect_count(df, 3, "d"))


def test_overlaps_see_past_the_neighbour(spark):
    df = periods(spark, [("A", "2019-01-01", "2021-12-31", "1"), ("A", "2019-02-01", "2019-02-02", "2"), ("A", "2020-05-01", "2020-05-02", "3"), ("A", "2022-01-01", "9999-12-31", "4")])
    assert sorted((r.ord, r.earlier_ord) for r in history.overlaps(df, "code").collect()) == [(1, 0), (2, 0)]


def test_orphans(spark):
    df = spark.createDataFrame([(1, 1, "ab 1.73m"), (1, 2, "   2"), (1, 3, "xy m at"), (1, 4, "     7"), (1, 5, "long enough line"), (1, 6, " 3")], "doc int, ord int, line string")
    fixed, lost = lines.reinsert_orphans(df, ["doc"])
    assert [r.line for r in fixed.orderBy("ord").collect()] == ["ab 1.73m", "xy ²m at", "long enough line"]
    assert sorted(r.ord for r in lost.collect()) == [4, 6]


def test_streaming_mining_equals_batch(spark, tmp_path):
    """Mining is row-local, so it runs unchanged on a stream."""
    rows = [(i, f"name {i} 20 mg 115/9/{1 + i % 9} repriced", "2026-08-06", "2026-09-01") for i in range(50)]
    schema = "i int, line string, today string, ann string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    out = lambda df: mining.mine(df, "line", "today", "ann").select("i", "search_text", "dose_key", "filter", "mined_as_of")
    stream = out(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = out(spark.read.parquet(str(tmp_path / "in"))).collect()
    assert sorted(spark.table("mined").collect()) == sorted(batch)


def test_unfired_exceptions(spark):
    df = spark.createDataFrame([(["a b", "c d"],), (["x"],)], "lines array<string>")
    assert [tuple(r) for r in lines.unfired(df, [("b", "c"), ("x", "y")]).collect()] == [("x", "y")]


def test_union_of_checks_keeps_shape(spark):
    df = spark.range(3)
    both = reduce(lambda a, b: a.unionByName(b), [contracts.expect_count(df, 1, "a"), contracts.expect_count(df, 3, "b")])
    assert [r.dataset for r in both.collect()] == ["a"]


def test_cardinality_by_sketches(spark):
    """Columns at, near and far from the bound; a clear one is not read at all."""
    rows = spark.range(3000).selectExpr("id % 7 AS part", "id % 500 AS at_bound", "id % 501 AS over", "id % 490 AS near", "id % 50 AS far", "CAST(NULL AS STRING) AS none", "id AS wide")
    cols = ["at_bound", "over", "near", "far", "none", "wide"]
    kept = contracts.column_sketches(rows, cols, ["part"])
    assert kept.count() == 7 * len(cols)
    assert set(contracts.far_below(kept, 500)) == {"far", "none"}
    found = contracts.expect_cardinality(rows, cols, 500, "d", kept)
    assert sorted((r.key, r.detail) for r in found.collect()) == [("over", "501"), ("wide", "3000")]
    assert "far" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(contracts.expect_cardinality(rows, cols, 500, "d").collect()) == sorted(found.collect())
    assert contracts.expect_cardinality(rows, ["far"], 500, "d", kept).collect() == []


def test_a_suite_in_one_pass(spark, tmp_path):
    """The rows of the single checks, from one scan of each table."""
    rng = random.Random(8)
    child = [(rng.choice([None, *range(12)]), rng.choice([None, 1, 1, 2]), rng.choice([None, "x", "y"])) for _ in range(200)]
    spark.createDataFrame(child, "k long, m long, v string").write.parquet(str(tmp_path / "child"))
    spark.createDataFrame([(i,) for i in [*range(5, 20), 7, 7, None]], "p long").write.parquet(str(tmp_path / "parent"))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in ("child", "parent")}
    check = contracts.KeyCheck
    checks = [
        check("unique", "c", "child", ["k", "m"]), check("ref", "c", "child", ["k"], "parent", ["p"]),
        check("children", "p", "parent", ["p"], "child", ["k"]), check("same_text", "c", "child", ["m"], value="v"),
    ]
    found = contracts.keyed_suite(tables, checks)
    single = contracts.all_of_checks(
        [
            contracts.expect_unique(tables["child"], ["k", "m"], "c"), contracts.expect_ref(tables["child"], tables["parent"], "k", "p", "c"),
            contracts.expect_children(tables["parent"], tables["child"], "p", "k", "p"), contracts.expect_same_text(tables["child"], "m", "v", "c"),
        ]
    )
    told = lambda df: sorted(map(str, df.select("check_id", "dataset", "key", "detail").collect()))
    assert told(found) == told(single) and len(told(found)) > 20
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
