"""Rule sets on bit planes beside the same rules as columns, and beside a plain version for ten thousand criteria."""

from __future__ import annotations

import random

import pytest

from refledger.operators import bitrules, rules
from refledger.operators.rules import Criterion, Factor, RuleSet, Tier
from refledger.plans.ruleset import RULES


def rule_set(rng, n_criteria, n_factors):
    tiers = [Tier(f"t{i}", i + 1, f"tier {i}", f"rule {i}") for i in range(6)]
    criteria = []
    for n in range(n_criteria):
        tier = f"t{rng.randint(0, 2)}"
        group = rng.choice([None, *(f"{tier}-g{i}" for i in range(1 + n_criteria // 20))])
        text = rng.choice([f"text {n}", f"label {tier}-g0。", "label t1-g0。"])
        criteria.append(Criterion(f"c{n}", tier, group, f"heading {group}" if group else None, f"label {group}" if group else None, text))
    factors = [Factor(f"f{n}", f"factor {n}") for n in range(n_factors)]
    factors += [Factor("fp", "of parts", None, 2)] + [Factor(f"fp{i}", f"part {i}", "fp") for i in range(3)]
    breaks = ((3, "t3"), (1, "t4"), (0, "t5"))
    return RuleSet(tiers, criteria, factors, ("t0", "t1", "t2"), ("c3", 10.0) if n_criteria > 3 else None, breaks)


def answers_of(rng, ruleset, subjects, share):
    weight = rng.choice([0.1, 0.5])
    return [(s, k, i, rng.random() < weight) for s in subjects for k, i in ruleset.ids() if rng.random() < share]


@pytest.mark.parametrize("seed", range(4))
def test_same_rows_as_columns(spark, seed):
    rng = random.Random(seed)
    ruleset = RULES if seed == 0 else rule_set(rng, (0, 5, 30, 70)[seed], 3)
    subjects = [(i, rng.choice([None, float("nan"), float("inf"), 5.0, 10.0, 300.0])) for i in range(150)]
    rows = [x for share in (0.0, 0.4, 0.9, 1.0) for x in answers_of(rng, ruleset, [s for s, _ in subjects if s % 4 == int(share * 3.4)], share)]
    people = spark.createDataFrame(subjects, "s long, measure double")
    answers = spark.createDataFrame([*rows, (1, "criterion", "no such id", True)], "s long, kind string, id string, answer boolean")
    due = rules.stratify(rules.answer_sheet(people, answers, ruleset, ["s"]), ruleset, ["s"]) if ruleset.criteria else None
    got = bitrules.stratify(people, answers, ruleset, ["s"])
    if due is None:
        assert {r.path for r in got.collect()} <= {"count", "open"}
        return
    assert got.columns == due.columns
    plain = lambda df: {r.s: r.asDict(recursive=True) for r in df.collect()}
    a, b = plain(got), plain(due)
    assert a == b and len({r["path"] for r in a.values()}) > 1


def kleene_any(values):
    return True if True in values else None if None in values else False


def test_ten_thousand_criteria(spark):
    """Tiers and reasons beside a plain version; the plan is the one of the small set."""
    rng = random.Random(11)
    criteria = [Criterion(f"c{n}", f"t{n % 3}", f"t{n % 3}-g{n % 1500}", f"h{n % 1500}", f"p{n % 1500}", f"text {n}") for n in range(10_000)]
    tiers = [Tier(f"t{i}", i + 1, f"tier {i}") for i in range(4)]
    ruleset = RuleSet(tiers, criteria, [], ("t0", "t1", "t2"), None, ((0, "t3"),))
    answers = []
    for s in range(60):
        for k, i in ruleset.ids():
            if s < 50 and rng.random() < (1.0 if s % 2 else 0.9):
                yes = rng.random() < (0.0 if k == "criterion" and s % 3 == 0 else 0.0004) if k == "criterion" else rng.random() < 0.5
                answers.append((s, k, i, yes))
    people = spark.createDataFrame([(s,) for s in range(60)], "s long")
    got = bitrules.stratify(people, spark.createDataFrame(answers, "s long, kind string, id string, answer boolean"), ruleset, ["s"])
    by = {}
    for s, k, i, a in answers:
        by.setdefault(s, {})[k, i] = a
    paths = set()
    for r in got.collect():
        own = by.get(r.s, {})
        truths, reason = [], None
        for t in ruleset.criterion_tiers:
            groups = {}
            for c in criteria:
                if c.tier_id == t:
                    groups.setdefault(c.group_id, []).append(c)
            found = []
            for g, members in groups.items():
                any_ = kleene_any([own.get(("criterion", m.criterion_id)) for m in members])
                need = own.get(("prerequisite", g))
                found.append(False if need is False or any_ is False else True if need and any_ else None)
                if reason is None and found[-1]:
                    reason = next(m.criterion_id for m in members if own.get(("criterion", m.criterion_id)))
            truths.append(kleene_any(found))
        if True in truths:
            path = "criterion" if None not in truths[: truths.index(True)] else "blocked"
        else:
            path = "count" if None not in truths else "open"
        assert r.path == path
        paths.add(path)
        if path == "criterion":
            assert r.tier_id == f"t{truths.index(True)}" and r.reason.criterion_id == reason
    assert {"criterion", "count", "open"} <= paths
    small = bitrules.stratify(people, spark.createDataFrame([], "s long, kind string, id string, answer boolean"), RULES, ["s"])
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(got) < 1.2 * size(small)
