"""Ordered rules with three-valued answers, evaluated over a population.

A rule set is a parameter of the job, like a schema. Answers are long rows;
one aggregate brings each subject's answers into one row (an absent answer is NULL, hence unknown, never
"no"), and all logic from there on is expressions within that row. So a population of any size costs
one shuffle, pre-aggregated on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.numbers import at_least
from refledger.functions.truth import (
    all_in_row,
    any_in_row,
    as_word,
    at_least_k,
    count_true,
    count_unknown,
    same_fact,
    tier_of_count,
)
from refledger.operators.stage import computed


class Tier(NamedTuple):
    tier_id: str
    order: int
    label: str
    count_rule: str | None = None


class Criterion(NamedTuple):
    criterion_id: str
    tier_id: str
    group_id: str | None
    heading: str | None
    prerequisite: str | None
    text: str


class Factor(NamedTuple):
    factor_id: str
    text: str
    parent_id: str | None = None
    required: int | None = None


class RuleSet(NamedTuple):
    """Tiers, in order; criteria and factors, in source order.

    `criterion_tiers` are tried first, in order. `measure` is (criterion id, limit): that criterion is read
    off the subject's measure. `breaks` maps a least number of factors to a tier.
    """

    tiers: Sequence[Tier]
    criteria: Sequence[Criterion]
    factors: Sequence[Factor]
    criterion_tiers: Sequence[str]
    measure: tuple[str, float] | None
    breaks: Sequence[tuple[int, str]]
    full_stop: str = "。"

    def groups(self, tier_id: str) -> dict[str | None, list[Criterion]]:
        out: dict[str | None, list[Criterion]] = {}
        for c in self.criteria:
            if c.tier_id == tier_id:
                out.setdefault(c.group_id, []).append(c)
        return out

    def prerequisites(self) -> dict[str, Criterion]:
        """First criterion of each group; it states the group's prerequisite."""
        out: dict[str, Criterion] = {}
        for c in self.criteria:
            if c.group_id is not None:
                out.setdefault(c.group_id, c)
        return out

    def aliases(self) -> dict[str, str]:
        """criterion id -> the other group whose prerequisite words the same fact."""
        by_label = {c.prerequisite: c.group_id for c in self.criteria if c.group_id and c.prerequisite}
        pairs = {c.criterion_id: by_label.get(c.text.removesuffix(self.full_stop)) for c in self.criteria}
        own = {c.criterion_id: c.group_id for c in self.criteria}
        return {cid: gid for cid, gid in pairs.items() if gid is not None and gid != own[cid]}

    def children(self, factor_id: str) -> list[Factor]:
        return [f for f in self.factors if f.parent_id == factor_id]

    def top_factors(self) -> list[Factor]:
        return [f for f in self.factors if f.parent_id is None]

    def ids(self) -> list[tuple[str, str]]:
        """All (kind, id) that an answer may name, in source order."""
        out = [("prerequisite", g) for g in self.prerequisites()]
        out += [("criterion", c.criterion_id) for c in self.criteria]
        return out + [("factor", f.factor_id) for f in self.factors]


def _answer(kind: str, id_: str) -> Column:
    return F.col(f"`{kind}:{id_}`")


def latest_answers(log: DataFrame, subject: Sequence[str], answer: str = "answer", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Last write per subject and id wins; a written NULL withdraws the answer."""
    last = F.max_by(F.struct(F.col(answer)), F.struct(*order)).alias("last")
    rows = log.groupBy(*subject, "kind", "id").agg(last)
    return rows.select(*subject, "kind", "id", f"last.{answer}").where(F.col(answer).isNotNull())


def answer_sheet(subjects: DataFrame, answers: DataFrame, rules: RuleSet, subject: Sequence[str]) -> DataFrame:
    """One row per subject with a nullable column per (kind, id). Answers to unknown ids are not read."""
    sheet = answers.groupBy(*subject).agg(
        *[
            F.bool_or(F.when((F.col("kind") == kind) & (F.col("id") == id_), F.col("answer"))).alias(f"{kind}:{id_}")
            for kind, id_ in rules.ids()
        ]
    )
    return subjects.join(sheet, list(subject), "left")


def answer_grid(sheet: DataFrame, rules: RuleSet, subject: Sequence[str]) -> DataFrame:
    """The same as rows: every subject with every id of the rule set."""
    cells = [
        F.struct(F.lit(k).alias("kind"), F.lit(i).alias("id"), _answer(k, i).alias("answer")) for k, i in rules.ids()
    ]
    return sheet.select(*subject, F.inline(F.array(*cells)))


def criterion_truths(rules: RuleSet, measure: str = "measure") -> dict[str, Column]:
    twins = rules.aliases()
    out = {}
    for c in rules.criteria:
        own = _answer("criterion", c.criterion_id)
        if rules.measure is not None and c.criterion_id == rules.measure[0]:
            own = at_least(F.col(measure), rules.measure[1])
        elif c.criterion_id in twins:
            own = same_fact(own, _answer("prerequisite", twins[c.criterion_id]))
        out[c.criterion_id] = own
    return out


def prerequisite_truths(rules: RuleSet) -> dict[str, Column]:
    """The same facts read from the prerequisite's side; of several twins the first counts."""
    twin_of: dict[str, str] = {}
    for cid, gid in rules.aliases().items():
        twin_of.setdefault(gid, cid)
    return {
        gid: same_fact(_answer("prerequisite", gid), _answer("criterion", twin_of[gid]))
        if gid in twin_of
        else _answer("prerequisite", gid)
        for gid in rules.prerequisites()
    }


def factor_truths(rules: RuleSet) -> dict[str, Column]:
    """A factor's own answer, or k of n over its parts."""
    return {
        f.factor_id: _answer("factor", f.factor_id)
        if f.required is None
        else at_least_k([_answer("factor", c.factor_id) for c in rules.children(f.factor_id)], f.required)
        for f in rules.factors
    }


def with_truths(sheet: DataFrame, rules: RuleSet) -> DataFrame:
    """Add columns `c:` criterion, `p:` prerequisite, `f:` factor, `g:` group and `t:` tier truth."""
    base = {f"c:{k}": v for k, v in criterion_truths(rules).items()}
    base |= {f"p:{k}": v for k, v in prerequisite_truths(rules).items()}
    base |= {f"f:{k}": v for k, v in factor_truths(rules).items()}
    groups, tiers = {}, {}
    for tier in rules.criterion_tiers:
        names = []
        for gid, members in rules.groups(tier).items():
            any_member = any_in_row([F.col(f"`c:{m.criterion_id}`") for m in members])
            needed = [] if gid is None else [F.col(f"`p:{gid}`")]
            name = f"g:{tier}:{gid or ''}"
            groups[name] = all_in_row([*needed, any_member])
            names.append(name)
        tiers[f"t:{tier}"] = any_in_row([F.col(f"`{n}`") for n in names])
    return computed(computed(sheet.withColumns(base)).withColumns(groups).withColumns(tiers))


def _question(kind: str, id_: str, tier_id: str | None, label: str, heading: str | None) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(id_).alias("id"),
        F.lit(tier_id).cast("string").alias("tier_id"),
        F.lit(label).alias("label"),
        F.lit(heading).cast("string").alias("heading"),
    )


def _listed(pairs: Sequence[tuple[Column, Column]], empty: str) -> Column:
    """The values whose condition is true, in order."""
    if not pairs:
        return F.array().cast(empty)
    return F.filter(F.array(*[F.when(cond, value) for cond, value in pairs]), lambda x: x.isNotNull())


QUESTION = "array<struct<kind:string,id:string,tier_id:string,label:string,heading:string>>"


def group_questions(rules: RuleSet, tier: str) -> list[tuple[str, Column, Column]]:
    """(group column, condition, question): what could still decide a group that is unknown."""
    out = []
    for gid, members in rules.groups(tier).items():
        name = f"g:{tier}:{gid or ''}"
        open_ = F.col(f"`{name}`").isNull()
        not_ruled_out = F.lit(True)
        if gid is not None:
            held = F.col(f"`p:{gid}`")
            first = members[0]
            out.append(
                (name, open_ & held.isNull(), _question("prerequisite", gid, tier, first.prerequisite or first.text, first.heading or ""))
            )
            not_ruled_out = F.coalesce(held, F.lit(True))
        for m in members:
            asked = open_ & not_ruled_out & F.col(f"`c:{m.criterion_id}`").isNull()
            out.append((name, asked, _question("criterion", m.criterion_id, tier, m.text, m.heading)))
    return out


def factor_questions(rules: RuleSet) -> list[tuple[Column, Column]]:
    """Unknown factors; one that counts its parts is replaced by its unknown parts."""
    out = []
    for f in rules.top_factors():
        open_ = F.col(f"`f:{f.factor_id}`").isNull()
        if f.required is None:
            out.append((open_, _question("factor", f.factor_id, None, f.text, None)))
            continue
        for c in rules.children(f.factor_id):
            asked = open_ & _answer("factor", c.factor_id).isNull()
            out.append((asked, _question("factor", c.factor_id, None, c.text, f.text)))
    return out


def stratify(sheet: DataFrame, rules: RuleSet, subject: Sequence[str]) -> DataFrame:
    """Each subject's tier and reason, or the tiers still possible and the answers still missing.

    Criterion tiers are tried in order; the first that holds wins, but only once every tier above it is
    ruled out. If none holds, the number of factors decides, provided that its bounds give one tier.
    """
    truths = with_truths(sheet, rules)
    tiers = list(rules.criterion_tiers)
    order = {t.tier_id: t.order for t in rules.tiers}
    place = {t: i for i, t in enumerate(tiers)}
    yes = F.coalesce(*[F.when(F.col(f"`t:{t}`"), place[t]) for t in tiers])
    unknown = F.coalesce(*[F.when(F.col(f"`t:{t}`").isNull(), place[t]) for t in tiers])
    top = [F.col(f"`f:{f.factor_id}`") for f in rules.top_factors()]
    staged = truths.withColumns(
        {
            "__yes": yes,
            "__unknown": unknown,
            "confirmed": count_true(top),
            "undecided": count_unknown(top),
        }
    ).withColumns(
        {
            "__low": tier_of_count(F.col("confirmed"), rules.breaks),
            "__high": tier_of_count(F.col("confirmed") + F.col("undecided"), rules.breaks),
        }
    )
    path = (
        F.when(F.col("__yes").isNotNull() & (F.col("__unknown").isNull() | (F.col("__unknown") > F.col("__yes"))), "criterion")
        .when(F.col("__yes").isNotNull(), "blocked")
        .when(F.col("__unknown").isNull() & (F.col("__low") == F.col("__high")), "count")
        .otherwise("open")
    )
    staged = computed(staged.withColumn("path", path))
    settled = F.col("path").isin("criterion", "count")
    blocked, open_ = F.col("path") == "blocked", F.col("path") == "open"

    def order_of(col: Column) -> Column:
        return F.coalesce(*[F.when(col == t.tier_id, t.order) for t in rules.tiers])

    # An unknown tier counts unless a tier above it already holds.
    still_open = {t: F.col(f"`t:{t}`").isNull() & (open_ | (blocked & (F.col("__yes") > place[t]))) for t in tiers}
    possible = []
    for t in sorted(rules.tiers, key=lambda t: t.order):
        in_range = open_ & (order_of(F.col("__high")) <= t.order) & (order_of(F.col("__low")) >= t.order)
        reached = in_range
        if t.tier_id in place:
            reached = in_range | still_open[t.tier_id] | (blocked & (F.col("__yes") == place[t.tier_id]))
        possible.append((reached, F.lit(t.tier_id)))
    missing = [(still_open[t] & cond, q) for t in tiers for _, cond, q in group_questions(rules, t)]
    missing += [(open_ & cond, q) for cond, q in factor_questions(rules)]

    tier_id = F.when(F.col("path") == "criterion", F.coalesce(*[F.when(F.col("__yes") == place[t], t) for t in tiers]))
    first_held = []
    for t in tiers:
        for gid, members in rules.groups(t).items():
            held = (F.col("__yes") == place[t]) & F.col(f"`g:{t}:{gid or ''}`")
            first_held += [(held & F.col(f"`c:{m.criterion_id}`"), m) for m in members]
    by_criterion = F.col("path") == "criterion"
    reason = F.when(
        settled,
        F.struct(
            F.when(by_criterion, "criterion").otherwise("factor-count").alias("kind"),
            F.when(by_criterion, F.coalesce(*[F.when(c, m.criterion_id) for c, m in first_held])).alias("criterion_id"),
            F.when(
                by_criterion,
                F.get(F.filter(F.array(*[F.when(c, F.struct(F.lit(m.prerequisite).cast("string").alias("p"))) for c, m in first_held]), lambda x: x.isNotNull()), F.lit(0))["p"],
            ).alias("prerequisite"),
            F.when(~by_criterion, F.col("confirmed")).alias("count"),
            F.when(~by_criterion, _listed([(F.col(f"`f:{f.factor_id}`"), F.lit(f.factor_id)) for f in rules.top_factors()], "array<string>")).alias("factor_ids"),
            F.when(
                ~by_criterion, F.coalesce(*[F.when((F.col("__low") == t.tier_id), t.count_rule) for t in rules.tiers])
            ).alias("count_rule"),
        ),
    )
    assessed = staged.select(
        *subject,
        F.when(settled, "determined").otherwise("undetermined").alias("status"),
        "path",
        tier_id.otherwise(F.when(F.col("path") == "count", F.col("__low"))).alias("tier_id"),
        reason.alias("reason"),
        F.when(~settled, _listed(possible, "array<string>")).alias("possible"),
        F.when(~settled, _listed(missing, QUESTION)).alias("missing"),
        "confirmed",
        "undecided",
    )
    return computed(assessed)


def first_settled(verdicts: DataFrame, subject: Sequence[str], ord: str = "ord", truth: str = "truth") -> DataFrame:
    """Verdict rows per subject: the first "yes", and whether an unknown stands before it."""
    truth_ = F.col(truth)
    firsts = verdicts.groupBy(*subject).agg(
        F.min(F.when(truth_, F.col(ord))).alias("first_yes"),
        F.min(F.when(truth_.isNull(), F.col(ord))).alias("first_unknown"),
    )
    outcome = (
        F.when(F.col("first_yes").isNull(), F.when(F.col("first_unknown").isNull(), "none").otherwise("open"))
        .when(F.col("first_unknown") < F.col("first_yes"), "blocked")
        .otherwise("settled")
    )
    return firsts.withColumn("outcome", outcome)


def first_reason(rows: DataFrame, subject: Sequence[str], id_: str, ord: str = "ord", truth: str = "truth") -> DataFrame:
    """The first row that holds, per subject; subjects with none keep a NULL."""
    return rows.groupBy(*subject).agg(F.min_by(F.col(id_), F.when(F.col(truth), F.col(ord))).alias("reason"))


def reachable(bounds: DataFrame, rules: RuleSet, high: str, low: str) -> DataFrame:
    """Tiers whose order lies between the best and the worst case, both tier ids."""
    order_of = F.create_map(*[F.lit(x) for t in rules.tiers for x in (t.tier_id, t.order)])
    id_of = F.create_map(*[F.lit(x) for t in rules.tiers for x in (t.order, t.tier_id)])
    orders = F.sequence(order_of[F.col(high)], order_of[F.col(low)])
    return bounds.withColumn("order", F.explode(orders)).withColumn("tier_id", id_of[F.col("order")])


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def next_question(missing: Column) -> Column:
    return F.try_element_at(missing, F.lit(1))


def next_group(missing: Column, measure_id: str | None = None) -> Column:
    """All missing entries that share kind and heading with the first; a prerequisite stands alone.

    The measure's own question is left out: it is asked as a number.
    """
    pending = missing if measure_id is None else F.filter(missing, lambda q: q["id"] != measure_id)
    head = F.try_element_at(pending, F.lit(1))
    alike = F.filter(
        pending, lambda q: (q["kind"] == head["kind"]) & q["heading"].eqNullSafe(head["heading"])
    )
    return F.when(head["kind"] == "prerequisite", F.array(head)).otherwise(alike)


def label_answers(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers with the wording of what was answered; the id where no wording is known."""
    joined = answers.join(labels, ["kind", "id"], "left")
    return joined.withColumn("label", F.coalesce("label", "id"))


def truth_rows(truths: DataFrame, subject: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Truth columns as rows: `columns` maps an output id to a column name."""
    cells = [
        F.struct(F.lit(i).alias("id"), as_word(F.col(f"`{c}`")).alias("truth")) for i, c in columns.items()
    ]
    return truths.select(*subject, F.inline(F.array(*cells)))
