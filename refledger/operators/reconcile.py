"""Merging, comparing and joining tables that describe the same keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.dates import strict_date
from refledger.functions.text import blank_to_null
from refledger.operators.history import StoredHistory, asof_one
from refledger.operators.lookup import Dataset, gate
from refledger.operators.prefix import block, numbered


class Merge(NamedTuple):
    """`records`: one row per key. `conflicts`: the first row that contradicts an earlier value."""

    records: DataFrame
    conflicts: DataFrame


def merge_sources(sources: Sequence[DataFrame], key: str, row_no: str = "row_no") -> Merge:
    """Merge sources by key, first-seen value winning; later rows fill fields that are still absent.

    An empty text is an absent value. Fields are folded as (key, field, value) rows, and equal values
    are added up first, so a hot key is spread over its fields and reduced on the map side.
    """
    tagged = [df.withColumn("src_no", F.lit(i)) for i, df in enumerate(sources, 1)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    fields = [c for c in rows.columns if c not in (key, "src_no", row_no)]
    place = F.struct("src_no", row_no)
    cells = rows.select(
        key,
        place.alias("place"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), blank_to_null(F.col(f)).alias("value")) for f in fields])),
    ).where("value IS NOT NULL")
    values = cells.groupBy(key, "field", "value").agg(F.min("place").alias("place"))
    firsts = values.groupBy(key, "field").agg(
        F.min_by("value", "place").alias("value"), F.min("place").alias("place"), F.count("*").alias("n_values")
    )
    picked = firsts.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    seen = rows.groupBy(key).agg(F.min(place).alias("first_seen"))
    records = seen.join(picked, key, "left").select(
        key, F.col("first_seen.src_no").alias("src_no"), F.col(f"first_seen.{row_no}").alias(row_no), *fields
    )
    disputed = firsts.where("n_values > 1").select(key, "field", F.col("value").alias("kept"), F.col("place").alias("kept_at"))
    conflicts = (
        values.join(disputed, [key, "field"])
        .where(F.col("place") > F.col("kept_at"))
        .groupBy(key, "field", "kept", "kept_at")
        .agg(F.min(F.struct("place", "value")).alias("other"))
        .select(key, "field", "kept", F.col("other.value").alias("refused"), F.col("other.place.*"))
    )
    return Merge(records, conflicts)


def attach_announcement(items: DataFrame, records: DataFrame, key: str = "code") -> DataFrame:
    """Announcement columns on items with exactly that code; nothing is normalised on this path."""
    return items.join(records.withColumn("announced", F.lit(True)), key, "left").withColumn(
        "announced", F.coalesce("announced", F.lit(False))
    )


def repriced(before: Column, after: Column) -> Column:
    return before.isNotNull() & after.isNotNull()


def membership(items: DataFrame, records: DataFrame, key: str = "code") -> DataFrame:
    """Flags `announced` and `changed` per item. Records are one per key; a key not announced is unchanged."""
    flags = records.select(key, repriced(F.col("price_before"), F.col("price_after")).alias("changed"))
    joined = attach_announcement(items, flags, key)
    return joined.withColumn("changed", F.coalesce("changed", F.lit(False)))


def by_membership(changed: Column, chosen: Column) -> Column:
    """Filter "all", "priceChanged" or "priceUnchanged"."""
    return F.when(chosen == "priceChanged", changed).when(chosen == "priceUnchanged", ~changed).otherwise(True)


def price_comparison(items: DataFrame, records: DataFrame, key: str = "code") -> DataFrame:
    """The four announcement fields of repriced items, if all four are given."""
    fields = ["price_before", "price_after", "effective_date", "coverage_rule"]
    return items.join(records.select(key, *fields).na.drop(subset=fields), key)


def nest(parents: DataFrame, children: DataFrame, on: str, ord: str) -> DataFrame:
    """Children numbered under their parent in source order; a childless parent keeps one row.

    Children stay rows, since an array of all children of one parent has no size bound.
    """
    placed = numbered(children, [on], [ord], block(ord), "child_no")
    return parents.join(placed, on, "left")


def resolve_codes(listed: DataFrame, items: DataFrame, periods: DataFrame | StoredHistory) -> DataFrame:
    """Codes of a list as of each row's `as_of_date`; codes that no price covers stay, unresolved.

    Zero prices are kept here: the list names the code. `listed` holds one row per code.
    """
    known = listed.select("code", "as_of_date").distinct().join(items.select("code", "name_en"), "code")
    prices = asof_one(known, periods, "code", "as_of_date", ["price_raw"])
    found = prices.select("code", "as_of_date", "name_en", "price_raw")
    return listed.join(found, ["code", "as_of_date"], "left").withColumn("resolved", F.col("price_raw").isNotNull())


def exception_listing(
    requests: DataFrame, listed: DataFrame, items: DataFrame, periods: DataFrame | StoredHistory, dataset: Dataset
) -> tuple[DataFrame, DataFrame]:
    """Listings of rules on dates. `requests`: request_id, rule_id, as_of. `listed`: rule_id, pos, code.

    An unknown rule or a date outside the effective range fails closed. Returns (results, codes), the
    codes once per distinct (rule_id, as_of).
    """
    flagged = requests.withColumn("in_range", gate(F.col("as_of"), F.lit(None), dataset, "both"))
    known = listed.select("rule_id").distinct().withColumn("known", F.lit(True))
    flagged = flagged.join(known, "rule_id", "left").withColumn(
        "answerable", F.col("in_range") & F.coalesce("known", F.lit(False))
    )
    asks = flagged.where("answerable").select("rule_id", "as_of").distinct()
    wanted = asks.join(listed, "rule_id").withColumn("as_of_date", strict_date(F.col("as_of")))
    codes = resolve_codes(wanted, items, periods)
    sums = codes.groupBy("rule_id", "as_of").agg(
        F.count_if("resolved").alias("n_resolved"), F.count_if(~F.col("resolved")).alias("n_unresolved")
    )
    results = (
        flagged.join(sums.withColumn("answerable", F.lit(True)), ["rule_id", "as_of", "answerable"], "left")
        .na.fill(0, ["n_resolved", "n_unresolved"])
        .withColumn("status", F.when(F.col("answerable"), "OK").otherwise("NOT_IN_VALIDATED_DATASET"))
    )
    return results, codes


def notes_for(tiers: DataFrame, notes: DataFrame, tier: str = "tier_id") -> DataFrame:
    """Notes whose list names the tier, in order; a tier that no list names keeps one row of NULLs."""
    scoped = notes.where("applies_to IS NOT NULL").withColumn(tier, F.explode("applies_to")).drop("applies_to")
    return tiers.join(scoped, tier, "left")


def unscoped(notes: DataFrame, ord: str = "ord") -> DataFrame:
    """The first note that names no tier."""
    return notes.where("applies_to IS NULL").orderBy(ord).limit(1)


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with the side that holds it."""
    left = a.select(key).distinct().withColumn("__a", F.lit(True))
    right = b.select(key).distinct().withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").otherwise("both")
    return left.join(right, key, "full").select(key, side.alias("side"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Each key as added, removed, changed or same. Keys are unique within a snapshot."""
    cols = [F.col(f"`{c}`") for c in old.columns if c != key]
    a = old.select(key, F.struct(*cols).alias("was"))
    b = new.select(key, F.struct(*cols).alias("now"))
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was").eqNullSafe(F.col("now")), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full").select(key, change.alias("change"))


def aliases(criteria: DataFrame, full_stop: str = "。") -> DataFrame:
    """Criteria that state, as another group's prerequisite does, the same fact.

    Texts are equal once a final full stop is dropped. Of several groups with one label the last counts.
    """
    labels = (
        criteria.where("group_id IS NOT NULL AND prerequisite_label IS NOT NULL")
        .groupBy(F.col("prerequisite_label").alias("fact"))
        .agg(F.max_by("group_id", "ord").alias("twin_group"))
    )
    stated = criteria.withColumn("fact", F.regexp_replace("text", f"{full_stop}$", ""))
    return stated.join(labels, "fact").where(~F.col("twin_group").eqNullSafe(F.col("group_id"))).select(
        "criterion_id", "twin_group"
    )


def children_of(factors: DataFrame) -> DataFrame:
    """(parent, child) rows of a self-referencing table."""
    parents = factors.select(F.col("factor_id").alias("parent_id"), F.col("required").alias("required"))
    children = factors.where("parent_id IS NOT NULL").select("parent_id", F.col("factor_id").alias("child_id"))
    return parents.join(children, "parent_id")


def attach_by_heading(rows: DataFrame, blocks: DataFrame, heading: str = "heading") -> tuple[DataFrame, DataFrame]:
    """Blocks on the rows that name their heading, and the rows whose heading has no block.

    A row without a heading gets no block and is no error.
    """
    attached = rows.join(blocks, heading, "left")
    return attached, rows.where(F.col(heading).isNotNull()).join(blocks, heading, "left_anti")


def labels_to_ids(rows: DataFrame, key: str, labels: str, dictionary: DataFrame, sep: str = "、") -> tuple[DataFrame, DataFrame]:
    """Lists of labels as ids by exact label, and the labels that the dictionary does not know.

    `dictionary` holds one row per label: label, id.
    """
    named = rows.select(key, F.posexplode(F.split(labels, sep)).alias("pos", "label"))
    known = named.join(dictionary, "label").select(key, "pos", "label", "id")
    return known, named.join(dictionary, "label", "left_anti").select(key, "pos", "label")


def latest(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last write per key; a written NULL withdraws the answer, so its row goes."""
    last = F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, f"last.{value}").where(F.col(value).isNotNull())


