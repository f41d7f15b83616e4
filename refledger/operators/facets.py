"""Facets and classes of items: mentions, labels, counts, ranks, paging and class listings."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.functions.dates import strict_date
from refledger.functions.mentions import UNIT_ORDER, UNSPECIFIED, mentions, rank_of, union_mentions
from refledger.functions.numbers import is_zero
from refledger.functions.text import classify, generics
from refledger.operators.history import asof_one, covered_once
from refledger.operators.lookup import Dataset, gate
from refledger.operators.prefix import block, numbered, ranked
from refledger.operators.stage import dealt

PAGE_SIZE = 30  # fixed value: rows a result page shows


def with_mentions(items: DataFrame, first: str = "ingredient", second: str = "name_en") -> DataFrame:
    """Items with `doses`, the mentions of both fields. Materialise it at ingest if items are reused."""
    return items.withColumn("doses", union_mentions(mentions(F.col(first)), mentions(F.col(second))))


def facet_rows(items: DataFrame, unspecified: bool) -> DataFrame:
    """One row per item and distinct mention; with `unspecified`, one row too for items with none."""
    explode = F.explode_outer if unspecified else F.explode
    return items.withColumn("dose", explode("doses"))


def facet_counts(items: DataFrame, group: Sequence[str] = (), *, unspecified: bool = True, times: str | None = None) -> DataFrame:
    """How many items hold each mention, and how many hold none. A row counts once, or as often as its column `times` says."""
    key = F.coalesce("dose.key", F.lit(UNSPECIFIED)).alias("key")
    label = F.coalesce("dose.label", F.lit("")).alias("label")
    return (
        facet_rows(items, unspecified)
        .groupBy(*group, key, label, F.col("dose.unit").alias("unit"), F.col("dose.amount").alias("amount"))
        .agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    )


def facet_rank(facets: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Place of each facet: unit in fixed order, unit name, amount; the unspecified bucket last."""
    order = [
        (F.col("key") == UNSPECIFIED),
        rank_of(F.col("unit"), UNIT_ORDER),
        F.col("unit"),
        F.col("amount"),
        F.col("key"),
    ]
    return ranked(facets, group, order, "rank")


def facet_keys(doses: Column) -> Column:
    """All keys that `by_facet` lets an item pass with; the blank one stands for no key."""
    own = F.when(F.size(doses) == 0, F.array(F.lit(UNSPECIFIED))).otherwise(F.transform(doses, lambda d: d.key))
    return F.array_distinct(F.concat(F.array(F.lit("")), own))


def by_facet(doses: Column, key: Column) -> Column:
    """No key passes all; the unspecified key passes items without a mention."""
    held = F.exists(doses, lambda d: d.key == key)
    return F.when(key.isNull(), True).when(key == UNSPECIFIED, F.size(doses) == 0).otherwise(held)


def facet_options(facets: DataFrame, chosen: DataFrame, group: Sequence[str], asks: DataFrame | None = None, shared: Sequence[str] = ()) -> DataFrame:
    """Facets plus each chosen key that the other filters removed, with count 0.

    Where groups share their facets, these are counted once by the columns `shared`, and `asks` names all groups.
    """
    kept = facets if asks is None else asks.select(*group).distinct().join(facets, list(shared))
    kept = kept.select(*group, "key", "label", "n")
    gone = chosen.join(facets, [*(group if asks is None else shared), "key"], "left_anti")
    return kept.unionByName(gone.select(*group, "key", "label", F.lit(0).cast("bigint").alias("n")))


def profile(items: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many items carry each flag, and how many items there are."""
    return items.agg(F.count("*").alias("n_rows"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])


def label_counts(rows: DataFrame, labels: Column, names: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows per label, every label of the list present. Labels are flags, so one pass counts them all."""
    counted = rows.groupBy(*group).agg(*[F.count_if(F.array_contains(labels, n)).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("n")) for n in names])
    return counted.select(*group, F.inline(pairs))


def generic_counts(rows: DataFrame, names: Column, class_of, chosen: Column, group: Sequence[str] = ()) -> DataFrame:
    """Rows per name within the chosen class; names of other classes are left out, so counts add up."""
    own = F.filter(names, lambda g: class_of(g) == chosen)
    return rows.select(*group, F.explode(own).alias("name")).groupBy(*group, "name").agg(F.count("*").alias("n"))


def largest_first(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Place of each name: largest count first, the name breaks ties."""
    return ranked(counts, group, [F.desc("n"), F.col("name")], "rank")


def page(matches: DataFrame, group: Sequence[str], ord: str = "ord", size: int = PAGE_SIZE) -> DataFrame:
    """Place and page number of each match within its request, in source order."""
    placed = numbered(matches, group, [ord], block(ord), "place")
    return placed.withColumn("page", F.ceil(F.col("place") / size).cast("bigint"))


class ClassListing(NamedTuple):
    """`results`: one row per request. `matches`, `counts` and `generics`: per distinct request."""

    results: DataFrame
    matches: DataFrame
    counts: DataFrame
    generics: DataFrame


def class_listing(
    requests: DataFrame,
    items: DataFrame,
    periods: DataFrame,
    dataset: Dataset,
    labels: dict[str, str],
    other: str,
    name_pattern: str,
    class_of,
) -> ClassListing:
    """All items of a class that carry a price on a date. Request columns: `request_id, class, as_of`.

    Both ends of the effective range are tested. Each asked date's counts of all classes are part of the
    answer: they come from stretches of days with one price per item, added up per class and day, and no item
    is expanded for them. Items are looked up one by one only for the classes and dates asked for.
    """
    every = [*labels, other]
    flagged = requests.withColumn(
        "answerable", gate(F.col("as_of"), F.lit(None), dataset, "both") & F.col("class").isin(every)
    )
    asks = flagged.where("answerable").select("class", "as_of").distinct()
    # Bounded: known classes times the calendar days of the dataset's effective range.
    class_days = (
        asks.select("as_of")
        .distinct()
        .select("as_of", strict_date(F.col("as_of")).alias("as_of_date"), F.explode(F.array(*map(F.lit, every))).alias("class"))
    )
    classed = dealt(items.select("code", "ord", "ingredient"), "code").select(
        "code", "ord", "ingredient", F.explode(classify(F.col("ingredient"), labels, other)).alias("class")
    )
    zero = is_zero(F.col("price_raw"))
    stretches = classed.select("code", "class").join(covered_once(periods, "code", ["price_raw"]), "code")
    step = F.array(
        F.struct(F.col("from_day").alias("day"), F.lit(1).alias("step")), F.struct(F.col("next_day").alias("day"), F.lit(-1).alias("step"))
    )
    marks = stretches.select("class", zero.alias("zero"), F.inline(step)).where("day IS NOT NULL")
    n = lambda flag: F.sum(F.when(flag, F.col("step")).otherwise(0))
    marks = marks.groupBy("class", "day").agg(n(~F.coalesce("zero", F.lit(False))).alias("n_matches"), n(F.col("zero")).alias("excluded_zero"))
    asked_days = class_days.select("class", F.col("as_of_date").alias("day"), "as_of")
    # Classes times calendar days, whatever the number of items.
    sofar = Window.partitionBy("class").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.unionByName(asked_days, allowMissingColumns=True).select(
        "class", "as_of", *[F.coalesce(F.sum(c).over(sofar), F.lit(0)).alias(c) for c in ("n_matches", "excluded_zero")]
    )
    found = found.where("as_of IS NOT NULL")
    counts = found
    # Each item becomes a row per class and date: dealt out, so that no task holds those of a whole split of items.
    # The asks are as bounded as the class days.
    dated = classed.join(F.broadcast(asks.withColumn("as_of_date", strict_date(F.col("as_of")))), "class")
    dated = dealt(dated, "code", "as_of_date")
    matches = asof_one(dated, periods, "code", "as_of_date", ["price_raw"]).where(~zero)
    named = generic_counts(
        matches.withColumn("names", generics(F.col("ingredient"), name_pattern)),
        F.col("names"),
        class_of,
        F.col("class"),
        ["class", "as_of"],
    )
    results = (
        flagged.join(found.withColumn("answerable", F.lit(True)), ["class", "as_of", "answerable"], "left")
        .na.fill(0, ["n_matches", "excluded_zero"])
        .withColumn("status", F.when(F.col("answerable"), "OK").otherwise("NOT_IN_VALIDATED_DATASET"))
    )
    return ClassListing(results, matches, counts, largest_first(named, ["class", "as_of"]))


def drill(ingredient: Column, generic: Column) -> Column:
    """Does the item's ingredient hold the chosen name?"""
    return F.contains(F.upper(ingredient), generic)
