"""The whole request page, for a table of typed lines: mine, look up, filter, count facets, page."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.functions.numbers import is_zero
from refledger.operators.facets import facet_counts, facet_keys, facet_options, page, with_mentions
from refledger.operators.history import asof_one, counted_as_of, covered_once
from refledger.operators.lookup import Dataset, Lookup, master_lookup, review_state
from refledger.operators.mining import mine
from refledger.operators.reconcile import by_membership, membership
from refledger.sources.workspace import cut

ASK = ["search_text", "lookup_date", "dose_key", "filter"]
DATED, KEPT = ["search_text", "lookup_date"], ["search_text", "lookup_date", "filter"]


class Screen:
    """`results`: one row per line. The others: per distinct search, date, dose and filter.

    A search's items are counted over the stretches of days with a price, for all dates at once; they are looked up one by
    one only for `pages`, and there only those that pass the dose and the filter. Each table is made when it is read.
    """

    def __init__(self, mined: DataFrame, found: Lookup, described: DataFrame, periods: DataFrame):
        self._mined, self._found, self._periods = mined, found, periods
        self._asks = cut(mined.select(*ASK, "dose_label").distinct(), "screen-asks")
        items = found.candidates.select(F.col("query").alias("search_text"), "code", "ord")
        self._items = items.join(described, "code")
        self._dates = found.asks.select(F.col("query").alias("search_text"), F.col("as_of").alias("lookup_date"), "as_of_date")

    @cached_property
    def _held(self) -> DataFrame:
        """Items of each search with their stretches of days with a price."""
        priced = covered_once(self._periods, "code", ["price_raw"]).where(~is_zero(F.col("price_raw")))
        return self._items.join(priced, "code")

    def _counted(self, stretches: DataFrame, by: Sequence[str]) -> DataFrame:
        return counted_as_of(stretches, self._dates, "search_text", by, "lookup_date")

    @cached_property
    def facets(self) -> DataFrame:
        spans = [*("search_text", "changed"), "from_day", "next_day"]
        told = facet_counts(self._held, spans)
        tally = cut(self._counted(told, ["changed", "key", "label"]), "screen-tally")
        kept = self._asks.select(*KEPT).distinct().join(tally, DATED).where(by_membership(F.col("changed"), F.col("filter")))
        counts = kept.groupBy(*KEPT, "key", "label").agg(F.sum("n").alias("n"))
        chosen = self._asks.where("dose_key <> ''").withColumns({"key": F.col("dose_key"), "label": F.col("dose_label")})
        return facet_options(counts, chosen, ASK, self._asks, KEPT)

    @cached_property
    def results(self) -> DataFrame:
        spans = ["search_text", "changed", "dose_key", "from_day", "next_day"]
        # Of each ask two keys are counted: the blank one, which all items have, and its own.
        sought = self._asks.select("search_text", "dose_key").unionByName(self._asks.select("search_text", F.lit("").alias("dose_key"))).distinct()
        keyed = self._held.withColumn("dose_key", F.explode(facet_keys(F.col("doses")))).join(sought, ["search_text", "dose_key"], "left_semi")
        tally = self._counted(keyed.groupBy(*spans).agg(F.count("*").alias("n")), ["changed", "dose_key"])
        asked = self._asks.select(*ASK).distinct().withColumn("own", F.col("dose_key"))
        asked = asked.withColumn("dose_key", F.explode(F.array_distinct(F.array(F.lit(""), "own"))))
        passes = by_membership(F.col("changed"), F.col("filter"))
        n = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
        counts = asked.join(tally, [*DATED, "dose_key"]).groupBy(*DATED, F.col("own").alias("dose_key"), "filter").agg(
            n(F.col("changed") & (F.col("dose_key") == "")).alias("n_changed"),
            n(passes & (F.col("dose_key") == "")).alias("n_kept"),
            n(passes & (F.col("dose_key") == F.col("own"))).alias("n_visible"),
        )
        return (
            self._found.results.select("request_id", "status", "n_matches", "excluded_zero")
            .join(self._mined, "request_id")
            .join(counts, ASK, "left")
            .na.fill(0, ["n_changed", "n_kept", "n_visible"])
            .withColumn("review", review_state(F.col("status"), F.col("n_visible")))
        )

    @cached_property
    def pages(self) -> DataFrame:
        keyed = self._items.withColumn("dose_key", F.explode(facet_keys(F.col("doses"))))
        passing = self._asks.join(self._dates, DATED).join(keyed, ["search_text", "dose_key"]).where(by_membership(F.col("changed"), F.col("filter")))
        visible = asof_one(cut(passing, "screen-passing"), self._periods, "code", "as_of_date", ["price_raw"]).where(~is_zero(F.col("price_raw")))
        return page(visible, ASK)


def search_page(
    lines: DataFrame,
    items: DataFrame,
    periods: DataFrame,
    records: DataFrame,
    dataset: Dataset,
    fields: Sequence[str] = ("name_zh", "name_en", "ingredient"),
) -> Screen:
    """`lines`: request_id, line, as_of, today, announced, dataset_version.

    A date in the line overrides `as_of`. Facets are counted after the membership filter and before the
    dose filter, so the other doses stay on offer; the changed count covers the unfiltered result.
    """
    # Lines are read by several of the results, so they are written once.
    mined = cut(
        mine(lines, "line", "today", "announced")
        .withColumn("lookup_date", F.coalesce("mined_as_of", "as_of"))
        .withColumn("filter", F.coalesce("filter", F.lit("all")))
        .withColumn("dose_key", F.coalesce("dose_key", F.lit("")))
        .withColumn("dose_label", F.coalesce("dose_label", F.lit(""))),
        "mined-lines",
    )
    requests = mined.select(
        "request_id", F.col("search_text").alias("query"), F.col("lookup_date").alias("as_of"), "dataset_version"
    )
    found = master_lookup(requests, items, periods, dataset, fields, many_dates=True)
    described = with_mentions(membership(items, records)).select("code", "changed", "doses")
    return Screen(mined, found, described, periods)
