"""Batch lookup of a table of requests in an item table, as of each request's date.

Requests are made distinct before any join: a query that a third of all requests share is resolved once.
Request columns: `request_id, query, as_of, dataset_version` (the dates as text, as they came in).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.dates import strict_date
from refledger.functions.numbers import is_zero
from refledger.functions.text import CODE_PATTERN, is_code, nfkc, norm_code, norm_name, search_text
from refledger.operators.history import StoredHistory, asof_one, counted_as_of, covered_once
from refledger.operators.search import haystack, search
from refledger.sources.workspace import cut

# --- Fixed values: the statuses of a lookup ------------------------------------------------------
EXACT, MULTIPLE, NOT_FOUND = "EXACT_MATCH", "MULTIPLE_MATCHES", "NOT_IN_VALIDATED_DATASET"
# -------------------------------------------------------------------------------------------------


class Dataset(NamedTuple):
    """The one published version that requests are answered from."""

    version: str
    effective_from: str
    effective_to: str


class Lookup(NamedTuple):
    """`results`: one row per request. `matches`: one row per distinct (query, as_of) and item.

    `asks`, the distinct (query, as_of, as_of_date) that are answered, and `candidates`, the items of each query on whatever
    date, are told by a master lookup.
    """

    results: DataFrame
    matches: DataFrame
    asks: DataFrame | None = None
    candidates: DataFrame | None = None


def gate(as_of: Column, version: Column, dataset: Dataset, bounds: str) -> Column:
    """May the request be answered at all? Fails closed on any doubt.

    `bounds` is "upper", "lower" or "both": which ends of the dataset's effective range are tested.
    """
    ok = strict_date(as_of).isNotNull()
    if bounds in ("upper", "both"):
        ok = ok & (as_of <= dataset.effective_to)
    if bounds in ("lower", "both"):
        ok = ok & (as_of >= dataset.effective_from)
    ok = ok & (F.coalesce(version, F.lit(dataset.version)) == dataset.version)
    return F.coalesce(ok, F.lit(False))


def resolve_version(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests that name no version, or their dataset's current one in the registry. A blank version names none.

    `registry` holds one row per dataset: dataset, current_version.
    """
    named = F.when(F.trim("dataset_version") != "", F.col("dataset_version"))
    known = requests.join(registry.select("dataset", "current_version"), "dataset")
    return known.where(F.coalesce(named, F.col("current_version")) == F.col("current_version"))


def folded(col: Column) -> Column:
    """The fold of a text that is folded already."""
    return col


def match_code(queries: DataFrame, code: str, items: DataFrame, item_code: str = "code") -> DataFrame:
    """Items whose code equals the normalised query, if that has the shape of a code."""
    shaped = queries.where(is_code(F.col(code), CODE_PATTERN))
    return shaped.join(items, shaped[code] == items[item_code])


def with_haystack(items: DataFrame, fields: Sequence[str], normalise=search_text) -> DataFrame:
    """Items with the text that term search runs on. Materialise it at ingest if items are reused."""
    return items.withColumn("hay", haystack([normalise(F.col(f)) for f in fields]))


def code_then_terms(queries: DataFrame, items: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Candidates per distinct `query`: the item with that very code, else all items with all terms.

    Distinct queries and haystacks are each read several times, and folding them runs in Python, so
    they are written once. Items may bring their haystack along as column `hay`.
    """
    asked = queries.select("query").distinct().select("query", nfkc(F.col("query")).alias("folded"))
    # Folded once, before both forms.
    asked = asked.select("query", norm_code(F.col("folded"), folded).alias("as_code"), search_text(F.col("folded"), fold=folded).alias("as_text"))
    shaped = F.when(is_code(F.col("as_code")), F.col("as_code"))
    tried = cut(asked.join(items.select("code", "ord"), shaped == F.col("code"), "left"), "tried-queries")
    by_code = tried.where("code IS NOT NULL").select("query", "code", "ord")
    rest = tried.where("code IS NULL").select("query", "as_text")
    if "hay" not in items.columns:
        items = cut(with_haystack(items, fields).select("code", "ord", "hay"), "haystacks")
    found = search(rest, "as_text", items.select("code", "ord", "hay"), "hay")
    return by_code.unionByName(rest.join(found, "as_text").select("query", "code", "ord"))


def drop_zero(matches: DataFrame, price: str, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Matches with a price, and per group how many were kept and how many left out as zero-priced."""
    zero = is_zero(F.col(price))
    counts = matches.groupBy(*group).agg(
        F.count_if(~zero).alias("n_matches"), F.count_if(zero).alias("excluded_zero")
    )
    return matches.where(~zero), counts


def status(n_matches: Column) -> Column:
    return F.when(n_matches == 1, EXACT).when(n_matches > 1, MULTIPLE).otherwise(NOT_FOUND)


def _results(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per request; requests without any match keep theirs."""
    counted = counts.withColumn("answerable", F.lit(True))
    return (
        requests.join(counted, ["query", "as_of", "answerable"], "left")
        .withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
        .withColumn("excluded_zero", F.coalesce("excluded_zero", F.lit(0)))
        .withColumn("status", status(F.col("n_matches")))
        .withColumn("manual_review", F.col("status") != EXACT)
    )


def gated(requests: DataFrame, dataset: Dataset, bounds: str) -> tuple[DataFrame, DataFrame]:
    """All requests with their `answerable` flag, and the distinct (query, as_of) to be answered."""
    flagged = requests.withColumn("answerable", gate(F.col("as_of"), F.col("dataset_version"), dataset, bounds))
    return flagged, flagged.where("answerable").select("query", "as_of").distinct()


def master_lookup(
    requests: DataFrame,
    items: DataFrame,
    periods: DataFrame | StoredHistory,
    dataset: Dataset,
    fields: Sequence[str] = ("name_zh", "name_en", "ingredient"),
    *,
    many_dates: bool = False,
) -> Lookup:
    """Code first, else every term in any field; then the one period that covers the date.

    Past dates are allowed, so only the upper end of the effective range is tested. Items priced zero
    on the date are left out and counted. With `many_dates=True`, for queries that are asked on most days, `periods` are
    rows, each query's items are counted over the stretches of days with a price, and `matches`, a row for each item and
    date, are made only where they are read.
    """
    flagged, asks = gated(requests, dataset, "upper")
    asks = asks.withColumn("as_of_date", strict_date(F.col("as_of")))
    if many_dates:
        asks, candidates = cut(asks, "lookup-asks"), cut(code_then_terms(asks, items, fields), "candidates")
        dated = asks.join(candidates, "query")
    else:
        candidates = code_then_terms(asks, items, fields)
        dated = cut(asks.join(candidates, "query"), "candidates")
    priced = asof_one(dated, periods, "code", "as_of_date", ["price_raw"])
    matches, counts = drop_zero(priced, "price_raw", ["query", "as_of"])
    if many_dates:
        held = candidates.join(covered_once(periods, "code", ["price_raw"]), "code").withColumn("zero", is_zero(F.col("price_raw")))
        held = held.groupBy("query", "zero", "from_day", "next_day").agg(F.count("*").alias("n"))
        n = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
        counts = counted_as_of(held, asks, "query", ["zero"], "as_of").groupBy("query", "as_of").agg(
            n(~F.col("zero")).alias("n_matches"), n(F.col("zero")).alias("excluded_zero")
        )
    return Lookup(_results(flagged, counts), matches, asks, candidates)


def announcement_lookup(
    requests: DataFrame,
    records: DataFrame,
    dataset: Dataset,
    fields: Sequence[str] = ("name_en", "ingredient", "category"),
) -> Lookup:
    """A code-shaped query ends with the code; any other is one phrase sought in any field.

    Only the lower end of the effective range is tested, and the gap before a unit is kept.
    """
    flagged, asks = gated(requests, dataset, "lower")
    asked = asks.select("query").distinct().select("query", nfkc(F.col("query")).alias("folded"))
    asked = asked.select("query", norm_code(F.col("folded"), folded).alias("as_code"), norm_name(F.col("folded"), folded).alias("as_text"))
    by_code = match_code(asked, "as_code", records.select("code", "ord")).select("query", "code", "ord")
    phrases = asked.where(~is_code(F.col("as_code")))
    sought = with_haystack(records, fields, norm_name).select("code", "ord", "hay")
    by_phrase = phrases.join(search(phrases, "as_text", sought, "hay", phrase=True), "as_text")
    found = by_code.unionByName(by_phrase.select("query", "code", "ord"))
    matches = asks.join(found, "query")
    counts = matches.groupBy("query", "as_of").agg(
        F.count("*").alias("n_matches"), F.lit(0).cast("bigint").alias("excluded_zero")
    )
    return Lookup(_results(flagged, counts), matches)


def review_state(status: Column, n_visible: Column) -> Column:
    """What a reviewer sees beside the list: several candidates, nothing available, or no note."""
    return F.when(status == MULTIPLE, F.concat(F.lit("multipleCandidates:"), n_visible.cast("string"))).when(
        status == NOT_FOUND, "unavailable"
    ).otherwise("none")
