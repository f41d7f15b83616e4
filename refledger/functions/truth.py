"""Three-valued logic. A nullable BOOLEAN holds yes (true), no (false) and unknown (NULL).

Spark's `bool_or` and `bool_and` skip NULL, so the aggregates are written with counts. Within a row,
Spark's own `|` and `&` already follow Kleene's tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _yes(col: Column) -> Column:
    return F.count_if(col)


def _unknown(col: Column) -> Column:
    return F.count_if(col.isNull())


def any_of(col: Column) -> Column:
    """Aggregate: one yes settles it; otherwise an unknown keeps it open."""
    return F.when(_yes(col) > 0, True).when(_unknown(col) == 0, False)


def all_of(col: Column) -> Column:
    """Aggregate: one no settles it; otherwise an unknown keeps it open."""
    return F.when(F.count_if(~col) > 0, False).when(_unknown(col) == 0, True)


def k_of_n(col: Column, k: int | Column) -> Column:
    """Aggregate: yes once k hold, no once k can no longer be reached."""
    return F.when(_yes(col) >= k, True).when(_yes(col) + _unknown(col) < k, False)


def count_bounds(col: Column) -> tuple[Column, Column]:
    """Aggregates: how many certainly hold, and how many may hold."""
    return _yes(col), _yes(col) + _unknown(col)


def tier_of_count(count: Column, breaks: Sequence[tuple[int, str]]) -> Column:
    """The id of the first break, highest first, that the count reaches."""
    (first, label), *rest = sorted(breaks, reverse=True)
    out = F.when(count >= first, label)
    for limit, name in rest:
        out = out.when(count >= limit, name)
    return out


def any_in_row(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, values, F.lit(False))


def all_in_row(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, values, F.lit(True))


def count_true(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(v, 1).otherwise(0) for v in values], F.lit(0))


def count_unknown(values: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(v.isNull(), 1).otherwise(0) for v in values], F.lit(0))


def same_fact(own: Column, twin: Column) -> Column:
    """One fact read in two places: either answer serves, two different answers are unknown."""
    return F.when(own.isNull(), twin).when(twin.isNull() | (own == twin), own)


def as_word(col: Column) -> Column:
    return F.when(col.isNull(), "unknown").when(col, "yes").otherwise("no")


def at_least_k(values: Sequence[Column], k: int) -> Column:
    """Within a row: yes once k hold, no once k can no longer be reached."""
    yes, unknown = count_true(values), count_unknown(values)
    return F.when(yes >= k, True).when(yes + unknown < k, False)
