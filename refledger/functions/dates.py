"""Calendar dates in the spellings that reference files and requests use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from refledger.functions.text import strip

# --- Fixed values -----------------------------------------------------------------------------
ERA_OFFSET = 1911
OPEN_END_PACKED = "9991231"
OPEN_END = "9999-12-31"
# ----------------------------------------------------------------------------------------------


def strict_date(col: Column) -> Column:
    """A DATE for a well-formed `yyyy-MM-dd` that exists in the calendar, else NULL."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(col, "yyyy-MM-dd"))


def _from_parts(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return strict_date(text)


def era_packed_date(col: Column, offset: int = ERA_OFFSET) -> Column:
    """`  850502` or `1150901`: two- or three-digit era year, month, day. NULL if no such date."""
    packed = strip(col)
    parts = [F.regexp_extract(packed, r"^(\d{2,3})(\d{2})(\d{2})$", i) for i in (1, 2, 3)]
    year = F.try_to_number(parts[0], F.lit("999")).cast("int") + offset
    return F.when(packed == OPEN_END_PACKED, F.lit(OPEN_END).cast("date")).otherwise(
        _from_parts(year, parts[1], parts[2])
    )


def era_date(col: Column, offset: int = ERA_OFFSET) -> Column:
    """`115/9/1`, `115.9.1` or `115-9-1` with a two- or three-digit era year."""
    pattern = r"^(\d{2,3})[/.-](\d{1,2})[/.-](\d{1,2})$"
    parts = [F.regexp_extract(col, pattern, i) for i in (1, 2, 3)]
    year = F.try_to_number(parts[0], F.lit("999")).cast("int") + offset
    return _from_parts(year, parts[1], parts[2])


def month_day(col: Column, today: Column) -> Column:
    """`9/1` or `9.1` in the year of `today` (text `yyyy-MM-dd`)."""
    parts = [F.regexp_extract(col, r"^(\d{1,2})[/.](\d{1,2})$", i) for i in (1, 2)]
    return F.when(parts[0] != "", _from_parts(F.substring(today, 1, 4), parts[0], parts[1]))


def date_words(col: Column, words: Sequence[str], value: Column) -> Column:
    """`value` once for each of the words that the text holds, in text order."""
    hits = F.regexp_extract_all(col, F.lit("(?i)" + "|".join(words)), 0)
    return F.transform(hits, lambda _: value)


def is_stale(as_of: Column, snapshot: str) -> Column:
    """Does a well-formed as-of date lie after the snapshot the data was taken from?"""
    return F.coalesce(as_of.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (as_of > snapshot), F.lit(False))


def is_superseded(as_of: Column, effective: str, changed: Column) -> Column:
    """Is a repriced item asked for on or after the day its new price takes effect?"""
    well_formed = as_of.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (as_of >= effective)
    return F.coalesce(well_formed & changed, F.lit(False))


def local_date(utc: Column, tz: str) -> Column:
    """The calendar date that a clock in `tz` shows at a UTC instant."""
    return F.to_date(F.from_utc_timestamp(utc, tz))


def date_presets(now_utc: Column, tz: str, effective: str) -> Column:
    """The two dates a request form offers: the local today, and the effective date."""
    iso = F.date_format(local_date(now_utc, tz), "yyyy-MM-dd")
    return F.array(
        F.struct(F.lit("today").alias("preset"), iso.alias("value")),
        F.struct(F.lit("announcement").alias("preset"), F.lit(effective).alias("value")),
    )
