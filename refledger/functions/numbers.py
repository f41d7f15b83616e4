"""Numbers that reference files keep as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refledger.functions.text import strip

# --- Fixed values: the spelling of a decimal number, and of one a price field may hold ---------
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# ----------------------------------------------------------------------------------------------


def finite(col: Column) -> Column:
    """NULL for NaN and the infinities, which count as not given."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def number_or_null(text: Column) -> Column:
    trimmed = strip(text)
    return finite(F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double")))


def is_zero(text: Column) -> Column:
    """Is the price text a number equal to zero? What is no number is kept, hence false."""
    return F.coalesce(number_or_null(text) == 0, F.lit(False))


def plain_number(text: Column) -> Column:
    """Digits without padding zeros: `20.00` as `20`, `0.50` as `0.5`. Never rounded."""
    whole = F.regexp_replace(text, "^0+(?=[0-9])", "")
    return F.regexp_replace(F.regexp_replace(whole, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def parse_measure(text: Column, lo: float = 0, hi: float = 1000) -> Column:
    """A finite number within bounds, else NULL."""
    value = number_or_null(text)
    return F.when(value.between(lo, hi), value)


def at_least(measure: Column, limit: float) -> Column:
    """Three-valued: NULL if the measure is not given."""
    return finite(measure) >= limit
