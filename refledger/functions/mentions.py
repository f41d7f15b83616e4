"""Amount-and-unit mentions in free text, such as `20.00 MG` or `444.4 MG/GM`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from refledger.functions.numbers import plain_number
from refledger.functions.text import WS

# --- Fixed values: unit spellings in item texts, their labels, and the order of facets ----------
ITEM_UNITS = {"MCG": "mcg", "MG": "mg", "GM": "g", "ML": "ml", "IU": "IU", "G": "g", "%": "%"}
PER_UNITS = ("MCG", "MG", "GM", "ML", "G")
UNIT_ORDER = ("mcg", "mg", "g", "ml", "IU", "%")
UNSPECIFIED = "unspecified"
# ----------------------------------------------------------------------------------------------


def mention_pattern(units: Sequence[str], per_units: Sequence[str], not_before: str = "A-Z") -> str:
    """Number, unit and optional `/unit`, not run on into a letter. Letter case is ignored."""
    return (
        rf"(?i)(\d+(?:\.\d+)?){WS}*({'|'.join(units)})"
        rf"(?:{WS}*/{WS}*({'|'.join(per_units)}))?(?![{not_before}])"
    )


def _label_of(unit: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.upper(unit))


def norm_unit(unit: Column, per: Column, labels: dict[str, str] = ITEM_UNITS) -> Column:
    """Unit label, with its denominator if stated. NULL if either is unknown."""
    with_per = F.concat(_label_of(unit, labels), F.lit("/"), _label_of(per, labels))
    return F.when(per == "", _label_of(unit, labels)).otherwise(with_per)


def mention_of(raw: Column, pattern: str, labels: dict[str, str] = ITEM_UNITS) -> Column:
    """STRUCT<amount, unit, key, label> of one matched mention; NULL if its unit is unknown."""
    number, unit, per = [F.regexp_extract(raw, pattern, i) for i in (1, 2, 3)]
    label = norm_unit(unit, per, labels)
    digits = plain_number(number)
    fields = F.struct(
        number.try_cast("double").alias("amount"),
        label.alias("unit"),
        F.concat(digits, label).alias("key"),
        F.concat(digits, F.lit(" "), label).alias("label"),
    )
    return F.when(label.isNotNull(), fields)


def mentions(
    text: Column,
    units: dict[str, str] = ITEM_UNITS,
    per_units: Sequence[str] = PER_UNITS,
) -> Column:
    """All mentions of one field in order of appearance, repeats dropped."""
    pattern = mention_pattern(list(units), per_units)
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
    found = F.transform(hits, lambda raw: mention_of(raw, pattern, units))
    return distinct_first(F.filter(found, lambda m: m.isNotNull()))


def distinct_first(items: Column) -> Column:
    return F.array_distinct(items)


def union_mentions(first: Column, second: Column) -> Column:
    """Both fields' mentions, the first field's order leading."""
    return F.array_union(first, second)


def rank_of(value: Column, order: Sequence[str]) -> Column:
    """Place of a value in a fixed list; unknown values come after all others."""
    position = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.coalesce(F.nullif(position, F.lit(0).cast("bigint")), F.lit(len(order) + 1).cast("bigint"))
