"""Line-broken text into numbered records: slicing, folding, headings, ordinals and ids.

Line rows hold a document key, a line number that is unique within the document, and the line. A long
document is worked on in blocks of lines (see `prefix`); only the lines of one item meet in one row,
since an item's text is one value of the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.functions.text import NUMERALS, WS, insert_at, rejoin, required_count, seam_exceptions, split_ordinal, strip, strip_suffix
from refledger.operators.prefix import block, numbered, one_block, running
from refledger.sources.workspace import cut

# --- Fixed values: superscripts that a layout drops onto a line of their own ---------------------
SUPERSCRIPTS = {"2": "²", "3": "³"}
ITEM_START = rf"^{WS}*(?:[(（][{''.join(NUMERALS)}][)）]|\d+\.|[{''.join(NUMERALS)}]、|●)"
# -------------------------------------------------------------------------------------------------

NOT_WS = WS.replace("[", "[^", 1)
ORPHAN = rf"^({WS}*)(\d){WS}*$"


def to_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Texts as numbered lines, form feeds removed."""
    lines = F.split(F.regexp_replace(text, "\f", ""), "\n")
    return df.select(key, F.posexplode(lines).alias("ord", "line"))


def drop_noise(lines: DataFrame, marker: str, line: str = "line") -> DataFrame:
    """Lines that are neither blank nor page headers."""
    return lines.where(F.col(line).rlike(NOT_WS) & ~F.contains(F.col(line), F.lit(marker)))


def slice_between(
    lines: DataFrame, doc: str, markers: dict[str, Column], ord: str = "ord", *, whole: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Lines after each marker and before the next; the last marker only closes.

    Each marker is sought after the one before it. Returns the lines with their `section`, and the
    markers that a document lacks. Only lines that are markers meet in one row per document. With `whole=True`, for lines
    that are known to lie in one block, markers are sought where a document's lines lie, which reads these once.
    """
    names = list(markers)
    per_doc = lines.groupBy(doc).agg(
        *[F.array_sort(F.collect_list(F.when(hit, F.col(ord)))).alias(f"__hits_{i}") for i, hit in enumerate(markers.values())]
    )
    found = per_doc.withColumn("__at_0", F.try_element_at("__hits_0", F.lit(1)))
    for i in range(1, len(names)):
        above = F.col(f"__at_{i - 1}")
        later = F.filter(f"__hits_{i}", lambda at: at > above)
        found = found.withColumn(f"__at_{i}", F.try_element_at(later, F.lit(1)))
    places = [f"__at_{i}" for i in range(len(names))]
    found = found.select(doc, *places)
    lacking = F.array(*[F.when(F.col(at).isNull(), F.lit(name)) for at, name in zip(places, names)])
    missing = found.select(doc, F.explode(F.filter(lacking, lambda m: m.isNotNull())).alias("marker"))
    section = F.lit(None).cast("string")
    for at, nxt, name in zip(places, places[1:], names):
        section = F.when((F.col(ord) > F.col(at)) & (F.col(ord) < F.col(nxt)), name).otherwise(section)
    if whole:
        within = Window.partitionBy(doc).orderBy(ord).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = lines.where(F.col(doc).isNotNull())
        for i, (at, hit) in enumerate(zip(places, markers.values())):
            sought = hit if i == 0 else hit & (F.col(ord) > F.col(places[i - 1]))
            placed = placed.withColumn(at, F.min(F.when(sought, F.col(ord))).over(within))
        placed = placed.na.drop(subset=places)
    else:
        placed = lines.join(found.na.drop(subset=places), doc)
    cut_out = placed.withColumn("section", section).where("section IS NOT NULL")
    return cut_out.drop(*places), missing


def _digits(lines: DataFrame, line: str) -> DataFrame:
    """Adds `__digit`, the digit that a line holds alone."""
    return lines.withColumn("__digit", F.nullif(F.regexp_extract(line, ORPHAN, 2), F.lit("")))


def _place_of(ord: str, line: str) -> Column:
    return F.struct(F.col("__digit").alias("digit"), F.length(F.regexp_extract(line, f"^{WS}*", 0)).alias("column"), F.col(ord).alias("at"))


def _placed_digit(line: str) -> Column:
    """The line with the digit of the line before, `__before`; NULL if it has no glyph or no place."""
    glyphs = F.create_map(*[F.lit(x) for pair in SUPERSCRIPTS.items() for x in pair])
    return insert_at(F.col(line), F.try_element_at(glyphs, F.col("__before.digit")), F.col("__before.column"))


def _items_where_they_lie(lines: DataFrame, keys: Sequence[str], is_start: Column, ord: str, line: str = "line") -> DataFrame:
    """`reinsert_orphans`, `fold_lines` and `items_of` of lines in one block, in one pass over the lines.

    Each item also tells `lost`, the numbers of its orphans that cannot be placed. One that holds nothing else has no text.
    """
    orphan = F.col("__digit").isNotNull()
    order = Window.partitionBy(*keys).orderBy(ord)
    digit = F.when(orphan, _place_of(ord, line))
    seen = _digits(lines, line).select("*", F.lag(digit).over(order).alias("__before"), F.lead(ord).over(order).isNull().alias("__ends"))
    placed, has = _placed_digit(line), F.col("__before").isNotNull()
    fixed = F.when(~orphan & has, F.coalesce(placed, F.col(line))).otherwise(F.col(line))
    lost = F.when(orphan & F.col("__ends"), F.col(ord)).when(~orphan & has & placed.isNull(), F.col("__before.at"))
    seen = seen.select(*keys, ord, (~orphan).alias("__body"), lost.alias("__lost"), fixed.alias(line))
    folded = fold_lines(seen, keys, F.col("__body") & is_start, ord, whole=True)
    indent = F.length(F.regexp_extract(line, f"^{WS}*", 0))
    row = F.struct(F.col(ord).alias("ord"), indent.alias("indent"), strip(F.col(line)).alias("line"))
    rows = folded.groupBy(*keys, "item").agg(
        F.array_sort(F.collect_list(F.when(F.col("__body"), row))).alias("held"), F.collect_list(F.col("__lost").cast("bigint")).alias("lost")
    )
    first = F.get("held", F.lit(0))
    text = F.when(F.size("held") > 0, rejoin(F.col("held.line")))
    return rows.select(*keys, "item", first["ord"].alias("ord"), first["indent"].alias("indent"), text.alias("text"), "lost")


def reinsert_orphans(
    lines: DataFrame, keys: Sequence[str], ord: str = "ord", line: str = "line", whole: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """Put a digit that stands alone on a line back into the next line, as a superscript, at its column.

    Returns the lines without the orphans, and the orphans that cannot be placed: an unmapped digit, a
    column beyond the next line, or no next line. `whole`: whether all lines are known to lie in one block; else they
    are read once to see.
    """
    whole = one_block(lines, ord) if whole is None else whole
    marked = _digits(lines, line)
    orphan = F.col("__digit").isNotNull()
    seen = running(marked, keys, [ord], block(ord), {"__before": ("last", _place_of(ord, line))}, inclusive=False, whole=whole)
    placed, has = _placed_digit(line), F.col("__before.digit").isNotNull()
    body = seen.where(~orphan)
    fixed = body.withColumn(line, F.when(has, F.coalesce(placed, F.col(line))).otherwise(F.col(line)))
    lost = body.where(has & placed.isNull()).select(*keys, F.col("__before.at").alias(ord))
    # An orphan that ends its group has no line to go to. Orphans right above another are overruled by it.
    last = marked.groupBy(*keys).agg(F.max(F.struct(ord, "__digit")).alias("last")).where("last.__digit IS NOT NULL")
    unread = last.select(*keys, F.col(f"last.{ord}").alias(ord))
    return fixed.drop("__before", "__digit"), lost.unionByName(unread)


def fold_lines(lines: DataFrame, keys: Sequence[str], is_start: Column, ord: str = "ord", *, whole: bool = False) -> DataFrame:
    """Number the item each line belongs to. Lines before the first marker form item 0."""
    start = F.when(is_start, 1).otherwise(0).cast("bigint")
    return running(lines, keys, [ord], block(ord), {"item": ("sum", start)}, whole=whole)


def items_of(
    folded: DataFrame,
    keys: Sequence[str],
    exceptions: Sequence[tuple[str, str]] = (),
    ord: str = "ord",
    line: str = "line",
) -> DataFrame:
    """One row per item: its first line number, the indent of that line, its lines and its text."""
    indent = F.length(F.regexp_extract(line, f"^{WS}*", 0))
    held = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("ord"), indent.alias("indent"), strip(F.col(line)).alias("line"))))
    rows = folded.groupBy(*keys, "item").agg(held.alias("held"))
    return rows.select(
        *keys,
        "item",
        F.col("held")[0]["ord"].alias("ord"),
        F.col("held")[0]["indent"].alias("indent"),
        F.col("held.line").alias("lines"),
    ).withColumn("text", rejoin(F.col("lines"), exceptions))


def unfired(items: DataFrame, exceptions: Sequence[tuple[str, str]]) -> DataFrame:
    """Named seams (after, before) that occur in no item: each must occur at least once."""
    items = items.select(seam_exceptions(F.col("lines"), exceptions).alias("__seams"))
    fired = [F.count_if(F.array_contains("__seams", i)).alias(f"n{i}") for i in range(len(exceptions))]
    pairs = [
        F.struct(F.lit(a).alias("after"), F.lit(b).alias("before"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(exceptions)
    ]
    return items.agg(*fired).select(F.inline(F.array(*pairs))).where("n = 0").select("after", "before")


def carry(lines: DataFrame, keys: Sequence[str], heading: Column, name: str, ord: str = "ord") -> DataFrame:
    """The latest heading at or above each row; NULL before the first."""
    return running(lines, keys, [ord], block(ord), {name: ("last", heading)})


def running_ids(df: DataFrame, keys: Sequence[str], group: str, name: str, ord: str = "ord") -> DataFrame:
    """`group-n`, n counting the rows of the group in order."""
    placed = numbered(df, [*keys, group], [ord], block(ord), "__n")
    return placed.withColumn(name, F.concat_ws("-", F.col(group), F.col("__n").cast("string"))).drop("__n")


def _computed_in_place(rows: DataFrame, doc: str) -> DataFrame:
    """The same rows, each column computed once (see `stage.computed`); rows dealt out by `doc` are still known to be."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c != doc]
    return rows.select(doc, F.inline(F.array(F.struct(*rest))))


class Rules(NamedTuple):
    """`tiers`: doc, ord, tier_id, label, and the count rule that its heading states inline, if any."""

    tiers: DataFrame
    criteria: DataFrame
    factors: DataFrame
    violations: DataFrame


def lines_to_rules(
    lines: DataFrame,
    doc: str,
    markers: dict[str, Column],
    tier_labels: Sequence[tuple[str, str]],
    group_suffixes: Sequence[str],
    page_marker: str,
    ord: str = "ord",
) -> Rules:
    """Lines of many documents as rule rows.

    `markers` names three headings: criteria, factors, end. In the first section an item that opens with
    a tier label sets the tier; one that ends with a colon opens a group and states its prerequisite; an
    indented item belongs to the group; any other is a criterion of its own and closes the group. In the
    second section a numbered item is a factor; one that asks for at least N of its parts is a parent.
    What follows a tier's label on its line is the tier's count rule. An item without an ordinal is a violation
    and no row. Documents of one block of lines are worked on where their lines lie: lines that are dealt by document
    are not shuffled again, and nothing is written; each section is then read once for each of the four tables.
    """
    whole = one_block(lines, ord)
    # Each running fold in chunks reads its rows twice, so chains of those start from written tables.
    held = (lambda df, name: _computed_in_place(df, doc)) if whole else cut
    sliced, missing = slice_between(lines, doc, markers, ord, whole=whole)
    first, second, _ = markers
    keys = [doc, "section"]
    body_lines = drop_noise(sliced, page_marker)
    body_lines = body_lines if whole else cut(body_lines, "rule-lines")
    start = F.col("line").rlike(ITEM_START)
    lost = None
    if not whole:
        text_lines, lost = reinsert_orphans(body_lines, keys, ord, whole=False)
        written = cut(items_of(fold_lines(text_lines, keys, start, ord), keys, ord=ord).drop("lines"), "rule-items")

    def items_in(section: str) -> DataFrame:
        """The items of a section; those of lines in one block tell their lost digits, and such as have no text are among them."""
        if not whole:
            return written.where(F.col("section") == section).withColumn("lost", F.array().cast("array<bigint>"))
        return _computed_in_place(_items_where_they_lie(body_lines.where(F.col("section") == section), keys, start, ord), doc)


    tier, label = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, tier_id in tier_labels:
        tier = tier.when(F.col("text").startswith(name), tier_id)
        label = label.when(F.col("text").startswith(name), name)
    parsed = split_ordinal(F.col("text"))
    defs = items_in(first).withColumns(
        {"tier_here": tier, "ordinal": parsed["ordinal"], "body": parsed["body"]}
    )
    opens = F.col("tier_here").isNull() & (F.col("indent") <= 1) & F.col("text").endswith("：")
    alone = F.col("tier_here").isNull() & (F.col("indent") <= 1) & ~F.col("text").endswith("：")
    closes = F.col("tier_here").isNotNull() | alone
    group = F.when(
        opens,
        F.struct(
            F.col("ord").alias("at"),
            F.col("text").alias("heading"),
            strip_suffix(F.col("body"), group_suffixes).alias("prerequisite"),
        ),
    ).when(closes, F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("prerequisite")))
    folds = {"tier_id": ("last", F.col("tier_here")), "grp": ("last", group)}
    told_heads = held(running(defs, [doc], ["ord"], block("ord"), folds, whole=whole), "rule-headings")
    headed = told_heads.where("text IS NOT NULL")
    tiers = headed.where("tier_here IS NOT NULL").select(doc, "ord", "tier_id", label.alias("label"), "text").select(
        doc, "ord", "tier_id", "label", F.nullif(F.substr("text", F.length("label") + 1), F.lit("")).alias("count_rule")
    )
    member = F.col("tier_here").isNull() & ~opens
    inside = member & F.col("tier_id").isNotNull() & (alone | F.col("grp.at").isNotNull())
    rows = headed.where(inside & F.col("body").isNotNull())
    # Flat items are numbered in brackets, nested ones with digits; another ordinal opens an item, but is not kept.
    bracketed = F.col("ordinal").rlike("^[(（]")
    rows = rows.select(
        doc, "ord", "tier_id", F.when(bracketed == alone, F.col("ordinal")).alias("ordinal"), F.col("body").alias("text"), alone.alias("flat"),
        F.when(~alone, F.col("grp.at")).alias("group_at"),
        F.when(~alone, F.col("grp.heading")).alias("group_heading"),
        F.when(~alone, F.col("grp.prerequisite")).alias("prerequisite"),
    )
    # A flat item or a tier heading closes a group, so a group's members follow each other in their tier.
    placed = running(
        rows, [doc, "tier_id"], ["ord"], block("ord"), {"n_before": ("sum", F.lit(1).cast("bigint")), "prev": ("last", F.struct("group_at"))}, inclusive=False, whole=whole,
    ).withColumn("n_tier", F.col("n_before") + 1)
    opening = ~F.col("flat") & ~F.col("group_at").eqNullSafe(F.col("prev.group_at"))
    counted = running(
        placed, [doc, "tier_id"], ["ord"], block("ord"),
        {"group_no": ("sum", F.when(opening, 1).otherwise(0).cast("bigint")), "opened_at": ("last", F.when(opening, F.col("n_tier")))}, whole=whole,
    ).withColumn("n_group", F.col("n_tier") - F.col("opened_at") + 1)
    group_id = F.when(~F.col("flat"), F.concat_ws("-", "tier_id", F.col("group_no").cast("string")))
    criteria = counted.withColumn("group_id", group_id).select(
        doc, "ord", "tier_id", "group_id", "group_heading", "prerequisite", "ordinal", "text",
        F.coalesce(
            F.concat(F.col("group_id"), F.lit("-"), F.col("n_group").cast("string")),
            F.concat(F.col("tier_id"), F.lit("-"), F.col("n_tier").cast("string")),
        ).alias("criterion_id"),
    )

    top = rf"^([{''.join(NUMERALS)}])、{WS}*([^\n]+)$"
    words = F.array(*[F.lit(n) for n in NUMERALS])
    is_top = F.col("text").rlike(top)
    body = F.when(is_top, F.regexp_extract("text", top, 2)).otherwise(parsed["body"])
    word = F.regexp_extract("text", top, 1)
    number = F.when(is_top, F.array_position(words, word))
    ordinal = F.when(is_top, F.concat(word, F.lit("、"))).when(parsed["ordinal"].rlike("^[(（]"), parsed["ordinal"])
    parts = items_in(second).withColumns(
        {"is_top": is_top, "body": body, "ordinal": ordinal, "factor_id": F.concat(F.lit("factor-"), number.cast("string"))}
    ).withColumn("required", F.when(F.col("is_top"), required_count(F.col("body"))))
    parent = F.when(
        F.col("is_top"),
        F.struct(F.when(F.col("required").isNotNull(), F.col("factor_id")).alias("id")),
    )
    told_parts = running(parts, [doc], ["ord"], block("ord"), {"parent": ("last", parent)}, whole=whole)
    under = told_parts.where("text IS NOT NULL")
    kept = under.where((F.col("is_top") | F.col("parent.id").isNotNull()) & F.col("body").isNotNull()).withColumn(
        "parent_id", F.when(~F.col("is_top"), F.col("parent.id"))
    )
    placed = numbered(
        kept.withColumn("__p", F.coalesce("parent_id", F.lit(""))), [doc, "__p"], ["ord"], block("ord"), "n", whole=whole
    )
    factors = placed.select(
        doc, "ord", "parent_id", "ordinal", "required", F.col("body").alias("text"),
        F.coalesce(F.concat(F.col("parent_id"), F.lit("-"), F.col("n").cast("string")), F.col("factor_id")).alias("factor_id"),
    )

    def broken(df: DataFrame, at: Column, what: Column) -> DataFrame:
        return df.select(F.col(doc), at.cast("bigint").alias("ord"), what.alias("violation"))

    def told(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
        """All that is wrong with a row, in one pass over the rows."""
        real, at = F.col("text").isNotNull(), F.col("ord").cast("bigint").alias("at")
        own = F.filter(F.array(*[F.when(real & odd, F.struct(at, F.lit(what).alias("what"))) for what, odd in rules]), lambda x: x.isNotNull())
        astray = F.transform("lost", lambda x: F.struct(x.alias("at"), F.lit("orphan digit").alias("what")))
        return broken(df.select(doc, F.inline(F.concat(own, astray))), F.col("at"), F.col("what"))

    in_tier = F.col("tier_id").isNotNull()
    in_heads = [
        ("item before any tier", ~in_tier),
        ("nested item outside a group", member & ~alone & in_tier & F.col("grp.at").isNull()),
        ("unknown group wording", opens & F.col("body").isNotNull() & strip_suffix(F.col("body"), group_suffixes).isNull()),
        ("item without ordinal", (inside | opens) & in_tier & F.col("body").isNull()),
    ]
    in_parts = [
        ("part outside a factor", ~F.col("is_top") & F.col("parent.id").isNull()),
        ("item without ordinal", ~F.col("is_top") & F.col("parent.id").isNotNull() & F.col("body").isNull()),
    ]
    found = (
        broken(missing, F.lit(None), F.concat(F.lit("missing "), F.col("marker")))
        .unionByName(told(told_heads, in_heads))
        .unionByName(told(told_parts, in_parts))
    )
    if lost is not None:
        found = found.unionByName(broken(lost, F.col(ord), F.lit("orphan digit")))
    return Rules(tiers, criteria, factors, found)
