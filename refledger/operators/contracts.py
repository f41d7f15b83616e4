"""Dataset contracts. Each check returns violations: (check_id, dataset, key, detail).

A publish job stops if any check returns a row. No check collects a group; all are filters, joins on
the key, or aggregates. Keys that may be nearly unique are dealt out before they are added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.text import same_without_ws
from refledger.operators import history
from refledger.operators.prefix import block, numbered
from refledger.operators.stage import dealt
from refledger.operators.words import held_words

# Registers of a sketch, as a power of two.
SKETCH = 12


def violations(rows: DataFrame, check_id: str, dataset: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(
        F.lit(check_id).alias("check_id"),
        F.lit(dataset).alias("dataset"),
        key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def _known(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys, under another name."""
    return dealt(rows.select(F.col(key).alias(name)), name).distinct()


def _each(rows: DataFrame, n: str, step: int = 1 << 16) -> DataFrame:
    """Each row as many times as its column `n` says. A large number is taken in steps, so that no list is long."""
    since = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n), F.lit(step).cast("bigint")))
    blocks = rows.withColumn("__since", since)
    last = F.least(F.col("__since") + step - 1, F.col(n))
    return blocks.withColumn("__copy", F.explode(F.sequence(F.col("__since"), last))).drop("__since", "__copy")


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def all_of_checks(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def stop_on_any(checks: DataFrame) -> None:
    """Raise if there is a violation. Reads the first one only."""
    first = checks.limit(1).collect()
    if first:
        raise ValueError(f"contract broken: {first[0].check_id} on {first[0].dataset}: {first[0].detail}")


def findings(steps: dict[str, DataFrame]) -> DataFrame:
    """One row per step of a build, with the number of its findings: step, n_findings."""
    counted = [df.agg(F.count("*").alias("n_findings")).select(F.lit(step).alias("step"), "n_findings") for step, df in steps.items()]
    return reduce(DataFrame.unionByName, counted)


def expect_count(df: DataFrame, n: int | Column, dataset: str) -> DataFrame:
    counted = df.agg(F.count("*").alias("n")).where(F.col("n") != n)
    return violations(counted, "count", dataset, F.lit(""), F.col("n"))


def expect_valid(df: DataFrame, rules: dict[str, Column], dataset: str, key: Sequence[str]) -> DataFrame:
    """One violation per row and rule that does not hold; a rule that yields NULL does not hold."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]),
        lambda r: r.isNotNull(),
    )
    rows = df.select(_key(key).alias("k"), F.explode(broken).alias("rule"))
    return violations(rows, "valid", dataset, F.col("k"), F.col("rule"))


def expect_invariant(df: DataFrame, key: str, cols: Sequence[str], dataset: str, row_no: str = "row_no") -> DataFrame:
    """Columns that must not vary within a key. Reports rows and column, never the value."""
    cells = df.select(
        key,
        row_no,
        F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])),
    )
    values = cells.groupBy(key, "field", "value").agg(F.min(row_no).alias("first_row"))
    firsts = values.groupBy(key, "field").agg(F.min("first_row").alias("kept_row"), F.count("*").alias("n"))
    differing = (
        values.join(firsts.where("n > 1"), [key, "field"])
        .where("first_row > kept_row")
        .groupBy(key, "field", "kept_row")
        .agg(F.min("first_row").alias("other_row"))
    )
    detail = F.concat_ws(" ", F.lit("rows"), "kept_row", F.lit("and"), "other_row", F.lit("differ in"), "field")
    return violations(differing, "invariant", dataset, F.col(key), detail)


def _cells(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(*keys, F.inline(F.array(*cells)))


def column_sketches(df: DataFrame, cols: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """Per part and column a sketch of its distinct values: (part columns, field, sketch).

    Sketches of parts are kept with them and add up to that of the whole, so a new part costs a scan of itself. NULL is
    no value. A sketch has 4,096 registers and a standard error of 1.6 %.
    """
    return _cells(df, cols, part).groupBy(*part, "field").agg(F.hll_sketch_agg("value", SKETCH).alias("sketch"))


def far_below(sketches: DataFrame, n: int, margin: float = 0.1) -> list[str]:
    """Columns whose merged sketch is below the bound by a margin of six standard errors."""
    merged = sketches.groupBy("field").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    return [r.field for r in merged.where(F.col("n") * (1 + margin) < n).collect()]


def expect_cardinality(df: DataFrame, cols: Sequence[str], n: int, dataset: str, sketches: DataFrame | None = None) -> DataFrame:
    """Columns with more than n distinct values.

    With `sketches`, of `column_sketches`, a column that is far below the bound is not read; the others are counted.
    """
    if sketches is not None:
        clear = set(far_below(sketches, n))
        cols = [c for c in cols if c not in clear]
    if not cols:
        return violations(df.sparkSession.createDataFrame([], "field string, n long"), "cardinality", dataset, F.col("field"), F.col("n"))
    distinct = (
        _cells(df, cols)
        .groupBy("field", "value")
        .agg(F.lit(1).alias("one"))
        .where("value IS NOT NULL")
        .groupBy("field")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > n)
    )
    return violations(distinct, "cardinality", dataset, F.col("field"), F.col("n"))


def expect_disjoint(periods: DataFrame, key: str, dataset: str, ord: str = "ord") -> DataFrame:
    found = history.overlaps(periods, key, ord)
    detail = F.concat_ws(" ", F.lit("rows"), "earlier_ord", F.lit("and"), F.col(ord), F.lit("overlap"))
    return violations(found, "disjoint", dataset, F.col(key), detail)


def expect_contiguous(df: DataFrame, keys: Sequence[str], ord: str, number: str, dataset: str) -> DataFrame:
    """The n-th row of each group carries number n."""
    placed = numbered(df, keys, [ord], block(ord), "place").where(~F.col("place").eqNullSafe(F.col(number)))
    detail = F.concat_ws(" ", F.lit("place"), "place", F.lit("carries"), F.col(number).cast("string"))
    return violations(placed, "contiguous", dataset, _key([*keys, ord]), detail)


def expect_unique(df: DataFrame, key: Sequence[str], dataset: str) -> DataFrame:
    repeated = dealt(df.select(*key), *key).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return violations(repeated, "unique", dataset, _key(key), F.col("n"))


def expect_ref(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, dataset: str) -> DataFrame:
    """References that name no parent, one violation per child row."""
    known = _known(parent, parent_key, child_key)
    counted = dealt(child.select(child_key), child_key).groupBy(child_key).agg(F.count("*").alias("__n"))
    odd = _each(counted.join(known, child_key, "left_anti"), "__n")
    return violations(odd, "reference", dataset, F.col(child_key), F.lit("unknown"))


def expect_parent_first(df: DataFrame, id_: str, parent: str, ord: str, dataset: str) -> DataFrame:
    """A parent is declared on an earlier row than its child."""
    declared = df.groupBy(F.col(id_).alias("__parent")).agg(F.min(ord).alias("__parent_ord"))
    rows = df.where(F.col(parent).isNotNull())
    late = rows.join(declared, rows[parent] == declared["__parent"], "left").where(
        ~F.coalesce(F.col("__parent_ord") < F.col(ord), F.lit(False))
    )
    return violations(late, "parent_first", dataset, F.col(id_), F.col(parent))


def expect_one_owner(df: DataFrame, member: str, owner: str, dataset: str) -> DataFrame:
    """Members that more than one owner claims."""
    claimed = df.groupBy(member).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).where("a <> b")
    return violations(claimed, "one_owner", dataset, F.col(member), F.concat_ws(" ", "a", "b"))


def expect_children(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, dataset: str) -> DataFrame:
    """Parents that no child names."""
    named = _known(child, child_key, parent_key)
    rows = dealt(parent.select(parent_key), parent_key)
    return violations(rows.join(named, parent_key, "left_anti"), "children", dataset, F.col(parent_key), F.lit("none"))


def expect_enough(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, required: str, dataset: str) -> DataFrame:
    """Parents with fewer children than they require."""
    counted = child.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias("__n"))
    held = F.coalesce("__n", F.lit(0))
    few = parent.join(counted, parent_key, "left").where(held < F.col(required))
    detail = F.concat_ws(" of ", held.cast("string"), F.col(required).cast("string"))
    return violations(few, "enough", dataset, F.col(parent_key), detail)


def expect_null_together(df: DataFrame, a: str, b: str, dataset: str, key: Sequence[str]) -> DataFrame:
    odd = df.where(F.col(a).isNull() != F.col(b).isNull())
    detail = F.when(F.col(a).isNull(), f"{b} without {a}").otherwise(f"{a} without {b}")
    return violations(odd, "null_together", dataset, _key(key), detail)


def expect_same_text(df: DataFrame, heading: str, text: str, dataset: str) -> DataFrame:
    """Rows under one heading carry one text."""
    # Texts of a heading are few, so a hot heading is a few rows once its texts are distinct.
    texts = dealt(df.where(F.col(heading).isNotNull()).select(heading, text), heading, text).distinct()
    mixed = dealt(texts, heading).groupBy(heading).agg(F.min(text).alias("a"), F.max(text).alias("b"))
    return violations(mixed.where("a <> b"), "same_text", dataset, F.col(heading), F.lit("texts differ"))


def expect_nonempty(df: DataFrame, cols: Sequence[str], dataset: str, key: Sequence[str]) -> DataFrame:
    """Texts and arrays that must hold something."""
    types = dict(df.dtypes)
    rules = {c: (F.size(c) > 0) if types[c].startswith("array") else (F.col(c) != "") for c in cols}
    return expect_valid(df, rules, dataset, key).withColumn("check_id", F.lit("nonempty"))


# Words of a sequence that may stand in the plan; more of them become a table.
FEW_WORDS = 32


def expect_absent(df: DataFrame, cols: Sequence[str], words: Sequence[str] | DataFrame, dataset: str, key: Sequence[str]) -> DataFrame:
    """Words that must occur in none of the columns, letter case counting; a table of words has a column `word`."""
    if not isinstance(words, DataFrame) and len(words) > FEW_WORDS:
        words = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
    if isinstance(words, DataFrame):
        found = held_words(df.select(_key(key).alias("k"), *cols), cols, words)
        return violations(found.select("k", F.explode("held").alias("word")), "absent", dataset, F.col("k"), F.col("word"))
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), F.col(c).alias("text")) for w in words for c in cols])
    found = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(p.text, p.word)), lambda p: p.word))
    rows = df.select(_key(key).alias("k"), F.explode(found).alias("word"))
    return violations(rows, "absent", dataset, F.col("k"), F.col("word"))


def expect_framed(df: DataFrame, head: Column, tail: str, text: str, dataset: str, key: Sequence[str]) -> DataFrame:
    """A block opens with its own heading and closes with a full stop."""
    rules = {"head": F.col(text).startswith(head), "tail": F.col(text).endswith(tail)}
    return expect_valid(df, rules, dataset, key).withColumn("check_id", F.lit("framed"))


def expect_verbatim(df: DataFrame, text: str, lines: str, dataset: str, key: Sequence[str]) -> DataFrame:
    """A joined text may add spaces to its lines; it may not change a character."""
    changed = df.where(~same_without_ws(F.col(text), F.col(lines)))
    return violations(changed, "verbatim", dataset, _key(key), F.lit("differs from its lines"))


def expect_partition(df: DataFrame, flag: str, dataset: str) -> DataFrame:
    """Rows with and without the flag add up to all rows; a NULL flag breaks that."""
    sums = df.agg(F.count("*").alias("n"), F.count_if(flag).alias("yes"), F.count_if(~F.col(flag)).alias("no"))
    return violations(sums.where("yes + no <> n"), "partition", dataset, F.lit(flag), F.col("n") - F.col("yes") - F.col("no"))


class KeyCheck(NamedTuple):
    """A check on keys of a table: `unique`, `ref` and `children` (both with another table's key), or `same_text`."""

    kind: str
    dataset: str
    table: str
    key: Sequence[str]
    other: str | None = None
    other_key: Sequence[str] = ()
    value: str | None = None


def keyed_suite(tables: dict[str, DataFrame], checks: Sequence[KeyCheck]) -> DataFrame:
    """Violations of all checks, with one scan of each table and one aggregate for all.

    A row tells each check its key, on which side it stands and what it holds; these are added up per check and key, at
    first within tasks, so a hot key is a few rows by the time it is shuffled. The rows are those of `expect_unique`,
    `expect_ref`, `expect_children` and `expect_same_text`. A null key refers to nothing and is no reference.
    """

    def told(n: int, side: int, key: Sequence[str], value: str | None) -> Column:
        held = F.lit(None) if value is None else F.col(value)
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
        return F.struct(F.lit(n).alias("n"), F.array(*[F.col(c).cast("string") for c in key]).alias("key"), missing.alias("missing"), F.lit(side).alias("side"), held.cast("string").alias("value"))

    facts: dict[str, list[Column]] = {}
    for n, check in enumerate(checks):
        facts.setdefault(check.table, []).append(told(n, 0, check.key, check.value))
        if check.other is not None:
            facts.setdefault(check.other, []).append(told(n, 1, check.other_key, None))
    rows = reduce(DataFrame.unionByName, [tables[name].select(F.inline(F.array(*own))) for name, own in facts.items()])
    ledger = rows.groupBy("n", "key", "missing").agg(
        F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("there"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    kinds = {kind: F.col("n").isin([n for n, c in enumerate(checks) if c.kind == kind]) for kind in ("unique", "ref", "children", "same_text")}
    unnamed = (F.col("there") == 0) | F.col("missing")
    broken = (
        (kinds["unique"] & (F.col("own") > 1))
        | ((kinds["ref"] | kinds["children"]) & (F.col("own") > 0) & unnamed)
        | (kinds["same_text"] & ~F.col("missing") & (F.col("low") != F.col("high")))
    )
    # References and parents are reported row by row, the others key by key.
    each = F.when(kinds["ref"] | kinds["children"], F.col("own")).otherwise(F.lit(1))
    found = ledger.where(broken).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), each)))
    check_id = F.element_at(F.array(*[F.lit(c.kind if c.kind != "ref" else "reference") for c in checks]), F.col("n") + 1)
    dataset = F.element_at(F.array(*[F.lit(c.dataset) for c in checks]), F.col("n") + 1)
    words = F.element_at(F.array(*[F.lit({"ref": "unknown", "children": "none", "same_text": "texts differ"}.get(c.kind, "")) for c in checks]), F.col("n") + 1)
    key = F.when(F.col("missing") & (kinds["ref"] | kinds["children"]), F.lit(None)).otherwise(F.concat_ws("|", "key"))
    return found.select(
        check_id.alias("check_id"), dataset.alias("dataset"), key.alias("key"), F.when(kinds["unique"], F.col("own").cast("string")).otherwise(words).alias("detail")
    )
