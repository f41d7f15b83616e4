"""Lines and documents: C13, F04-F07, F09, K11, K12."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.operators import contracts, lines
from refledger.plans.bindings import rule_lines
from refledger.plans.registry import Tables, query
from refledger.sources.workspace import cut

MARKERS = ("●CRITERIA：", "●FACTORS：", "●END：")
TIERS = (("一、Tier A：", "a"), ("二、Tier B：", "b"))
SUFFIXES = ("，包含：",)
PAGE = "PAGE HEADER"


def document_lines(t: Tables):
    return lines.to_lines(t["documents"], "doc_id", "text").withColumn("ord", F.col("ord").cast("bigint"))


def markers():
    return {m: F.col("line") == m for m in MARKERS}


def rules_of(t: Tables):
    return lines.lines_to_rules(t["rule_lines"], "doc", markers(), TIERS, SUFFIXES, PAGE)


@query(
    "c13_drop_noise_lines",
    "SELECT doc, ord, line FROM {rule_lines} WHERE trim(line) <> '' AND NOT contains(line, 'PAGE HEADER')",
)
def c13(t: Tables):
    return lines.drop_noise(t["rule_lines"], PAGE)


@query(
    "f04_fold_lines",
    r"""SELECT doc_id, item, MIN(ord) AS ord, COUNT(*) AS n_lines, md5(string_agg(part, '' ORDER BY ord)) AS digest FROM (
          SELECT doc_id, ord, item, CASE WHEN prev IS NOT NULL AND (regexp_matches(prev, '[A-Za-z0-9]$') OR regexp_matches(line, '^[A-Za-z0-9]'))
                 AND NOT (regexp_matches(prev, '-$') OR regexp_matches(line, '^-')) THEN ' ' ELSE '' END || line AS part
          FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id, item ORDER BY ord) AS prev
                FROM (SELECT doc_id, ord, line, SUM(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS item FROM {o_lines})))
        GROUP BY doc_id, item""",
)
def f04(t: Tables):
    """An item opens with each line that starts with a T."""
    folded = lines.fold_lines(document_lines(t), ["doc_id"], F.col("line").startswith("T"))
    items = lines.items_of(folded, ["doc_id"])
    return items.select("doc_id", "item", "ord", F.size("lines").cast("bigint").alias("n_lines"), F.md5("text").alias("digest"))


@query(
    "f05_carry_heading",
    """SELECT doc_id, ord, COALESCE(last_value(CASE WHEN length(line) <= 25 THEN line END IGNORE NULLS) OVER (
              PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 'none') AS heading FROM {o_lines}""",
)
def f05(t: Tables):
    """Short lines are headings of the lines below them."""
    carried = lines.carry(document_lines(t), ["doc_id"], F.when(F.length("line") <= 25, F.col("line")), "heading")
    return carried.select("doc_id", "ord", F.coalesce("heading", F.lit("none")).alias("heading"))


@query(
    "f05_carry_user_turn",
    """SELECT conv_id, turn, COALESCE(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
              PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS asked_at FROM {conversations}""",
)
def f05_turns(t: Tables):
    """The user turn that each reply answers."""
    turns = t["conversations"]
    carried = lines.carry(turns, ["conv_id"], F.when(F.col("role") == "user", F.col("turn")), "asked_at", "turn")
    return carried.select("conv_id", "turn", F.coalesce("asked_at", F.lit(-1)).alias("asked_at"))


SLICE_SQL = """
    WITH a AS (SELECT doc_id, MIN(ord) AS a FROM {o_lines} WHERE starts_with(line, 'T') GROUP BY doc_id),
         b AS (SELECT l.doc_id, a.a, MIN(ord) AS b FROM {o_lines} l JOIN a ON a.doc_id = l.doc_id WHERE ord > a.a AND length(line) <= 60 GROUP BY l.doc_id, a.a),
         c AS (SELECT l.doc_id, b.a, b.b, MIN(ord) AS c FROM {o_lines} l JOIN b ON b.doc_id = l.doc_id WHERE ord > b.b AND starts_with(line, 'O') GROUP BY l.doc_id, b.a, b.b)
"""


def _sliced(t: Tables):
    marks = {"first": F.col("line").startswith("T"), "second": F.length("line") <= 60, "end": F.col("line").startswith("O")}
    return lines.slice_between(document_lines(t), "doc_id", marks)


@query(
    "f06_slice_between_markers",
    SLICE_SQL
    + """SELECT l.doc_id, l.ord, CASE WHEN l.ord < c.b THEN 'first' ELSE 'second' END AS section FROM {o_lines} l JOIN c ON c.doc_id = l.doc_id
         WHERE l.ord > c.a AND l.ord < c.c AND l.ord <> c.b""",
)
def f06(t: Tables):
    return _sliced(t)[0].select("doc_id", "ord", "section")


@query(
    "f06_missing_markers",
    SLICE_SQL
    + """SELECT doc_id, 'first' AS marker FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM a)
         UNION ALL SELECT doc_id, 'second' FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM b)
         UNION ALL SELECT doc_id, 'end' FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM c)""",
)
def f06_missing(t: Tables):
    return _sliced(t)[1]


@query(
    "f07_running_ids",
    """SELECT doc_id, ord, substr(line, 1, 1) || '-' || CAST(row_number() OVER (PARTITION BY doc_id, substr(line, 1, 1) ORDER BY ord) AS STRING) AS id FROM {o_lines}""",
)
def f07(t: Tables):
    """Lines numbered within their document by first letter."""
    rows = document_lines(t).withColumn("initial", F.substring("line", 1, 1))
    return lines.running_ids(rows, ["doc_id"], "initial", "id").select("doc_id", "ord", "id")


ORPHAN_SQL = """
    WITH o AS (SELECT doc, ord, line, lag(line) OVER (PARTITION BY doc ORDER BY ord) AS prev,
                      lead(line) OVER (PARTITION BY doc ORDER BY ord) AS nxt FROM {rule_lines})
"""


@query(
    "f09_reinsert_orphans",
    ORPHAN_SQL
    + r"""SELECT doc, ord, CASE WHEN regexp_full_match(prev, '\s*2\s*') AND length(line) >= 10 THEN left(line, 10) || '²' || substr(line, 11) ELSE line END AS line
          FROM o WHERE NOT regexp_full_match(line, '\s*\d\s*')""",
)
def f09(t: Tables):
    """Digits that stand alone go back into the line below, at their column."""
    return lines.reinsert_orphans(t["rule_lines"], ["doc"])[0].select("doc", "ord", "line")


@query(
    "f09_unplaced_orphans",
    """SELECT doc_id, ord FROM (SELECT doc_id, ord, right(line, 1) AS c, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS nxt FROM {o_lines}) WHERE nxt IS NULL""",
)
def f09_unplaced(t: Tables):
    """Each document's last line, made an orphan, has no line below it to go to."""
    rows = document_lines(t)
    last = rows.groupBy("doc_id").agg(F.max("ord").alias("last"))
    edited = rows.join(last, "doc_id").withColumn("line", F.when(F.col("ord") == F.col("last"), "  2").otherwise(F.col("line")))
    return lines.reinsert_orphans(edited.select("doc_id", "ord", "line"), ["doc_id"])[1]


CRITERIA_SQL = """
    WITH h AS (SELECT *, MAX(CASE WHEN flag = 'R' THEN ln ELSE 0 END) OVER (PARTITION BY doc ORDER BY ln) > 0 AS in_b FROM {rule_parts}),
         r AS (SELECT doc, CASE WHEN in_b THEN 'b' ELSE 'a' END AS tier_id, ln, 0 AS sub, name, size, st,
                      1 AS one FROM h WHERE flag = 'N'
               UNION ALL SELECT doc, CASE WHEN in_b THEN 'b' ELSE 'a' END, ln, 1, name, size, st, 1 FROM h WHERE flag = 'A'
               UNION ALL SELECT doc, CASE WHEN in_b THEN 'b' ELSE 'a' END, ln, 2, name, size, st, 1 FROM h WHERE flag = 'A'),
         n AS (SELECT *, row_number() OVER (PARTITION BY doc, tier_id ORDER BY ln, sub) AS n_tier,
                      SUM(CASE WHEN sub = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, tier_id ORDER BY ln, sub) AS g FROM r)
"""


@query(
    "k12_lines_to_criteria",
    CRITERIA_SQL
    + """SELECT doc, tier_id, CASE WHEN sub = 0 THEN '' ELSE tier_id || '-' || CAST(g AS STRING) END AS group_id,
                CASE WHEN sub = 0 THEN tier_id || '-' || CAST(n_tier AS STRING) ELSE tier_id || '-' || CAST(g AS STRING) || '-' || CAST(sub AS STRING) END AS criterion_id,
                CASE WHEN sub = 0 THEN '' ELSE name END AS prerequisite, CASE sub WHEN 0 THEN '(二)' WHEN 1 THEN '1.' ELSE '2.' END AS ordinal,
                CASE sub WHEN 0 THEN 'flat ' || name WHEN 2 THEN '第' || CAST(size AS STRING) || '項'
                     ELSE 'view of ' || CASE WHEN st = 'F' THEN left(name, 3) || '²' || substr(name, 4) ELSE name END || ' m' END AS text,
                CASE WHEN sub = 0 THEN '' ELSE '(一)' || name || '，包含：' END AS group_heading,
                CAST(ln * 10 + CASE sub WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 0 END AS BIGINT) AS ord FROM n""",
)
def k12(t: Tables):
    found = rules_of(t).criteria
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return found.select(
        "doc", "tier_id", blank("group_id"), "criterion_id", blank("prerequisite"), "ordinal", "text", blank("group_heading"),
        F.col("ord").cast("bigint").alias("ord"),
    )


FACTORS_SQL = """
    SELECT doc, 'factor-' || CAST(ln AS STRING) AS factor_id, substr('一二三四五六七', ln, 1) || '、' AS ordinal, '' AS parent_id, CASE WHEN st = 'O' THEN 2 ELSE 0 END AS required,
           name || CASE WHEN st = 'O' THEN '符合以下至少二項：' ELSE '' END AS text FROM {rule_parts}
    UNION ALL SELECT doc, 'factor-' || CAST(ln AS STRING) || '-1', '(一)', 'factor-' || CAST(ln AS STRING), 0, 'part one' FROM {rule_parts} WHERE st = 'O'
    UNION ALL SELECT doc, 'factor-' || CAST(ln AS STRING) || '-2', '(二)', 'factor-' || CAST(ln AS STRING), 0, 'part two of-' || name FROM {rule_parts} WHERE st = 'O'
"""


@query("k12_lines_to_factors", FACTORS_SQL)
def k12_factors(t: Tables):
    found = rules_of(t).factors
    return found.select(
        "doc", "factor_id", "ordinal", F.coalesce("parent_id", F.lit("")).alias("parent_id"),
        F.coalesce("required", F.lit(0).cast("bigint")).alias("required"), "text",
    )


@query(
    "k12_lines_to_tiers",
    """SELECT doc, CAST(2 AS BIGINT) AS ord, 'a' AS tier_id, '一、Tier A：' AS label, 'one of ' || CAST(COUNT(*) AS STRING) AS count_rule FROM {rule_parts} GROUP BY doc
       UNION ALL SELECT doc, ln * 10, 'b', '二、Tier B：', '' FROM {rule_parts} WHERE flag = 'R'""",
)
def k12_tiers(t: Tables):
    """A tier whose heading states a count rule on the same line keeps it."""
    n = t["rule_parts"].groupBy("doc").agg(F.count("*").cast("string").alias("n"))
    stated = F.when(F.col("line") == TIERS[0][0], F.concat("line", F.lit("one of "), "n")).otherwise(F.col("line"))
    told = t["rule_lines"].join(n, "doc").withColumn("line", stated).drop("n")
    found = lines.lines_to_rules(told, "doc", markers(), TIERS, SUFFIXES, PAGE).tiers
    return found.select("doc", F.col("ord").cast("bigint").alias("ord"), "tier_id", "label", F.coalesce("count_rule", F.lit("")).alias("count_rule"))


@query(
    "k12_items_without_ordinal",
    """SELECT doc, MIN(ln) * 10 AS ord, 'item without ordinal' AS violation FROM {rule_parts} WHERE flag = 'N'
       GROUP BY doc HAVING MIN(ln) = (SELECT MIN(p.ln) FROM {rule_parts} p WHERE p.doc = rule_parts.doc)""",
)
def k12_bare(t: Tables):
    """The section's first item, if flat, loses its ordinal: no line before it can take it in."""
    bare = (F.col("ord") == F.col("first") * 10) & F.col("line").startswith("(二) flat")
    told = rule_lines(t["rule_parts"], keep=["first"]).where("doc IS NOT NULL").withColumn("line", F.when(bare, F.regexp_replace("line", "^[(]二[)] flat", "● flat")).otherwise(F.col("line")))
    found = lines.lines_to_rules(told.drop("first"), "doc", markers(), TIERS, SUFFIXES, PAGE).violations
    return found.select("doc", "ord", "violation")


@query(
    "k12_layout_violations",
    """SELECT doc, violation, COUNT(*) AS n FROM (
         SELECT doc, 'item before any tier' AS violation FROM (
           SELECT doc, ln, flag, MIN(CASE WHEN flag = 'R' THEN ln ELSE 99 END) OVER (PARTITION BY doc) AS first_tier FROM {rule_parts}), (VALUES (1), (2), (3)) v(i)
         WHERE ln < first_tier AND (flag = 'N' AND i = 1 OR flag = 'A')) GROUP BY doc, violation""",
)
def k12_violations(t: Tables):
    """Without the first tier heading, every item above the first other heading is reported."""
    headless = t["rule_lines"].where(F.col("line") != TIERS[0][0])
    found = lines.lines_to_rules(headless, "doc", markers(), TIERS, SUFFIXES, PAGE).violations
    return found.groupBy("doc", "violation").agg(F.count("*").alias("n"))


@query(
    "k11_build_rule_tables",
    "WITH f AS ("
    + FACTORS_SQL
    + """) SELECT check_id, COUNT(*) AS n FROM (
         SELECT 'one_owner' AS check_id FROM f WHERE parent_id = '' GROUP BY text HAVING MIN(doc) <> MAX(doc)
         UNION ALL SELECT 'same_text' FROM f GROUP BY factor_id HAVING MIN(text) <> MAX(text)) GROUP BY check_id""",
)
def k11(t: Tables):
    """Rule rows out of lines, through the checks a publish job runs on them."""
    built = rules_of(t)
    criteria = cut(built.criteria, "criteria").withColumn("key", F.concat_ws("/", "doc", "criterion_id"))
    factors = cut(built.factors, "factors").withColumns(
        {"key": F.concat_ws("/", "doc", "factor_id"), "parent": F.concat(F.col("doc").cast("string"), F.lit("/"), F.col("parent_id"))}
    )
    parents = factors.where("required IS NOT NULL")
    children = factors.where("parent_id IS NOT NULL")
    checks = contracts.all_of_checks(
        [
            contracts.expect_unique(criteria, ["key"], "criteria"),
            contracts.expect_unique(factors, ["key"], "factors"),
            contracts.expect_nonempty(criteria, ["text"], "criteria", ["key"]),
            contracts.expect_null_together(criteria, "group_id", "prerequisite", "criteria", ["key"]),
            contracts.expect_null_together(criteria, "group_id", "group_heading", "criteria", ["key"]),
            contracts.expect_ref(children, factors, "parent", "key", "factors"),
            contracts.expect_parent_first(factors.withColumn("at", F.struct("doc", "ord")), "key", "parent", "at", "factors"),
            contracts.expect_enough(parents, children, "key", "parent", "required", "factors"),
            contracts.expect_one_owner(factors.where("parent_id IS NULL"), "text", "doc", "factors"),
            contracts.expect_same_text(factors, "factor_id", "text", "factors"),
        ]
    )
    return checks.groupBy("check_id").agg(F.count("*").alias("n"))


@query(
    "b21_verbatim_items",
    """SELECT CAST(0 AS BIGINT) AS n_changed, COUNT(*) AS n_items FROM (
         SELECT DISTINCT doc_id, SUM(CASE WHEN starts_with(line, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS item FROM {o_lines})""",
)
def b21_items(t: Tables):
    """Folding and rejoining every document changes no character but whitespace."""
    items = lines.items_of(lines.fold_lines(document_lines(t), ["doc_id"], F.col("line").startswith("T")), ["doc_id"])
    changed = contracts.expect_verbatim(items, "text", "lines", "documents", ["doc_id", "item"])
    both = items.agg(F.lit(0).cast("bigint").alias("n_changed"), F.count("*").alias("n_items")).unionByName(
        changed.agg(F.count("*").alias("n_changed"), F.lit(0).cast("bigint").alias("n_items"))
    )
    return both.agg(F.sum("n_changed").alias("n_changed"), F.sum("n_items").alias("n_items"))

