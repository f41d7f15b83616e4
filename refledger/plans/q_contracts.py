"""Contracts: F03, H03-H13, and the suites over clean and over broken input."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.operators import contracts, lines
from refledger.plans.registry import Tables, query


@query(
    "f03_order_contiguity",
    """SELECT 'contiguous' AS check_id, 'lineitem' AS dataset, CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING) AS key,
              'place ' || CAST(rn AS STRING) || ' carries ' || CAST(l_linenumber AS STRING) AS detail FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn
         FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM {lineitem})) WHERE rn <> l_linenumber""",
)
def f03(t: Tables):
    rows = t["lineitem"].select("l_orderkey", "l_linenumber").distinct()
    return contracts.expect_contiguous(rows, ["l_orderkey"], "l_linenumber", "l_linenumber", "lineitem")


@query(
    "f03_whole_table_contiguity",
    """SELECT 'contiguous' AS check_id, 'part' AS dataset, CAST(p_partkey AS STRING) AS key,
              'place ' || CAST(row_number() OVER (ORDER BY p_partkey) AS STRING) || ' carries ' || CAST(p_partkey AS STRING) AS detail FROM {part}""",
)
def f03_whole(t: Tables):
    """Part keys start at zero, so all of them are off by one. The table is one group, cut into blocks."""
    return contracts.expect_contiguous(t["part"], [], "p_partkey", "p_partkey", "part")


@query(
    "h03_duplicate_keys",
    """SELECT 'unique' AS check_id, 'lineitem' AS dataset, CAST(l_orderkey AS STRING) || '|' || CAST(l_linenumber AS STRING) AS key,
              CAST(COUNT(*) AS STRING) AS detail FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
)
def h03(t: Tables):
    return contracts.expect_unique(t["lineitem"], ["l_orderkey", "l_linenumber"], "lineitem")


@query(
    "h04_referential_check",
    """SELECT 'reference' AS check_id, 'documents' AS dataset, CAST(doc_id AS STRING) AS key, 'unknown' AS detail
       FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})
       UNION ALL SELECT 'reference', 'lineitem', CAST(l_orderkey AS STRING), 'unknown' FROM {lineitem}
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders})""",
)
def h04(t: Tables):
    return contracts.expect_ref(t["documents"], t["labels"], "doc_id", "doc_id", "documents").unionByName(
        contracts.expect_ref(t["lineitem"], t["orders"], "l_orderkey", "o_orderkey", "lineitem")
    )


@query(
    "h04b_parent_declared_first",
    """SELECT 'parent_first' AS check_id, 'customer' AS dataset, CAST(a.c_custkey AS STRING) AS key, CAST(a.c_nationkey * 50 AS STRING) AS detail
       FROM {customer} a LEFT JOIN {customer} b ON b.c_custkey = a.c_nationkey * 50 WHERE NOT COALESCE(b.c_custkey < a.c_custkey, false)""",
)
def h04b(t: Tables):
    """Customers who name another as their sponsor, some of them one that comes later."""
    rows = t["customer"].select("c_custkey", (F.col("c_nationkey") * 50).cast("bigint").alias("sponsor"))
    return contracts.expect_parent_first(rows, "c_custkey", "sponsor", "c_custkey", "customer")


@query(
    "h05_one_owner",
    """SELECT 'one_owner' AS check_id, 'orders' AS dataset, CAST(l_orderkey AS STRING) AS key,
              CAST(MIN(l_suppkey) AS STRING) || ' ' || CAST(MAX(l_suppkey) AS STRING) AS detail
       FROM {lineitem} GROUP BY l_orderkey HAVING MIN(l_suppkey) <> MAX(l_suppkey)""",
)
def h05(t: Tables):
    return contracts.expect_one_owner(t["lineitem"], "l_orderkey", "l_suppkey", "orders")


@query(
    "h06_childless_parents",
    """SELECT 'children' AS check_id, 'orders' AS dataset, CAST(o_orderkey AS STRING) AS key, 'none' AS detail
       FROM {orders} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem})""",
)
def h06(t: Tables):
    return contracts.expect_children(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey", "orders")


@query(
    "h07_enough_children",
    """SELECT 'enough' AS check_id, 'turns' AS dataset, p.factor_id AS key, CAST(COUNT(c.factor_id) AS STRING) || ' of 3' AS detail
       FROM {turns} p LEFT JOIN {turns} c ON c.parent_id = p.factor_id WHERE p.required = 3 GROUP BY p.factor_id HAVING COUNT(c.factor_id) < 3""",
)
def h07(t: Tables):
    turns = t["turns"]
    children = turns.where("parent_id IS NOT NULL").select(F.col("parent_id"))
    parents = turns.where("required IS NOT NULL").select("factor_id", "required")
    return contracts.expect_enough(parents, children, "factor_id", "parent_id", "required", "turns")


@query(
    "h08_null_together",
    """SELECT 'null_together' AS check_id, 'announcement' AS dataset, code AS key,
              CASE WHEN effective_date IS NULL THEN 'price_after without effective_date' ELSE 'effective_date without price_after' END AS detail
       FROM {announcement} WHERE (effective_date IS NULL) <> (price_after IS NULL)""",
)
def h08(t: Tables):
    return contracts.expect_null_together(t["announcement"], "price_after", "effective_date", "announcement", ["code"])


@query(
    "h09_same_text_under_heading",
    """SELECT 'same_text' AS check_id, 'orders' AS dataset, CAST(o_custkey AS STRING) AS key, 'texts differ' AS detail FROM {orders}
       GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderpriority) > 1""",
)
def h09(t: Tables):
    return contracts.expect_same_text(t["orders"], "o_custkey", "o_orderpriority", "orders")


@query(
    "h10_non_empty",
    """SELECT 'nonempty' AS check_id, 'items' AS dataset, code AS key, 'spec_amount' AS detail FROM {items} WHERE spec_amount = ''
       UNION ALL SELECT 'nonempty', 'items', code, 'parts' FROM {items} WHERE spec_unit = ''""",
)
def h10(t: Tables):
    rows = t["items"].withColumn("parts", F.filter(F.array("spec_unit"), lambda x: x != ""))
    return contracts.expect_nonempty(rows, ["spec_amount", "parts"], "items", ["code"])


@query(
    "h11_forbidden_content",
    """SELECT 'absent' AS check_id, 'documents' AS dataset, CAST(doc_id AS STRING) AS key, 'http' AS detail FROM {documents} WHERE contains(text, 'http')
       UNION ALL SELECT 'absent', 'documents', CAST(doc_id AS STRING), 'tion the' FROM {documents} WHERE contains(text, 'tion the')
       UNION ALL SELECT 'absent', 'documents', CAST(doc_id AS STRING), 'License' FROM {documents} WHERE contains(text, 'License')""",
)
def h11(t: Tables):
    return contracts.expect_absent(t["documents"], ["text"], ["http", "tion the", "License"], "documents", ["doc_id"])


@query(
    "h12_absent_over_columns",
    """SELECT 'absent' AS check_id, 'items' AS dataset, code AS key, w AS detail FROM {items}, (SELECT unnest(['RING', 'Brand#9', 'PCSK9']) AS w)
       WHERE contains(ingredient, w) OR contains(name_en, w) OR contains(name_zh, w)""",
)
def h12(t: Tables):
    words = ["RING", "Brand#9", "PCSK9"]
    return contracts.expect_absent(t["items"], ["ingredient", "name_en", "name_zh"], words, "items", ["code"])


# Word lists as tables that grow with the data: words of the benchmark, and of two columns of parts.
LISTED_SQL = "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM {benchmark}) WHERE length(w) >= 4"
PART_WORDS_SQL = "SELECT DISTINCT p_type AS word FROM {part} UNION SELECT DISTINCT p_brand FROM {part} UNION SELECT DISTINCT p_name FROM {part} WHERE p_partkey % 9 = 0"


def listed(t: Tables):
    words = t["benchmark"].select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word"))
    return words.where(F.length("word") >= 4).distinct()


@query(
    "h11_forbidden_word_table",
    f"""WITH w AS ({LISTED_SQL}) SELECT 'absent' AS check_id, 'documents' AS dataset, CAST(doc_id AS STRING) AS key, word AS detail
        FROM {{documents}} JOIN w ON contains(text, word)""",
)
def h11_table(t: Tables):
    """Every word of the benchmark that a document holds, also inside a longer word."""
    return contracts.expect_absent(t["documents"], ["text"], listed(t), "documents", ["doc_id"])


@query(
    "h12_absent_word_table",
    f"""WITH w AS ({PART_WORDS_SQL}) SELECT 'absent' AS check_id, 'items' AS dataset, code AS key, word AS detail FROM {{items}} JOIN w
        ON contains(ingredient, word) OR contains(name_en, word) OR contains(name_zh, word)""",
)
def h12_table(t: Tables):
    part = t["part"]
    names = part.where("p_partkey % 9 = 0").select("p_name")
    words = part.select("p_type").union(part.select("p_brand")).union(names).toDF("word")
    return contracts.expect_absent(t["items"], ["ingredient", "name_en", "name_zh"], words, "items", ["code"])


@query(
    "h13_framed_blocks",
    """SELECT 'framed' AS check_id, 'documents' AS dataset, CAST(doc_id AS STRING) || '|' || CAST(ord AS STRING) AS key, rule AS detail FROM (
         SELECT doc_id, ord, 'head' AS rule FROM {o_lines} WHERE NOT starts_with(line, 'The')
         UNION ALL SELECT doc_id, ord, 'tail' FROM {o_lines} WHERE NOT ends_with(line, '.'))""",
)
def h13(t: Tables):
    rows = lines.to_lines(t["documents"], "doc_id", "text")
    return contracts.expect_framed(rows, F.lit("The"), ".", "line", "documents", ["doc_id", "ord"])


SUITE_SQL = """SELECT check_id, COUNT(*) AS n FROM (
         SELECT 'unique' AS check_id FROM {lineitem} GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
         UNION ALL SELECT 'children' FROM {orders} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem})
         UNION ALL SELECT 'same_text' FROM {orders} GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderstatus) > 1) GROUP BY check_id"""


@query("contract_suite_on_sources", SUITE_SQL)
def suite(t: Tables):
    """Several checks as one suite; each breach is a row, and clean checks add none."""
    checks = contracts.all_of_checks(
        [
            contracts.expect_unique(t["lineitem"], ["l_orderkey", "l_linenumber"], "lineitem"),
            contracts.expect_unique(t["orders"], ["o_orderkey"], "orders"),
            contracts.expect_ref(t["lineitem"], t["part"], "l_partkey", "p_partkey", "lineitem"),
            contracts.expect_children(t["orders"], t["lineitem"], "o_orderkey", "l_orderkey", "orders"),
            contracts.expect_same_text(t["orders"], "o_custkey", "o_orderstatus", "orders"),
        ]
    )
    return checks.groupBy("check_id").agg(F.count("*").alias("n"))


@query("contract_suite_in_one_pass", SUITE_SQL)
def suite_in_one_pass(t: Tables):
    """The same checks from one scan of each table."""
    check = contracts.KeyCheck
    checks = [
        check("unique", "lineitem", "lineitem", ["l_orderkey", "l_linenumber"]),
        check("unique", "orders", "orders", ["o_orderkey"]),
        check("ref", "lineitem", "lineitem", ["l_partkey"], "part", ["p_partkey"]),
        check("children", "orders", "orders", ["o_orderkey"], "lineitem", ["l_orderkey"]),
        check("same_text", "orders", "orders", ["o_custkey"], value="o_orderstatus"),
    ]
    found = contracts.keyed_suite({name: t[name] for name in ("lineitem", "orders", "part")}, checks)
    return found.groupBy("check_id").agg(F.count("*").alias("n"))


@query(
    "f01_expect_disjoint",
    """SELECT 'disjoint' AS check_id, 'periods' AS dataset, code AS key, COUNT(*) AS n FROM (
         SELECT code, start_date, MAX(end_date) OVER (PARTITION BY code ORDER BY start_date, end_date, ord
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM {broken_periods}) WHERE start_date <= covered GROUP BY code""",
)
def f01_check(t: Tables):
    found = contracts.expect_disjoint(t["broken_periods"], "code", "periods").unionByName(
        contracts.expect_disjoint(t["periods"], "code", "clean")
    )
    return found.groupBy("check_id", "dataset", "key").agg(F.count("*").alias("n"))
