"""Merging and joining: A07, A11, D02, D03, D05-D10, D12, D14, D15, D17, E13, E14, K04-K06, K10."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.operators import contracts, reconcile
from refledger.plans.bindings import DATASET
from refledger.plans.registry import Tables, query
from refledger.sources.publish import drift
from refledger.sources.versions import keyed_diff, keyed_drift, publish_keyed, read_keyed
from refledger.sources.workspace import fresh_path

MERGE_SQL = """
    WITH s AS (SELECT 1 AS src_no, row_no, code, name_en, exception_note, NULL AS ingredient, NULL AS manufacturer, NULL AS ingredient_category FROM {source1}
               UNION ALL SELECT 2, row_no, code, name_en, exception_note, NULL, NULL, NULL FROM {source2}
               UNION ALL SELECT 3, row_no, code, name_en, NULL, ingredient, manufacturer, NULL FROM {source3}
               UNION ALL SELECT 4, row_no, code, name_en, exception_note, NULL, NULL, ingredient_category FROM {source4}),
         c AS (SELECT code, src_no, row_no, 'name_en' AS field, NULLIF(name_en, '') AS v FROM s
               UNION ALL SELECT code, src_no, row_no, 'exception_note', NULLIF(exception_note, '') FROM s
               UNION ALL SELECT code, src_no, row_no, 'ingredient', NULLIF(ingredient, '') FROM s
               UNION ALL SELECT code, src_no, row_no, 'manufacturer', NULLIF(manufacturer, '') FROM s
               UNION ALL SELECT code, src_no, row_no, 'ingredient_category', NULLIF(ingredient_category, '') FROM s),
         f AS (SELECT *, first_value(v) OVER (PARTITION BY code, field ORDER BY src_no, row_no) AS v1 FROM c WHERE v IS NOT NULL)
"""


def merged(t: Tables):
    return reconcile.merge_sources([t[f"source{i}"] for i in (1, 2, 3, 4)], "code")


@query(
    "d14_multi_source_merge",
    MERGE_SQL
    + """SELECT code, MIN(src_no) AS src_no,
                COALESCE(MAX(v1) FILTER (field = 'name_en'), '') AS name_en, COALESCE(MAX(v1) FILTER (field = 'exception_note'), '') AS exception_note,
                COALESCE(MAX(v1) FILTER (field = 'ingredient'), '') AS ingredient, COALESCE(MAX(v1) FILTER (field = 'manufacturer'), '') AS manufacturer,
                COALESCE(MAX(v1) FILTER (field = 'ingredient_category'), '') AS ingredient_category
         FROM f GROUP BY code""",
)
def d14(t: Tables):
    return merged(t).records.drop("row_no").na.fill("")


@query(
    "d14_merge_conflicts",
    MERGE_SQL
    + """SELECT code, field, v1 AS kept, v AS refused, src_no FROM f WHERE v <> v1
         QUALIFY row_number() OVER (PARTITION BY code, field ORDER BY src_no, row_no) = 1""",
)
def d14_conflicts(t: Tables):
    return merged(t).conflicts.select("code", "field", "kept", "refused", "src_no")


@query(
    "k10_build_announcement",
    MERGE_SQL
    + """SELECT 'conflicts' AS part, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT DISTINCT code, field FROM f WHERE v <> v1)
         UNION ALL SELECT 'records', COUNT(DISTINCT code) FROM s
         UNION ALL SELECT 'repeated_codes', 0
         UNION ALL SELECT 'nameless', 0""",
)
def k10(t: Tables):
    """The merge as a publish job sees it: records, and what each contract finds."""
    sources = [t[f"source{i}"] for i in (1, 2, 3, 4)]
    records, conflicts = reconcile.merge_sources(sources, "code")
    repeated = contracts.all_of_checks([contracts.expect_unique(s, ["code"], "source") for s in sources])
    nameless = contracts.expect_nonempty(records, ["name_en"], "announcement", ["code"])
    parts = {"records": records, "conflicts": conflicts, "repeated_codes": repeated, "nameless": nameless}
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p, df in parts.items()]
    return contracts.all_of_checks(counts)


@query(
    "d02_announcement_join",
    """SELECT i.code, a.code IS NOT NULL AS announced, COALESCE(a.coverage_rule, '') AS coverage_rule
       FROM {items} i LEFT JOIN {announcement} a ON a.code = i.code""",
)
def d02(t: Tables):
    records = t["announcement"].select("code", "coverage_rule")
    return reconcile.attach_announcement(t["items"].select("code"), records).select(
        "code", "announced", F.coalesce("coverage_rule", F.lit("")).alias("coverage_rule")
    )


@query(
    "d03_membership",
    """SELECT i.code, a.code IS NOT NULL AS announced, COALESCE(a.price_before IS NOT NULL AND a.price_after IS NOT NULL, false) AS changed
       FROM {items} i LEFT JOIN {announcement} a ON a.code = i.code""",
)
def d03(t: Tables):
    return reconcile.membership(t["items"].select("code"), t["announcement"]).select("code", "announced", "changed")


@query(
    "d05_price_comparison",
    """SELECT code, price_before, price_after, effective_date, coverage_rule FROM {announcement} JOIN {items} USING (code)
       WHERE price_before IS NOT NULL AND price_after IS NOT NULL AND effective_date IS NOT NULL AND coverage_rule IS NOT NULL""",
)
def d05(t: Tables):
    return reconcile.price_comparison(t["items"].select("code"), t["announcement"])


@query(
    "e13_changed_count",
    """SELECT p_brand, COUNT(*) FILTER (a.price_before IS NOT NULL AND a.price_after IS NOT NULL) AS n_changed, COUNT(*) AS n
       FROM {items} i LEFT JOIN {announcement} a ON a.code = i.code GROUP BY p_brand""",
)
def e13(t: Tables):
    marked = reconcile.membership(t["items"].select("code", "p_brand"), t["announcement"])
    return marked.groupBy("p_brand").agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n"))


@query(
    "e14_partition_identity",
    """SELECT 'partition' AS check_id, 'documents' AS dataset, 'toxic' AS key, CAST(COUNT(*) FILTER (doc_id NOT IN (SELECT doc_id FROM {labels})) AS STRING) AS detail
       FROM {documents}""",
)
def e14(t: Tables):
    """Repriced and unchanged items add up to all; documents without a label break the same identity."""
    marked = reconcile.membership(t["items"].select("code"), t["announcement"])
    flags = t["documents"].join(t["labels"], "doc_id", "left").select((F.col("toxic") == 1).alias("toxic"))
    return contracts.expect_partition(marked, "changed", "items").unionByName(
        contracts.expect_partition(flags, "toxic", "documents")
    )


@query(
    "d06_nest_children",
    """SELECT c_custkey, COALESCE(o_orderkey, -1) AS o_orderkey,
              CASE WHEN o_orderkey IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) END AS child_no
       FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey""",
)
def d06(t: Tables):
    children = t["orders"].select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = reconcile.nest(t["customer"].select("c_custkey"), children, "c_custkey", "o_orderkey")
    return rows.na.fill({"o_orderkey": -1, "child_no": 0})


@query(
    "k05_rules_with_conditions",
    """SELECT 'R' || CAST(o_orderkey AS STRING) AS rule_id, pos, code, row_number() OVER (PARTITION BY rule_id ORDER BY pos) AS child_no
       FROM {orders} JOIN {listed} ON rule_id = 'R' || CAST(o_orderkey AS STRING)""",
)
def k05(t: Tables):
    rules = t.sql("SELECT 'R' || CAST(o_orderkey AS STRING) AS rule_id FROM {orders}")
    return reconcile.nest(rules, t["listed"], "rule_id", "pos")


CODES_SQL = """
    WITH g AS MATERIALIZED (SELECT *, COALESCE(TRY_CAST(as_of AS DATE) IS NOT NULL AND as_of BETWEEN '1995-06-01' AND '2001-12-31', false)
                      AND rule_id IN (SELECT rule_id FROM {listed}) AS ok FROM {rule_requests}),
         p AS MATERIALIZED (SELECT r.rule_id, l.code, MIN(price_raw) AS price_raw FROM g r JOIN {listed} l ON l.rule_id = r.rule_id AND r.ok
               JOIN {periods} p ON p.code = l.code AND CAST(r.as_of AS DATE) BETWEEN p.start_date AND p.end_date GROUP BY ALL HAVING COUNT(*) = 1),
         c AS (SELECT g.rule_id, l.pos, l.code, p.price_raw FROM g JOIN {listed} l ON l.rule_id = g.rule_id AND g.ok
               LEFT JOIN p ON p.rule_id = l.rule_id AND p.code = l.code)
"""


# Distinct (code, day) pairs first: each step is a table, and every join is on equal keys.
RESOLVED_SQL = """
    WITH r AS MATERIALIZED (SELECT rule_id, TRY_CAST(as_of AS DATE) AS day FROM {rule_requests} WHERE as_of BETWEEN '1995-06-01' AND '2001-12-31'),
         l AS MATERIALIZED (SELECT rule_id, pos, code FROM {listed}),
         s AS MATERIALIZED (SELECT code, start_date, end_date, price_raw FROM {periods}),
         a AS MATERIALIZED (SELECT r.rule_id, r.day, l.pos, l.code FROM r JOIN l ON l.rule_id = r.rule_id WHERE r.day IS NOT NULL),
         d AS MATERIALIZED (SELECT DISTINCT code, day FROM a),
         h AS MATERIALIZED (SELECT d.code, d.day, MIN(price_raw) AS price_raw, COUNT(*) AS n FROM d JOIN s ON s.code = d.code
               WHERE d.day >= s.start_date AND d.day <= s.end_date GROUP BY d.code, d.day)
    SELECT a.rule_id, a.pos, a.code, CASE WHEN h.n = 1 THEN h.price_raw ELSE 'unresolved' END AS price_raw
    FROM a LEFT JOIN h ON h.code = a.code AND h.day = a.day
"""


@query("d07_resolve_code_list", RESOLVED_SQL)
def d07(t: Tables):
    codes = reconcile.exception_listing(t["rule_requests"], t["listed"], t["items"], t["periods"], DATASET)[1]
    return codes.select("rule_id", "pos", "code", F.coalesce("price_raw", F.lit("unresolved")).alias("price_raw"))


@query(
    "k04_exception_listing",
    CODES_SQL
    + """SELECT request_id, CASE WHEN ok THEN 'OK' ELSE 'NOT_IN_VALIDATED_DATASET' END AS status,
                COUNT(price_raw) AS n_resolved, COUNT(code) - COUNT(price_raw) AS n_unresolved
         FROM g LEFT JOIN c ON c.rule_id = g.rule_id AND g.ok GROUP BY request_id, ok""",
)
def k04(t: Tables):
    results = reconcile.exception_listing(t["rule_requests"], t["listed"], t["items"], t["periods"], DATASET)[0]
    return results.select("request_id", "status", "n_resolved", "n_unresolved")


def _notes(t: Tables):
    """Suppliers as notes: those in credit name their nation and the next, the others name none."""
    pair = F.array("s_nationkey", F.col("s_nationkey") + 1)
    return t["supplier"].select(
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("note"), F.when(F.col("s_acctbal") >= 6000, pair).alias("applies_to")
    )


@query(
    "d08_notes_for_tier",
    """SELECT n_nationkey, COALESCE(s_suppkey, -1) AS ord FROM {nation} LEFT JOIN {supplier}
         ON s_acctbal >= 6000 AND n_nationkey IN (s_nationkey, s_nationkey + 1)""",
)
def d08(t: Tables):
    tiers = t["nation"].select("n_nationkey")
    return reconcile.notes_for(tiers, _notes(t), "n_nationkey").select("n_nationkey", "ord").na.fill(-1)


@query(
    "d09_unscoped_note",
    "SELECT s_suppkey AS ord, s_name AS note FROM {supplier} WHERE NOT (s_acctbal >= 6000) ORDER BY s_suppkey LIMIT 1",
)
def d09(t: Tables):
    return reconcile.unscoped(_notes(t)).select("ord", "note")


@query(
    "k06_notes_of_customers",
    """SELECT c_custkey, COUNT(s_suppkey) AS n_notes, COALESCE(MIN(s_suppkey), -1) AS first_note FROM {customer} LEFT JOIN {supplier}
         ON s_acctbal >= 6000 AND c_nationkey IN (s_nationkey, s_nationkey + 1) GROUP BY c_custkey""",
)
def k06(t: Tables):
    """Notes for every customer's tier, their nation; the lists are joined per nation, not per customer."""
    per_tier = reconcile.notes_for(t["nation"].select("n_nationkey"), _notes(t), "n_nationkey")
    counted = per_tier.groupBy("n_nationkey").agg(F.count("ord").alias("n_notes"), F.min("ord").alias("first_note"))
    customers = t["customer"].select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return customers.join(counted, "n_nationkey").select("c_custkey", "n_notes", "first_note").na.fill(-1)


@query(
    "d10_alias_self_join",
    """SELECT c.criterion_id, l.group_id AS twin_group FROM {criteria} c
       JOIN (SELECT prerequisite_label, arg_max(group_id, ord) AS group_id FROM {criteria} GROUP BY prerequisite_label) l
         ON rtrim(c.text, '。') = l.prerequisite_label AND c.group_id <> l.group_id""",
)
def d10(t: Tables):
    return reconcile.aliases(t["criteria"])


@query(
    "d12_parent_child",
    """SELECT p.factor_id AS parent_id, c.factor_id AS child_id FROM {turns} p JOIN {turns} c ON c.parent_id = p.factor_id""",
)
def d12(t: Tables):
    return reconcile.children_of(t["turns"]).select("parent_id", "child_id")


@query(
    "d15_reconcile_keys",
    """SELECT COALESCE(a.code, b.code) AS code, CASE WHEN b.code IS NULL THEN 'left_only' WHEN a.code IS NULL THEN 'right_only' ELSE 'both' END AS side
       FROM (SELECT DISTINCT code FROM {source1}) a FULL JOIN (SELECT DISTINCT code FROM {source3}) b ON a.code = b.code""",
)
def d15(t: Tables):
    return reconcile.reconcile(t["source1"], t["source3"], "code")


def _headed(t: Tables):
    rows = t["documents"].select("doc_id", F.when(F.col("lang") != "en", F.concat_ws(":", "source", "lang")).alias("heading"))
    blocks = t["documents"].where("lang IN ('fr', 'de')").groupBy(F.concat_ws(":", "source", "lang").alias("heading"))
    return reconcile.attach_by_heading(rows, blocks.agg(F.max("n_chars").alias("block")))


@query(
    "d17_attach_by_heading",
    """SELECT d.doc_id, COALESCE(b.block, -1) AS block FROM {documents} d LEFT JOIN (
         SELECT source, lang, MAX(n_chars) AS block FROM {documents} WHERE lang IN ('fr', 'de') GROUP BY source, lang) b
       ON d.source = b.source AND d.lang = b.lang AND d.lang <> 'en'""",
)
def d17(t: Tables):
    return _headed(t)[0].select("doc_id", "block").na.fill(-1)


@query(
    "d17_headings_without_block",
    "SELECT doc_id, source || ':' || lang AS heading FROM {documents} WHERE lang NOT IN ('en', 'fr', 'de')",
)
def d17_missing(t: Tables):
    return _headed(t)[1].select("doc_id", "heading")


DRIFTED = """SELECT p_partkey, side, 1 AS copies FROM (
         SELECT *, 'published' AS side FROM (SELECT * FROM {snapshot_old} EXCEPT ALL SELECT * FROM {snapshot_new})
         UNION ALL SELECT *, 'derived' FROM (SELECT * FROM {snapshot_new} EXCEPT ALL SELECT * FROM {snapshot_old}))"""


@query("a07_drift_check", DRIFTED)
def a07(t: Tables):
    return drift(t["snapshot_old"], t["snapshot_new"]).select("p_partkey", "side", "copies")


@query(
    "a07_drift_of_copies",
    """SELECT l_orderkey, l_linenumber, COUNT(*) - 1 AS copies, 'published' AS side FROM {lineitem}
       GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""",
)
def a07_copies(t: Tables):
    """Copies count: line keys against their distinct set."""
    keys = t["lineitem"].select("l_orderkey", "l_linenumber")
    return drift(keys, keys.distinct())


SNAPSHOT_CHANGES = """SELECT COALESCE(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'added' WHEN b.p_partkey IS NULL THEN 'removed'
              WHEN a.price = b.price THEN 'same' ELSE 'changed' END AS change
       FROM {snapshot_old} a FULL JOIN {snapshot_new} b ON a.p_partkey = b.p_partkey"""


@query("a11_snapshot_diff", SNAPSHOT_CHANGES)
def a11(t: Tables):
    return reconcile.snapshot_diff(t["snapshot_old"], t["snapshot_new"], "p_partkey")


def _versions(t: Tables, old: str, new: str, key: str):
    """Two bindings published as versions that are compared by their digests."""
    path = fresh_path(t.spark, "versions")
    for name in (old, new):
        publish_keyed(t[name], path, name, key)
    return [read_keyed(t.spark, path, name) for name in (old, new)]


@query("a11_diff_by_digests", SNAPSHOT_CHANGES)
def a11_digests(t: Tables):
    """The same between published versions, of which only leaves with other digests are read whole."""
    return keyed_diff(*_versions(t, "snapshot_old", "snapshot_new", "p_partkey"), "p_partkey", same=True)


@query("a07_drift_by_digests", DRIFTED)
def a07_digests(t: Tables):
    return keyed_drift(*_versions(t, "snapshot_old", "snapshot_new", "p_partkey")).select("p_partkey", "side", "copies")
