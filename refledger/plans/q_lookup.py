"""Lookups: C01-C04, C08, C12, D04, D16, A12, E07, E08, K01, K02."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.functions.text import is_code, norm_code, norm_name, search_text
from refledger.operators import lookup
from refledger.operators.history import store_history
from refledger.operators.reconcile import membership
from refledger.operators.search import holds_all, search
from refledger.plans.bindings import DATASET
from refledger.plans.registry import Tables, query
from refledger.sources.workspace import fresh_path

FIELDS = ("name_zh", "name_en", "ingredient")


MASTER_LOOKUP = """SELECT g.request_id, g.as_of, CASE WHEN n_matches = 1 THEN 'EXACT_MATCH' WHEN n_matches > 1 THEN 'MULTIPLE_MATCHES'
                ELSE 'NOT_IN_VALIDATED_DATASET' END AS status, COALESCE(n_matches, 0) <> 1 AS manual_review,
              COALESCE(n_matches, 0) AS n_matches, COALESCE(excluded_zero, 0) AS excluded_zero
       FROM {o_gated} g LEFT JOIN {o_counts} c ON g.answerable AND c.query = g.query AND c.as_of = g.as_of"""
RESULT = ("request_id", "as_of", "status", "manual_review", "n_matches", "excluded_zero")


@query("k01_master_lookup", MASTER_LOOKUP)
def k01(t: Tables):
    return lookup.master_lookup(t["requests"], t["items"], t["periods"], DATASET, FIELDS).results.select(*RESULT)


@query("k01_master_lookup_stored_history", MASTER_LOOKUP)
def k01_stored(t: Tables):
    """The same with prices from a history that is stored by code."""
    stored = store_history(t["periods"], "code", ["price_raw"], fresh_path(t.spark, "history"))
    return lookup.master_lookup(t["requests"], t["items"], stored, DATASET, FIELDS).results.select(*RESULT)


@query(
    "k01_master_lookup_matches",
    """SELECT query, as_of, code, price_raw FROM {o_priced} WHERE TRY_CAST(price_raw AS DOUBLE) IS DISTINCT FROM 0""",
)
def k01_matches(t: Tables):
    found = lookup.master_lookup(t["requests"], t["items"], t["periods"], DATASET, FIELDS)
    return found.matches.select("query", "as_of", "code", "price_raw")


@query(
    "k02_announcement_lookup",
    """WITH g AS (SELECT *, COALESCE(as_of >= '1995-06-01' AND COALESCE(dataset_version, 'v1') = 'v1', false) AS ok FROM {phrase_requests}),
            q AS (SELECT DISTINCT query, upper(regexp_replace(query, '[\\s-]', '', 'g')) AS c,
                         trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) AS p FROM g WHERE ok),
            m AS (SELECT q.query, COUNT(*) AS n FROM q JOIN {announcement} a
                    ON CASE WHEN regexp_full_match(c, '[A-Z0-9]{{10}}') THEN a.code = c
                            ELSE p <> '' AND (contains(lower(name_en), p) OR COALESCE(contains(lower(ingredient), p), false)
                                              OR contains(lower(category), p)) END GROUP BY q.query)
       SELECT request_id, COALESCE(n, 0) AS n_matches, CASE WHEN n = 1 THEN 'EXACT_MATCH' WHEN n > 1 THEN 'MULTIPLE_MATCHES'
              ELSE 'NOT_IN_VALIDATED_DATASET' END AS status, n IS DISTINCT FROM 1 AS manual_review
       FROM g LEFT JOIN m ON g.ok AND g.query = m.query""",
)
def k02(t: Tables):
    found = lookup.announcement_lookup(t["phrase_requests"], t["announcement"], DATASET)
    return found.results.select("request_id", "status", "manual_review", "n_matches")


@query(
    "c01_exact_code",
    "SELECT query, code, ord FROM {o_code_hits}",
)
def c01(t: Tables):
    _, asks = lookup.gated(t["requests"], DATASET, "upper")
    asked = asks.select("query").distinct().withColumn("as_code", norm_code(F.col("query")))
    return lookup.match_code(asked, "as_code", t["items"].select("code", "ord")).select("query", "code", "ord")


@query(
    "c02_all_terms_any_field",
    r"""SELECT o_orderkey, len(list_filter(string_split(lower(p_name || ' ' || o_orderpriority), ' '),
              lambda w: NOT (contains(f_en, w) OR contains(f_zh, w) OR contains(f_in, w)))) = 0 AS hit
        FROM {orders} JOIN {o_fields} ON ord = o_custkey""",
)
def c02(t: Tables):
    """Row-local form: does the item of the order hold every word of a text?"""
    rows = t["orders"].join(t["items"], F.col("ord") == F.col("o_custkey"))
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "o_orderpriority")), " ")
    return lookup.with_haystack(rows, FIELDS).select("o_orderkey", holds_all(F.col("hay"), words).alias("hit"))


@query(
    "c03_phrase_any_field",
    """SELECT q, code FROM (SELECT DISTINCT lower(p_name) AS q FROM {part}) JOIN {announcement}
         ON contains(lower(name_en), q) OR COALESCE(contains(lower(ingredient), q), false)""",
)
def c03(t: Tables):
    names = t["part"].select(norm_name(F.col("p_name")).alias("q"))
    records = lookup.with_haystack(t["announcement"], ["name_en", "ingredient"], norm_name).select("code", "hay")
    return search(names, "q", records, "hay", phrase=True).select("q", "code")


@query(
    "c04_code_then_terms",
    "SELECT query, code, ord FROM {o_candidates}",
)
def c04(t: Tables):
    _, asks = lookup.gated(t["requests"], DATASET, "upper")
    return lookup.code_then_terms(asks, t["items"], FIELDS)


@query(
    "d04_term_search",
    r"""SELECT q, code FROM (SELECT DISTINCT lower(p_name) || ' ' || lower(p_brand) AS q FROM {part}) JOIN {o_fields}
         ON len(list_filter(string_split(q, ' '), lambda w: NOT (contains(f_en, w) OR contains(f_zh, w) OR contains(f_in, w)))) = 0""",
)
def d04(t: Tables):
    """Each name with its brand, sought in all items: every term in any field."""
    asked = t["part"].select(search_text(F.concat_ws(" ", "p_name", "p_brand")).alias("q"))
    return search(asked, "q", lookup.with_haystack(t["items"], FIELDS).select("code", "hay"), "hay").select("q", "code")


@query(
    "d04_short_term_search",
    r"""SELECT q, code FROM (SELECT DISTINCT lower(substr(p_name, 1, 2)) || ' ' || lower(substr(p_type, 1, 1)) AS q FROM {part}) JOIN {o_fields}
         ON len(list_filter(string_split(q, ' '), lambda w: NOT (contains(f_en, w) OR contains(f_zh, w) OR contains(f_in, w)))) = 0""",
)
def d04_short(t: Tables):
    """Terms of one and two characters, which have no trigram."""
    asked = t["part"].select(F.lower(F.concat_ws(" ", F.substring("p_name", 1, 2), F.substring("p_type", 1, 1))).alias("q"))
    return search(asked, "q", lookup.with_haystack(t["items"], FIELDS).select("code", "hay"), "hay").select("q", "code")


@query("c08_request_gate", "SELECT request_id, answerable FROM {o_gated}")
def c08(t: Tables):
    return lookup.gated(t["requests"], DATASET, "upper")[0].select("request_id", "answerable")


@query(
    "c08b_request_gate_bounds",
    """SELECT request_id, COALESCE(valid AND as_of >= '1995-06-01', false) AS lower_ok,
              COALESCE(valid AND as_of BETWEEN '1995-06-01' AND '2001-12-31', false) AS both_ok
       FROM (SELECT *, regexp_full_match(as_of, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(as_of AS DATE) IS NOT NULL
                       AND COALESCE(dataset_version, 'v1') = 'v1' AS valid FROM {requests})""",
)
def c08b(t: Tables):
    args = (F.col("as_of"), F.col("dataset_version"), DATASET)
    return t["requests"].select(
        "request_id", lookup.gate(*args, "lower").alias("lower_ok"), lookup.gate(*args, "both").alias("both_ok")
    )


@query(
    "a12_version_resolve",
    """SELECT request_id, n_name AS dataset, 'v' || CAST(n_regionkey AS STRING) AS current_version FROM {requests} JOIN {nation} ON n_nationkey = request_id % 25
       WHERE COALESCE(NULLIF(trim(dataset_version), ''), 'v' || CAST(n_regionkey AS STRING)) = 'v' || CAST(n_regionkey AS STRING)""",
)
def a12(t: Tables):
    """Nations as datasets with a current version each; requests that name another version get no row."""
    registry = t.sql("SELECT n_nationkey, n_name AS dataset, 'v' || CAST(n_regionkey AS STRING) AS current_version FROM {nation}")
    named = t["requests"].join(registry.select("n_nationkey", "dataset"), F.pmod("request_id", F.lit(25)) == F.col("n_nationkey"))
    return lookup.resolve_version(named, registry).select("request_id", "dataset", "current_version")


@query(
    "d16_version_range_semi_join",
    "SELECT query, as_of, COUNT(*) AS n FROM {o_gated} WHERE answerable GROUP BY query, as_of",
)
def d16(t: Tables):
    flagged, asks = lookup.gated(t["requests"], DATASET, "upper")
    return flagged.where("answerable").join(asks, ["query", "as_of"], "left_semi").groupBy("query", "as_of").agg(
        F.count("*").alias("n")
    )


@query(
    "e07_excluded_counts",
    "SELECT query, as_of, excluded_zero FROM {o_counts} WHERE excluded_zero > 0",
)
def e07(t: Tables):
    found = lookup.master_lookup(t["requests"], t["items"], t["periods"], DATASET, FIELDS)
    return found.results.where("excluded_zero > 0").select("query", "as_of", "excluded_zero").distinct()


@query(
    "e08_lookup_status",
    """SELECT CASE WHEN n_matches = 1 THEN 'EXACT_MATCH' WHEN n_matches > 1 THEN 'MULTIPLE_MATCHES'
                ELSE 'NOT_IN_VALIDATED_DATASET' END AS status, COUNT(*) AS n
       FROM {o_gated} g LEFT JOIN {o_counts} c ON g.answerable AND c.query = g.query AND c.as_of = g.as_of GROUP BY 1""",
)
def e08(t: Tables):
    found = lookup.master_lookup(t["requests"], t["items"], t["periods"], DATASET, FIELDS)
    return found.results.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "c12_review_state",
    """WITH m AS (SELECT c.query, c.as_of, COUNT(*) FILTER (p_size <= 7) AS visible, COUNT(*) AS n
                  FROM {o_priced} c JOIN {items} USING (code)
                  WHERE TRY_CAST(price_raw AS DOUBLE) IS DISTINCT FROM 0 GROUP BY c.query, c.as_of)
       SELECT request_id, CASE WHEN n > 1 THEN 'multipleCandidates:' || CAST(visible AS STRING)
                               WHEN n = 1 THEN 'none' ELSE 'unavailable' END AS state
       FROM {o_gated} g LEFT JOIN m ON g.answerable AND m.query = g.query AND m.as_of = g.as_of""",
)
def c12(t: Tables):
    """Beside each result: how many candidates the repriced-only filter leaves in view."""
    found = lookup.master_lookup(t["requests"], t["items"], t["periods"], DATASET, FIELDS)
    marked = membership(found.matches, t["announcement"])
    visible = marked.groupBy("query", "as_of").agg(F.count_if("changed").alias("n_visible"))
    rows = found.results.join(visible, ["query", "as_of"], "left").na.fill(0, ["n_visible"])
    return rows.select("request_id", lookup.review_state(F.col("status"), F.col("n_visible")).alias("state"))


@query(
    "b06_surface_format",
    """SELECT DISTINCT query, regexp_full_match(query, '[A-Z0-9]{{10}}') AS raw_code,
              regexp_full_match(upper(regexp_replace(query, '[\\s-]', '', 'g')), '[A-Z0-9]{{10}}') AS code FROM {requests}""",
)
def b06(t: Tables):
    q = F.col("query")
    return t["requests"].select("query", is_code(q).alias("raw_code"), is_code(norm_code(q)).alias("code")).distinct()
