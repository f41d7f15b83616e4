"""Request mining and the request page: F10, F11, J01-J07, K08.

The checking engine has no look-around in its patterns, so its SQL rebuilds what each line must yield
from the parts the line was composed of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.operators import mining
from refledger.operators.screen import search_page
from refledger.operators.stage import computed
from refledger.plans.bindings import DATASET
from refledger.plans.registry import Tables, query

ARGS = ("line", "today", "announced")
PLAIN = "pr = '4-NOT SPECIFIED'"
HEAD = "p_name || ' ' || p_brand"
DOSE = "CAST(p_size AS STRING) || '.50 MG'"
SPELT = """CASE WHEN pr = '5-LOW' THEN '9/1' WHEN st = 'F' THEN strftime(odate, '%Y-%m-%d')
                WHEN st = 'O' THEN CAST(year(odate) - 1911 AS STRING) || '/' || CAST(month(odate) AS STRING) || '/' || CAST(day(odate) AS STRING)
                ELSE 'Today' END"""
DAY = "CASE WHEN pr = '5-LOW' THEN '2000-09-01' WHEN st = 'P' THEN '2000-06-15' ELSE strftime(odate, '%Y-%m-%d') END"
FILTER_RAW = "CASE pr WHEN '1-URGENT' THEN 'repriced' WHEN '2-HIGH' THEN 'price not changed' WHEN '3-MEDIUM' THEN '未調價' ELSE '' END"
FILTER = "CASE pr WHEN '1-URGENT' THEN 'priceChanged' WHEN '2-HIGH' THEN 'priceUnchanged' WHEN '3-MEDIUM' THEN 'priceUnchanged' ELSE '' END"

# The spans each line must yield, with offsets counted from the parts before them.
SPANS_SQL = f"""
    WITH x AS (SELECT *, length({HEAD}) + 1 AS dose_at, length({HEAD}) + 1 + length({DOSE}) + 1 + CASE WHEN pr = '5-LOW' THEN 11 ELSE 0 END AS day_at,
                      {DOSE} AS dose_raw, {SPELT} AS day_raw, {DAY} AS day_value, {FILTER_RAW} AS filter_raw, {FILTER} AS filter_value
               FROM {{request_log}} WHERE NOT ({PLAIN})),
         s AS (SELECT request_id, 'dose' AS kind, dose_at AS start, dose_raw AS raw, CAST(p_size AS STRING) || '.5mg' AS value FROM x
               UNION ALL SELECT request_id, 'date', day_at, day_raw, day_value FROM x
               UNION ALL SELECT request_id, 'announcement', day_at + length(day_raw) + 1, filter_raw, filter_value FROM x WHERE filter_raw <> ''
               UNION ALL SELECT request_id, 'ignored', day_at + length(day_raw) + 1 + length(filter_raw), '的', '的' FROM x WHERE pr = '3-MEDIUM')
"""


def mined(t: Tables):
    return mining.mine(t["request_log"], *ARGS)


@query(
    "j01_detect_spans",
    SPANS_SQL
    + """SELECT request_id, kind, start, raw FROM s
         UNION ALL SELECT request_id, 'date', day_at - 11, '1997-02-30' FROM x WHERE pr = '5-LOW'
         UNION ALL SELECT request_id, 'announcement', day_at + length(day_raw) + 2, '調價' FROM x WHERE pr = '3-MEDIUM'""",
)
def j01(t: Tables):
    """Hits of all detectors, valid or not, overlapping or not, with their offsets."""
    hits = mining.detect(t["request_log"], *ARGS).select("request_id", F.inline("hits"))
    return hits.select("request_id", "kind", F.col("start").cast("bigint").alias("start"), "raw")


@query(
    "j02_rejected_values_stay",
    f"SELECT request_id, '1997-02-30' AS raw FROM {{request_log}} WHERE pr = '5-LOW' AND NOT ({PLAIN})",
)
def j02(t: Tables):
    """Hits without a valid value: impossible dates."""
    hits = mining.detect(t["request_log"], *ARGS)
    valid = mining.drop_invalid(F.col("hits"))
    return hits.select("request_id", F.explode(F.array_except("hits", valid)).alias("s")).select("request_id", "s.raw")


RESOLVED = SPANS_SQL + "SELECT request_id, start, start + length(raw) AS \"end\", kind, raw, value FROM s"


@query("j03_resolve_overlaps", RESOLVED)
def j03(t: Tables):
    return _spans(t)


@query("f10_span_conflicts", RESOLVED)
def f10(t: Tables):
    """Spans that survive the priority of detectors."""
    hits = mining.detect(t["request_log"], *ARGS)
    valid = computed(hits.withColumn("hits", mining.drop_invalid(F.col("hits"))))
    return _plain(valid.select("request_id", F.inline(mining.resolve_spans(F.col("hits"), F.col("line")))))


def _spans(t: Tables):
    return _plain(mined(t).select("request_id", F.inline("spans")))


def _plain(spans):
    return spans.select(
        "request_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "kind", "raw", "value"
    )


@query(
    "j04_residual_text",
    f"SELECT request_id, {HEAD} || CASE WHEN pr = '5-LOW' THEN ' 1997-02-30' ELSE '' END AS search_text FROM {{request_log}}",
)
def j04(t: Tables):
    return mined(t).select("request_id", "search_text")


@query(
    "j04_no_character_lost",
    "SELECT request_id, length(replace(line, ' ', '')) AS n_chars FROM {request_log}",
)
def j04_lossless(t: Tables):
    """Residual text and quoted spans together hold as many characters as the line."""
    bare = lambda c: F.length(F.regexp_replace(c, " ", ""))
    quoted = bare(F.array_join("spans.raw", ""))
    return mined(t).select("request_id", (bare(F.col("search_text")) + quoted).cast("bigint").alias("n_chars"))


@query(
    "j05_facet_rows",
    SPANS_SQL + "SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY start) - 1 AS pos, kind, raw, value FROM s",
)
def j05(t: Tables):
    rows = mining.facet_rows(mined(t), "request_id")
    return rows.select("request_id", F.col("pos").cast("bigint").alias("pos"), "kind", "raw", "value")


@query(
    "j06_controls",
    f"""SELECT request_id, CASE WHEN {PLAIN} THEN '' ELSE CAST(p_size AS STRING) || '.5mg' END AS dose_key,
               CASE WHEN {PLAIN} THEN '' ELSE CAST(p_size AS STRING) || '.5 mg' END AS dose_label,
               CASE WHEN {PLAIN} THEN '' ELSE {FILTER} END AS filter, CASE WHEN {PLAIN} THEN '' ELSE {DAY} END AS as_of FROM {{request_log}}""",
)
def j06(t: Tables):
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return mined(t).select(
        "request_id", blank("dose_key").alias("dose_key"), blank("dose_label").alias("dose_label"),
        blank("filter").alias("filter"), blank("mined_as_of").alias("as_of"),
    )


@query(
    "f11_last_of_a_kind",
    f"SELECT request_id, {DAY} AS value FROM {{request_log}} WHERE NOT ({PLAIN})",
)
def f11(t: Tables):
    """Of two dates in a line, here the mined one and one put before it, the last counts."""
    twice = t["request_log"].withColumn("line", F.concat(F.lit("1999-09-09 "), "line"))
    found = mining.mine(twice, *ARGS).where(F.size("spans") > 1)
    return found.select("request_id", mining.last_of(F.col("spans"), "date")["value"].alias("value"))


@query("j07_plain_lines", f"SELECT request_id, line AS search_text FROM {{request_log}} WHERE {PLAIN}")
def j07(t: Tables):
    return mining.plain_lines(t["request_log"], "line").select("request_id", F.col("line").alias("search_text"))


def screen(t: Tables):
    return search_page(t["request_log"], t["items"], t["periods"], t["announcement"], DATASET)


# Lines with a date that does not exist keep it as a term, so they find nothing.
SCREEN_SQL = f"""
    WITH r AS (SELECT request_id, {HEAD} AS q, CASE WHEN {PLAIN} THEN as_of ELSE {DAY} END AS day, CASE WHEN {PLAIN} THEN '' ELSE CAST(p_size AS STRING) || '.5mg' END AS dose,
                      CASE WHEN {PLAIN} OR {FILTER} = '' THEN 'all' ELSE {FILTER} END AS filter, pr = '5-LOW' AS hopeless FROM {{request_log}}),
         q AS (SELECT DISTINCT q FROM r),
         h AS (SELECT q.q, f.code, f.ord FROM q JOIN {{o_fields}} f ON len(list_filter(string_split(lower(q.q), ' '),
                 lambda w: NOT (contains(f_en, w) OR contains(f_zh, w) OR contains(f_in, w)))) = 0),
         a AS (SELECT DISTINCT q, day FROM r WHERE NOT hopeless),
         m AS (SELECT a.q, a.day, h.code, h.ord, MIN(price_raw) AS price_raw FROM a JOIN h ON h.q = a.q
               JOIN {{periods}} p ON p.code = h.code AND CAST(a.day AS DATE) BETWEEN p.start_date AND p.end_date GROUP BY ALL HAVING COUNT(*) = 1),
         k AS (SELECT m.q, m.day, m.code, m.ord, n.code IS NOT NULL AS changed FROM m
               LEFT JOIN (SELECT code FROM {{announcement}} WHERE price_before IS NOT NULL AND price_after IS NOT NULL) n ON n.code = m.code WHERE price_raw <> '0.00'),
         asks AS (SELECT DISTINCT q, day, dose, filter FROM r WHERE NOT hopeless),
         v AS (SELECT asks.*, k.code, k.ord, changed, filter = 'all' OR (filter = 'priceChanged') = changed AS kept,
                      dose = '' OR (k.code, dose) IN (SELECT (code, key) FROM {{o_mentions}}) AS dosed FROM asks JOIN k ON k.q = asks.q AND k.day = asks.day)
"""


@query(
    "k08_screen_results",
    SCREEN_SQL
    + """, n AS (SELECT q, day, dose, filter, COUNT(*) AS n_matches, COUNT(*) FILTER (changed) AS n_changed, COUNT(*) FILTER (kept) AS n_kept,
                        COUNT(*) FILTER (kept AND dosed) AS n_visible FROM v GROUP BY q, day, dose, filter)
         SELECT request_id, COALESCE(n_matches, 0) AS n_matches, COALESCE(n_changed, 0) AS n_changed, COALESCE(n_kept, 0) AS n_kept, COALESCE(n_visible, 0) AS n_visible,
                CASE WHEN n_matches > 1 THEN 'multipleCandidates:' || CAST(n_visible AS STRING) WHEN n_matches = 1 THEN 'none' ELSE 'unavailable' END AS review
         FROM r LEFT JOIN n ON NOT r.hopeless AND n.q = r.q AND n.day = r.day AND n.dose = r.dose AND n.filter = r.filter""",
)
def k08(t: Tables):
    return screen(t).results.select("request_id", "n_matches", "n_changed", "n_kept", "n_visible", "review")


@query(
    "k08_screen_pages",
    SCREEN_SQL
    + """SELECT q AS search_text, day, dose, filter, code, row_number() OVER w AS place, CAST(ceil(row_number() OVER w / 30.0) AS BIGINT) AS page
         FROM v WHERE kept AND dosed WINDOW w AS (PARTITION BY q, day, dose, filter ORDER BY ord)""",
)
def k08_pages(t: Tables):
    pages = screen(t).pages
    return pages.select("search_text", F.col("lookup_date").alias("day"), F.col("dose_key").alias("dose"), "filter", "code", "place", "page")


@query(
    "k08_screen_facets",
    SCREEN_SQL
    + """, c AS (SELECT q, day, dose, filter, COALESCE(o.key, 'unspecified') AS key, COUNT(*) AS n FROM v LEFT JOIN {o_mentions} o ON o.code = v.code
                 WHERE kept GROUP BY q, day, dose, filter, COALESCE(o.key, 'unspecified'))
         SELECT q AS search_text, day, dose, filter, key, n FROM c
         UNION ALL SELECT q, day, dose, filter, dose, 0 FROM (SELECT DISTINCT CASE WHEN hopeless THEN q || ' 1997-02-30' ELSE q END AS q, day, dose, filter FROM r)
         WHERE dose <> '' AND (q, day, dose, filter, dose) NOT IN (SELECT (q, day, dose, filter, key) FROM c)""",
)
def k08_facets(t: Tables):
    rows = screen(t).facets
    return rows.select("search_text", F.col("lookup_date").alias("day"), F.col("dose_key").alias("dose"), "filter", "key", "n")
