"""Text, dates and numbers: B01-B11, B19-B28, B31-B33, B35-B37, A09, A10, B29, B30."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.functions import dates, numbers, text
from refledger.functions.truth import as_word
from refledger.operators import lines, reconcile
from refledger.plans.registry import Tables, query
from refledger.sources.scans import filter_has_token, filter_token_or_listed

# Full-width forms of the printable ASCII characters, by rule: the same order, shifted.
ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


@query("b01_nfkc", "SELECT p_partkey, p_name || ' ' || p_brand AS folded, p_name AS plain FROM {part}")
def b01(t: Tables):
    """Names printed full-width fold back to ASCII; ASCII names stay."""
    wide = F.translate(F.concat_ws("　", "p_name", "p_brand"), ASCII, FULL_WIDTH)
    return t["part"].select("p_partkey", text.nfkc(wide).alias("folded"), text.nfkc(F.col("p_name")).alias("plain"))


@query(
    "b01_nfkc_documents",
    "SELECT doc_id, md5(text) AS digest FROM {documents}",
)
def b01_documents(t: Tables):
    """All documents; their texts are in folded form already."""
    return t["documents"].select("doc_id", F.md5(text.nfkc(F.col("text"))).alias("digest"))


@query(
    "b02_norm_code",
    r"SELECT request_id, upper(regexp_replace(query, '[\s-]', '', 'g')) AS code FROM {requests}",
)
def b02(t: Tables):
    return t["requests"].select("request_id", text.norm_code(F.col("query")).alias("code"))


@query(
    "b03_norm_name",
    r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM {documents}",
)
def b03(t: Tables):
    return t["documents"].select("doc_id", F.md5(text.norm_name(F.col("text"))).alias("digest"))


@query(
    "b04_close_gap",
    r"""SELECT code, regexp_replace(lower(ingredient), '(\d)\s+(mg|mcg|gm|ml|iu|g)\b', '\1\2', 'g') AS closed,
               regexp_replace(lower(ingredient), '(\d)\s+(mg|mcg|gm|ml|iu|g)\b', '\1\2', 'g') AS closed_unicode FROM {items}""",
)
def b04(t: Tables):
    low = F.lower("ingredient")
    return t["items"].select(
        "code", text.close_gap(low).alias("closed"), text.close_gap(low, "unicode").alias("closed_unicode")
    )


@query(
    "b05_query_terms",
    r"""SELECT request_id, unnest(list_filter(string_split(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS term
        FROM {requests}""",
)
def b05(t: Tables):
    return t["requests"].select("request_id", F.explode(text.terms(text.norm_name(F.col("query")))).alias("term"))


@query(
    "b07_strict_date",
    """SELECT request_id, as_of, COALESCE(strftime(CASE WHEN regexp_full_match(as_of, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
              THEN TRY_CAST(as_of AS DATE) END, '%Y-%m-%d'), 'none') AS day FROM {requests}""",
)
def b07(t: Tables):
    day = F.date_format(dates.strict_date(F.col("as_of")), "yyyy-MM-dd")
    return t["requests"].select("request_id", "as_of", F.coalesce(day, F.lit("none")).alias("day"))


@query(
    "b07w_strict_date_in_listings",
    """SELECT request_id, COALESCE(TRY_CAST(as_of AS DATE) IS NOT NULL, false) AS valid FROM {rule_requests}""",
)
def b07w(t: Tables):
    return t["rule_requests"].select("request_id", dates.strict_date(F.col("as_of")).isNotNull().alias("valid"))


@query(
    "b08_era_packed_date",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN iso WHEN o_orderstatus = 'F' THEN '9999-12-31'
              ELSE 'none' END AS day FROM {packed_dates}""",
)
def b08(t: Tables):
    day = F.date_format(dates.era_packed_date(F.col("packed")), "yyyy-MM-dd")
    return t["packed_dates"].select("o_orderkey", F.coalesce(day, F.lit("none")).alias("day"))


@query(
    "b09_era_date",
    """SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN iso ELSE 'none' END AS day FROM {packed_dates}""",
)
def b09(t: Tables):
    day = F.date_format(dates.era_date(F.col("spelt")), "yyyy-MM-dd")
    return t["packed_dates"].select("o_orderkey", F.coalesce(day, F.lit("none")).alias("day"))


@query(
    "b10_month_day",
    """SELECT o_orderkey, COALESCE(strftime(TRY_CAST('2001-' || substr(iso, 6) AS DATE), '%Y-%m-%d'), 'none') AS day FROM {packed_dates}""",
)
def b10(t: Tables):
    short = F.concat_ws("/", F.substring("iso", 6, 2).cast("int").cast("string"), F.substring("iso", 9, 2))
    day = F.date_format(dates.month_day(short, F.lit("2001-06-15")), "yyyy-MM-dd")
    return t["packed_dates"].select("o_orderkey", F.coalesce(day, F.lit("none")).alias("day"))


@query(
    "b11_date_words",
    """SELECT request_id, today AS day FROM {request_log} WHERE contains(line, 'Today')""",
)
def b11(t: Tables):
    found = dates.date_words(F.col("line"), ["today"], F.col("today"))
    return t["request_log"].select("request_id", F.explode(found).alias("day"))


@query(
    "b19_split_steps",
    """SELECT doc, ln, 1 AS pos, '一、first ' || name AS step FROM {rule_parts}
       UNION ALL SELECT doc, ln, 2, '二、second ' || flag FROM {rule_parts}""",
)
def b19(t: Tables):
    joined = F.concat(F.lit("  一、first "), F.col("name"), F.lit("\n 二、second "), F.col("flag"), F.lit(" "))
    steps = F.posexplode(text.split_steps(joined)).alias("pos", "step")
    return t["rule_parts"].select("doc", "ln", steps).withColumn("pos", F.col("pos").cast("bigint") + 1)


@query(
    "b20_rejoin_lines",
    r"""WITH s AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY ord) AS prev, lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS above
                   FROM {o_lines} WHERE line <> ''),
             j AS (SELECT doc_id, ord, CASE WHEN prev IS NULL THEN '' WHEN ord - above > 1 AND regexp_matches(prev, '[A-Za-z0-9]$')
                     THEN ' ' || CASE WHEN regexp_matches(line, '^[A-Za-z0-9]') THEN ' ' ELSE '' END WHEN (regexp_matches(prev, '[A-Za-z0-9]$') OR regexp_matches(line, '^[A-Za-z0-9]'))
                     AND NOT (regexp_matches(prev, '-$') OR regexp_matches(line, '^-')) AND NOT (ends_with(prev, 'the.') AND starts_with(line, 'The'))
                     THEN ' ' ELSE '' END || line AS part FROM s)
        SELECT doc_id, md5(string_agg(part, '' ORDER BY ord)) AS digest FROM j GROUP BY doc_id""",
)
def b20(t: Tables):
    """Every document's lines as one text; one seam is named as an exception."""
    joined = text.rejoin(F.split("text", "\n"), [("the.", "The")])
    return t["documents"].select("doc_id", F.md5(joined).alias("digest"))


@query(
    "b20_unfired_exceptions",
    """SELECT 'never so' AS after, 'at all' AS before FROM (SELECT COUNT(*) AS n FROM {documents}) WHERE n > 0""",
)
def b20_unfired(t: Tables):
    """Named seams must occur; one of these two does not."""
    docs = t["documents"].select("doc_id", F.split("text", "\n").alias("lines"))
    return lines.unfired(docs, [(".", "The"), ("never so", "at all")])


@query(
    "b21_same_without_whitespace",
    "SELECT doc_id, true AS same, false AS after_edit FROM {documents}",
)
def b21(t: Tables):
    parts = F.split("text", "\n")
    joined = text.rejoin(parts)
    return t["documents"].select(
        "doc_id",
        text.same_without_ws(joined, parts).alias("same"),
        text.same_without_ws(F.concat(joined, F.lit("x")), parts).alias("after_edit"),
    )


@query(
    "b22_strip_suffix",
    """SELECT p_partkey, CASE WHEN ends_with(p_name, ' ring') THEN left(p_name, length(p_name) - 5)
              WHEN ends_with(p_name, ' gear') THEN left(p_name, length(p_name) - 5) ELSE 'unknown' END AS stem FROM {part}""",
)
def b22(t: Tables):
    stem = text.strip_suffix(F.col("p_name"), [" ring", " gear"])
    return t["part"].select("p_partkey", F.coalesce(stem, F.lit("unknown")).alias("stem"))


@query(
    "b23_split_ordinal",
    r"""SELECT doc, ord, regexp_extract(trim(line), '^([(（][一二三四五六七八九十][)）]|\d+\.)\s*(.+)$', 1) AS ordinal,
               regexp_extract(trim(line), '^([(（][一二三四五六七八九十][)）]|\d+\.)\s*(.+)$', 2) AS body FROM {rule_lines}""",
)
def b23(t: Tables):
    parts = text.split_ordinal(text.strip(F.col("line")))
    return t["rule_lines"].select(
        "doc", "ord", F.coalesce(parts["ordinal"], F.lit("")).alias("ordinal"), F.coalesce(parts["body"], F.lit("")).alias("body")
    )


@query(
    "b24_numerals",
    """SELECT doc, ln, CAST(ln AS BIGINT) AS number, CASE WHEN st = 'O' THEN 2 ELSE 0 END AS required FROM {rule_parts}""",
)
def b24(t: Tables):
    word = F.substring(F.lit("一二三四五六七"), F.col("ln"), F.lit(1))
    wording = F.concat(F.col("name"), F.when(F.col("st") == "O", "符合以下至少二項：").otherwise(""))
    required = F.coalesce(text.required_count(wording), F.lit(0).cast("bigint"))
    return t["rule_parts"].select("doc", "ln", text.numeral(word).alias("number"), required.alias("required"))


@query(
    "b25_labels_to_ids",
    """SELECT c_custkey, pos, id FROM (
         SELECT c_custkey, 0 AS pos, n_nationkey AS id FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
         UNION ALL SELECT c_custkey, 1, n_nationkey FROM {customer} JOIN {nation} ON n_name = 'NATION_' || CAST(c_nationkey + 1 AS STRING))""",
)
def b25(t: Tables):
    return _labelled(t)[0].select("c_custkey", "pos", "id")


@query(
    "b25_unknown_labels",
    """SELECT c_custkey, 'NATION_' || CAST(c_nationkey + 1 AS STRING) AS label FROM {customer}
       WHERE 'NATION_' || CAST(c_nationkey + 1 AS STRING) NOT IN (SELECT n_name FROM {nation})""",
)
def b25_unknown(t: Tables):
    return _labelled(t)[1].select("c_custkey", "label")


def _labelled(t: Tables):
    name = lambda n: F.concat(F.lit("NATION_"), n.cast("string"))
    rows = t["customer"].withColumn(
        "labels", F.concat_ws("、", name(F.col("c_nationkey")), name(F.col("c_nationkey") + 1))
    )
    dictionary = t["nation"].select(F.col("n_name").alias("label"), F.col("n_nationkey").alias("id"))
    return reconcile.labels_to_ids(rows, "c_custkey", "labels", dictionary)


@query(
    "b26_thresholds",
    """SELECT p_partkey, CAST(p_size AS BIGINT) AS stated, true AS in_window, CAST(2 AS BIGINT) AS n_numbers FROM {part}""",
)
def b26(t: Tables):
    """A threshold text, and its source window with the target cells beside it."""
    cell = F.concat(F.lit("LDL-C≧"), F.col("p_size").cast("string"), F.lit("mg/dL"))
    window = F.concat_ws(
        "\n", F.lit("x C<70mg/dL  y"), F.concat(F.lit("C<"), (F.col("p_size") + 100).cast("string"), F.lit("mg/dL")), cell, F.lit("C<70mg/dL")
    )
    numbers_ = text.stated_numbers(window, r"C<(\d+)mg/dL")
    return t["part"].select(
        "p_partkey",
        text.threshold(cell, r"≧(\d+)mg/dL$").cast("bigint").alias("stated"),
        F.array_contains(text.stated_numbers(window, r"≧(\d+)mg/dL"), F.col("p_size").cast("string")).alias("in_window"),
        F.size(numbers_).cast("bigint").alias("n_numbers"),
    )


@query("b27_blank_to_null", "SELECT code, COALESCE(NULLIF(spec_amount, ''), 'absent') AS amount FROM {items}")
def b27(t: Tables):
    return t["items"].select("code", F.coalesce(text.blank_to_null(F.col("spec_amount")), F.lit("absent")).alias("amount"))


@query(
    "b28_missing_and_concat",
    """SELECT code, COALESCE(NULLIF(concat_ws(' ', NULLIF(spec_amount, ''), NULLIF(spec_unit, '')), ''), 'not stated') AS spec FROM {items}""",
)
def b28(t: Tables):
    joined = text.join_nonblank([F.col("spec_amount"), F.col("spec_unit")])
    return t["items"].select("code", text.or_missing(joined, "not stated").alias("spec"))


@query(
    "b29_staleness",
    """SELECT request_id, COALESCE(regexp_full_match(as_of, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND as_of > '1999-06-30', false) AS stale FROM {requests}""",
)
def b29(t: Tables):
    return t["requests"].select("request_id", dates.is_stale(F.col("as_of"), "1999-06-30").alias("stale"))


@query(
    "b30_superseded",
    """SELECT i.code, o.as_of, COALESCE(a.price_before IS NOT NULL AND a.price_after IS NOT NULL, false) AND o.as_of >= '2000-09-01' AS superseded
       FROM {items} i JOIN (SELECT DISTINCT o_custkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS as_of FROM {orders}) o ON o.o_custkey = i.ord
       LEFT JOIN {announcement} a ON a.code = i.code""",
)
def b30(t: Tables):
    asked = t.sql("SELECT DISTINCT o_custkey AS ord, CAST(CAST(o_orderdate AS DATE) AS STRING) AS as_of FROM {orders}")
    marked = reconcile.membership(t["items"], t["announcement"]).join(asked, "ord")
    flag = dates.is_superseded(F.col("as_of"), "2000-09-01", F.col("changed"))
    return marked.select("code", "as_of", flag.alias("superseded"))


@query(
    "b31_local_date",
    """SELECT event_id, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS day FROM {events}""",
)
def b31(t: Tables):
    """UTC instants on a clock eight hours ahead."""
    utc = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    return t["events"].select("event_id", F.date_format(dates.local_date(utc, "+08:00"), "yyyy-MM-dd").alias("day"))


@query(
    "b31_date_presets",
    """SELECT event_id, 'today' AS preset, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS value FROM {events}
       UNION ALL SELECT event_id, 'announcement', '2026-09-01' FROM {events}""",
)
def b31_presets(t: Tables):
    utc = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    return t["events"].select("event_id", F.inline(dates.date_presets(utc, "+08:00", "2026-09-01")))


@query(
    "b32_parse_measure",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_raw,
              COALESCE(CASE WHEN TRY_CAST(trim(price_raw) AS DOUBLE) BETWEEN 0 AND 50000 THEN TRY_CAST(trim(price_raw) AS DOUBLE) END, -1) AS measure
       FROM {price_texts}""",
)
def b32(t: Tables):
    measure = numbers.parse_measure(F.col("price_raw"), 0, 50000)
    return t["price_texts"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_raw", F.coalesce(measure, F.lit(-1.0)).alias("measure")
    )


@query(
    "b33_measure_threshold",
    """SELECT user_id, week, CASE WHEN measure IS NULL THEN 'unknown' WHEN measure >= 190 THEN 'yes' ELSE 'no' END AS truth FROM {subjects}""",
)
def b33(t: Tables):
    """Subjects without a measure are unknown; NaN, tried here in its place, is unknown too."""
    given = F.coalesce(F.col("measure"), F.lit(float("nan")))
    return t["subjects"].select("user_id", "week", as_word(numbers.at_least(given, 190)).alias("truth"))


@query(
    "b35_insert_at",
    """SELECT doc_id, ord, CASE WHEN length(line) >= 5 THEN left(line, 5) || '²' || substr(line, 6) ELSE 'beyond' END AS line FROM {o_lines}""",
)
def b35(t: Tables):
    put = text.insert_at(F.col("line"), F.lit("²"), F.lit(5))
    return _document_lines(t).select("doc_id", "ord", F.coalesce(put, F.lit("beyond")).alias("line"))


@query(
    "b36_line_cells",
    r"""SELECT doc, ord, len(c) AS n_cells, c[len(c)] AS last_cell FROM (
          SELECT doc, ord, list_filter(regexp_split_to_array(trim(line), '\s\s+'), lambda x: x <> '') AS c FROM {rule_lines})""",
)
def b36(t: Tables):
    cells = text.cells(F.col("line"))
    return t["rule_lines"].select(
        "doc", "ord", F.size(cells).cast("bigint").alias("n_cells"), F.element_at(cells, -1).alias("last_cell")
    )


def _document_lines(t: Tables):
    return lines.to_lines(t["documents"], "doc_id", "text").withColumn("ord", F.col("ord").cast("bigint"))


@query("b37_text_to_lines", "SELECT doc_id, ord, md5(line) AS digest FROM {o_lines}")
def b37(t: Tables):
    return _document_lines(t).select("doc_id", "ord", F.md5("line").alias("digest"))


@query(
    "a09_exact_token_subset",
    """SELECT p_partkey, sections FROM {tokens} WHERE list_has_any(string_split(sections, ','), ['Brand#2', 'PROMO'])""",
)
def a09(t: Tables):
    return filter_has_token(t["tokens"], "sections", ["Brand#2", "PROMO"]).select("p_partkey", "sections")


@query(
    "a10_token_or_listed",
    """SELECT p_partkey FROM {tokens} WHERE list_contains(string_split(sections, ','), 'Brand#2')
          OR code IN (SELECT code FROM {shipped})""",
)
def a10(t: Tables):
    return filter_token_or_listed(t["tokens"], "sections", ["Brand#2"], t["shipped"], "code").select("p_partkey")
