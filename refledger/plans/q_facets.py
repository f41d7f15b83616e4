"""Mentions, facets and classes: B13-B18, B34, C05, C06, C09, E03-E06, E16, E17, G01, G02, G04, G05, H01, K03."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.functions.mentions import ITEM_UNITS, UNIT_ORDER, distinct_first, mention_pattern, mentions, norm_unit, rank_of
from refledger.functions.numbers import plain_number
from refledger.functions.text import classify, generics
from refledger.operators import facets, lookup, reconcile
from refledger.operators.words import label_rows
from refledger.plans.bindings import DATASET
from refledger.plans.registry import Tables, query

CLASSES = {"promo": "PROMO", "ring": "RING"}
OTHER = "other"
NAME_PATTERN = "[A-Z]+ RING|PROMO"
CLASS_COUNTS_SQL = """
    SELECT code, contains(ingredient, 'PROMO') AS promo, contains(ingredient, 'RING') AS ring,
           NOT contains(ingredient, 'PROMO') AND NOT contains(ingredient, 'RING') AS other FROM {items}"""


def class_of(name):
    return F.when(F.contains(name, F.lit("RING")), "ring").otherwise("promo")


def dosed(t: Tables):
    return facets.with_mentions(t["items"])


@query(
    "b13_amount_unit_mentions",
    """SELECT DISTINCT code, fld, num || unit AS key FROM (
         SELECT code, fld, regexp_replace(regexp_replace(regexp_extract(raw, '^[0-9.]+'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS num,
                CASE upper(regexp_extract(raw, '[A-Za-z%].*$')) WHEN 'MG' THEN 'mg' WHEN 'GM' THEN 'g' WHEN 'IU' THEN 'IU' WHEN 'MG/GM' THEN 'mg/g' END AS unit
         FROM {o_raw_mentions})""",
)
def b13(t: Tables):
    fields = F.array(
        F.struct(F.lit(1).alias("fld"), mentions(F.col("ingredient")).alias("found")),
        F.struct(F.lit(2).alias("fld"), mentions(F.col("name_en")).alias("found")),
    )
    rows = t["items"].select("code", F.inline(fields))
    return rows.select("code", "fld", F.explode("found.key").alias("key"))


@query(
    "b14_unit_normalise",
    """SELECT code, fld, raw, CASE upper(regexp_extract(raw, '[A-Za-z%].*$')) WHEN 'MG' THEN 'mg' WHEN 'GM' THEN 'g'
              WHEN 'IU' THEN 'IU' WHEN 'MG/GM' THEN 'mg/g' END AS unit FROM {o_raw_mentions}""",
)
def b14(t: Tables):
    pattern = mention_pattern(list(ITEM_UNITS), ["GM"])
    fields = [
        F.struct(F.lit(i).alias("fld"), F.regexp_extract_all(c, F.lit(pattern), 0).alias("raws"))
        for i, c in ((1, "ingredient"), (2, "name_en"))
    ]
    rows = t["items"].select("code", F.inline(F.array(*fields))).select("code", "fld", F.explode("raws").alias("raw"))
    unit = norm_unit(F.regexp_extract("raw", pattern, 2), F.regexp_extract("raw", pattern, 3))
    return rows.select("code", "fld", "raw", unit.alias("unit"))


@query(
    "b15_mention_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_raw,
              CASE WHEN contains(price_raw, '.') THEN rtrim(rtrim(trim(price_raw), '0'), '.') ELSE trim(price_raw) END AS digits
       FROM {price_texts}""",
)
def b15(t: Tables):
    """Every price text, blanks, zeros and a hyphen among them."""
    return t["price_texts"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_raw", plain_number(F.trim("price_raw")).alias("digits"))


@query(
    "b16_first_occurrence",
    """SELECT i.code, f.fld, CAST(COUNT(DISTINCT raw) AS BIGINT) AS n FROM {items} i CROSS JOIN (VALUES (1), (2)) f(fld)
       LEFT JOIN {o_raw_mentions} m ON m.code = i.code AND m.fld = f.fld GROUP BY i.code, f.fld""",
)
def b16(t: Tables):
    """A field written twice over states each mention once; both fields of every item."""

    def raws(field: str):
        return F.regexp_extract_all(F.concat_ws("+", field, field), F.lit(mention_pattern(list(ITEM_UNITS), ["GM"])), 0)

    sizes = [F.struct(F.lit(i).alias("fld"), F.size(distinct_first(raws(c))).cast("bigint").alias("n")) for i, c in ((1, "ingredient"), (2, "name_en"))]
    return t["items"].select("code", F.inline(F.array(*sizes)))


@query(
    "b17_multi_label_classify",
    f"""WITH f AS ({CLASS_COUNTS_SQL}) SELECT code, 'promo' AS label FROM f WHERE promo
        UNION ALL SELECT code, 'ring' FROM f WHERE ring UNION ALL SELECT code, 'other' FROM f WHERE other""",
)
def b17(t: Tables):
    return t["items"].select("code", F.explode(classify(F.col("ingredient"), CLASSES, OTHER)).alias("label"))


@query(
    "b17_labels_of_a_table",
    """WITH l AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS label, upper(p_name) AS word FROM {part}
                  UNION SELECT lower(p_type), upper(p_type) FROM {part} WHERE p_size % 2 = 0 AND p_type <> 'PROMO'),
            f AS (SELECT DISTINCT code, label FROM {items} JOIN l ON contains(upper(ingredient), word))
       SELECT code, label FROM f UNION ALL SELECT code, 'other' FROM {items} WHERE code NOT IN (SELECT code FROM f)""",
)
def b17_table(t: Tables):
    """Classes whose names are rows: a part's name under its first word, and types."""
    part = t["part"]
    names = part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("label"), F.upper("p_name").alias("word"))
    types = part.where("p_size % 2 = 0 AND p_type <> 'PROMO'").select(F.lower("p_type"), F.upper("p_type"))
    return label_rows(t["items"], "ingredient", names.union(types), OTHER).select("code", "label")


@query(
    "b18_generic_names",
    """SELECT DISTINCT code, unnest(regexp_extract_all(upper(ingredient), '[A-Z]+ RING|PROMO')) AS name FROM {items}""",
)
def b18(t: Tables):
    return t["items"].select("code", F.explode(generics(F.col("ingredient"), NAME_PATTERN)).alias("name"))


@query("h01_union_of_fields", "SELECT code, key, label, amount FROM {o_mentions}")
def h01(t: Tables):
    return dosed(t).select("code", F.inline("doses")).select("code", "key", "label", "amount")


@query(
    "b34_unit_rank",
    """SELECT code, key, CASE unit WHEN 'mcg' THEN 1 WHEN 'mg' THEN 2 WHEN 'g' THEN 3 WHEN 'ml' THEN 4 WHEN 'IU' THEN 5
              WHEN '%' THEN 6 ELSE 7 END AS rank FROM {o_mentions}""",
)
def b34(t: Tables):
    rows = dosed(t).select("code", F.inline("doses"))
    return rows.select("code", "key", rank_of(F.col("unit"), UNIT_ORDER).alias("rank"))


@query("e03_facet_counts", "SELECT key, label, COUNT(*) AS n FROM {o_mentions} GROUP BY key, label")
def e03(t: Tables):
    return facets.facet_counts(dosed(t), unspecified=False).select("key", "label", "n")


@query(
    "e04_unspecified_bucket",
    """SELECT key, label, COUNT(*) AS n FROM {o_mentions} GROUP BY key, label
       UNION ALL SELECT 'unspecified', '', COUNT(*) FROM {items} WHERE code NOT IN (SELECT code FROM {o_mentions}) HAVING COUNT(*) > 0""",
)
def e04(t: Tables):
    return facets.facet_counts(dosed(t)).select("key", "label", "n")


@query(
    "g01_facet_order",
    """SELECT key, n, row_number() OVER (ORDER BY r, unit, amount) AS rank FROM (
         SELECT key, unit, amount, COUNT(*) AS n, CASE unit WHEN 'mg' THEN 2 WHEN 'g' THEN 3 WHEN 'IU' THEN 5 ELSE 7 END AS r
         FROM {o_mentions} GROUP BY key, unit, amount
         UNION ALL SELECT 'unspecified', NULL, NULL, COUNT(*), 99 FROM {items} WHERE code NOT IN (SELECT code FROM {o_mentions}) HAVING COUNT(*) > 0)""",
)
def g01(t: Tables):
    return facets.facet_rank(facets.facet_counts(dosed(t))).select("key", "n", "rank")


@query(
    "c06_facet_filter",
    """SELECT code, code IN (SELECT code FROM {o_mentions} WHERE key = '10mg') AS ten,
              code NOT IN (SELECT code FROM {o_mentions}) AS none, true AS all_pass FROM {items}""",
)
def c06(t: Tables):
    doses = F.col("doses")
    return dosed(t).select(
        "code",
        facets.by_facet(doses, F.lit("10mg")).alias("ten"),
        facets.by_facet(doses, F.lit("unspecified")).alias("none"),
        facets.by_facet(doses, F.lit(None).cast("string")).alias("all_pass"),
    )


@query(
    "c05_membership_filter",
    """SELECT i.code, COALESCE(a.price_before IS NOT NULL AND a.price_after IS NOT NULL, false) AS changed,
              NOT COALESCE(a.price_before IS NOT NULL AND a.price_after IS NOT NULL, false) AS unchanged, true AS every
       FROM {items} i LEFT JOIN {announcement} a ON a.code = i.code""",
)
def c05(t: Tables):
    changed = F.col("changed")
    return reconcile.membership(t["items"].select("code"), t["announcement"]).select(
        "code",
        reconcile.by_membership(changed, F.lit("priceChanged")).alias("changed"),
        reconcile.by_membership(changed, F.lit("priceUnchanged")).alias("unchanged"),
        reconcile.by_membership(changed, F.lit("all")).alias("every"),
    )


@query("c09_drill_down", "SELECT code FROM {items} WHERE contains(upper(ingredient), 'COLD RING')")
def c09(t: Tables):
    return t["items"].where(facets.drill(F.col("ingredient"), F.lit("COLD RING"))).select("code")


@query(
    "e05_label_counts",
    f"""WITH f AS ({CLASS_COUNTS_SQL}) SELECT 'promo' AS label, COUNT(*) FILTER (promo) AS n FROM f
        UNION ALL SELECT 'ring', COUNT(*) FILTER (ring) FROM f UNION ALL SELECT 'other', COUNT(*) FILTER (other) FROM f
        UNION ALL SELECT 'absent', 0""",
)
def e05(t: Tables):
    labels = classify(F.col("ingredient"), CLASSES, OTHER)
    return facets.label_counts(t["items"], labels, [*CLASSES, OTHER, "absent"])


@query(
    "e06_generic_counts",
    """SELECT label, name, COUNT(*) AS n FROM (
         SELECT DISTINCT code, CASE WHEN contains(name, 'RING') THEN 'ring' ELSE 'promo' END AS label, name FROM (
           SELECT code, unnest(regexp_extract_all(upper(ingredient), '[A-Z]+ RING|PROMO')) AS name FROM {items})) GROUP BY label, name""",
)
def e06(t: Tables):
    rows = t["items"].select(
        generics(F.col("ingredient"), NAME_PATTERN).alias("names"),
        F.explode(classify(F.col("ingredient"), CLASSES, OTHER)).alias("label"),
    )
    return facets.generic_counts(rows, F.col("names"), class_of, F.col("label"), ["label"])


@query(
    "g02_largest_first",
    """SELECT p_type, name, n, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, name) AS rank FROM (
         SELECT p_type, p_name AS name, COUNT(*) AS n FROM {part} GROUP BY p_type, p_name)""",
)
def g02(t: Tables):
    counts = t["part"].groupBy("p_type", F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    return facets.largest_first(counts, ["p_type"])


@query(
    "e16_coverage_profile",
    """WITH m AS (SELECT code, MAX(CASE WHEN fld = 1 THEN 1 ELSE 0 END) AS a, MAX(CASE WHEN fld = 2 THEN 1 ELSE 0 END) AS b FROM {o_raw_mentions} GROUP BY code)
       SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (a = 1 AND b = 1) AS in_both, COUNT(*) FILTER (a = 1 AND b = 0) AS in_first,
              COUNT(*) FILTER (a = 0 AND b = 1) AS in_second, COUNT(*) FILTER (a IS NULL) AS in_none,
              COUNT(*) FILTER (spec_amount = '') AS blank_amount FROM {items} LEFT JOIN m USING (code)""",
)
def e16(t: Tables):
    first, second = F.size(mentions(F.col("ingredient"))) > 0, F.size(mentions(F.col("name_en"))) > 0
    flags = {
        "in_both": first & second,
        "in_first": first & ~second,
        "in_second": ~first & second,
        "in_none": ~first & ~second,
        "blank_amount": F.col("spec_amount") == "",
    }
    return facets.profile(t["items"], flags)


@query(
    "e17_chosen_facet_kept",
    """WITH c AS (SELECT p_type, key, label, COUNT(*) AS n FROM {o_mentions} JOIN {items} USING (code) GROUP BY p_type, key, label)
       SELECT p_type, key, label, n FROM c
       UNION ALL SELECT p_type, '12g', '12 g', 0 FROM (SELECT DISTINCT p_type FROM {items})
       WHERE p_type NOT IN (SELECT p_type FROM c WHERE key = '12g')""",
)
def e17(t: Tables):
    counts = facets.facet_counts(dosed(t), ["p_type"], unspecified=False)
    chosen = t["items"].select("p_type", F.lit("12g").alias("key"), F.lit("12 g").alias("label")).distinct()
    return facets.facet_options(counts, chosen, ["p_type"])


@query(
    "g04_source_order",
    """SELECT query, as_of, code, row_number() OVER (PARTITION BY query, as_of ORDER BY ord) AS place FROM {o_priced}
       WHERE TRY_CAST(price_raw AS DOUBLE) IS DISTINCT FROM 0""",
)
def g04(t: Tables):
    found = lookup.master_lookup(t["requests"], t["items"], t["periods"], DATASET)
    return facets.page(found.matches, ["query", "as_of"]).select("query", "as_of", "code", "place")


@query(
    "g05_paging",
    """SELECT o_custkey, o_orderkey, row_number() OVER w AS place, CAST(ceil(row_number() OVER w / 30.0) AS BIGINT) AS page FROM {orders}
       WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def g05(t: Tables):
    return facets.page(t["orders"], ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "place", "page")


def _listing(t: Tables):
    return facets.class_listing(
        t["class_requests"], t["items"], t["periods"], DATASET, CLASSES, OTHER, NAME_PATTERN, class_of
    )


CLASS_SQL = f"""
    WITH f AS ({CLASS_COUNTS_SQL}),
         l AS (SELECT code, 'promo' AS class FROM f WHERE promo UNION ALL SELECT code, 'ring' FROM f WHERE ring
               UNION ALL SELECT code, 'other' FROM f WHERE other),
         d AS (SELECT DISTINCT as_of FROM {{class_requests}} WHERE class <> 'unknown' AND as_of >= '1995-06-01'),
         x AS (SELECT l.class, d.as_of, l.code, MIN(p.price_raw) AS price_raw FROM l CROSS JOIN d
               JOIN {{periods}} p ON p.code = l.code AND CAST(d.as_of AS DATE) BETWEEN p.start_date AND p.end_date
               GROUP BY ALL HAVING COUNT(*) = 1),
         k AS (SELECT class, as_of, COUNT(*) FILTER (price_raw <> '0.00') AS n_matches, COUNT(*) FILTER (price_raw = '0.00') AS excluded_zero
               FROM x GROUP BY class, as_of)
"""


@query(
    "k03_class_listing",
    CLASS_SQL
    + """SELECT request_id, CASE WHEN r.class <> 'unknown' AND r.as_of >= '1995-06-01' THEN 'OK' ELSE 'NOT_IN_VALIDATED_DATASET' END AS status,
                COALESCE(n_matches, 0) AS n_matches, COALESCE(excluded_zero, 0) AS excluded_zero
         FROM {class_requests} r LEFT JOIN k USING (class, as_of)""",
)
def k03(t: Tables):
    return _listing(t).results.select("request_id", "status", "n_matches", "excluded_zero")


@query(
    "k03_class_listing_matches",
    CLASS_SQL
    + """SELECT class, as_of, code, price_raw FROM x WHERE price_raw <> '0.00'
         AND (class, as_of) IN (SELECT (class, as_of) FROM {class_requests})""",
)
def k03_matches(t: Tables):
    return _listing(t).matches.select("class", "as_of", "code", "price_raw")


@query(
    "k03_class_counts",
    CLASS_SQL
    + """SELECT c.class, d.as_of, COALESCE(n_matches, 0) AS n_matches
         FROM d CROSS JOIN (SELECT unnest(['promo', 'ring', 'other']) AS class) c LEFT JOIN k ON k.class = c.class AND k.as_of = d.as_of""",
)
def k03_counts(t: Tables):
    return _listing(t).counts.select("class", "as_of", "n_matches")


@query(
    "k03_generic_counts",
    CLASS_SQL
    + """SELECT class, as_of, name, n, row_number() OVER (PARTITION BY class, as_of ORDER BY n DESC, name) AS rank FROM (
           SELECT class, as_of, name, COUNT(*) AS n FROM (
             SELECT DISTINCT x.class, x.as_of, x.code, g.name FROM x JOIN (
               SELECT code, unnest(regexp_extract_all(upper(ingredient), '[A-Z]+ RING|PROMO')) AS name FROM {items}) g USING (code)
             WHERE price_raw <> '0.00' AND (class, as_of) IN (SELECT (class, as_of) FROM {class_requests})
               AND CASE WHEN contains(name, 'RING') THEN 'ring' ELSE 'promo' END = class) GROUP BY class, as_of, name)""",
)
def k03_generics(t: Tables):
    return _listing(t).generics

