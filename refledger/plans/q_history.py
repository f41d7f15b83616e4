"""Histories: D01, E01, E02, E15, F01, F02, G03, B12, C07, C10, C11, A13."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.functions.numbers import is_zero
from refledger.functions.text import is_code
from refledger.operators import contracts, history
from refledger.operators.lookup import drop_zero
from refledger.plans.registry import Tables, query
from refledger.sources.workspace import cut, fresh_path


AS_ORDERED = """SELECT r.o_orderkey AS request_id, 'PT' || lpad(CAST(l.l_partkey AS STRING), 8, '0') AS code,
              strftime(CAST(r.o_orderdate AS DATE), '%Y-%m-%d') AS as_of, MIN(p.price_raw) AS price_raw,
              strftime(MIN(p.start_date), '%Y-%m-%d') AS start_date
       FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {lineitem}) l JOIN {orders} r ON r.o_orderkey = l.l_orderkey
       JOIN {periods} p ON p.code = 'PT' || lpad(CAST(l.l_partkey AS STRING), 8, '0')
            AND CAST(r.o_orderdate AS DATE) BETWEEN p.start_date AND p.end_date
       GROUP BY ALL HAVING COUNT(*) = 1"""


def _priced(t: Tables, periods):
    """Every ordered part, priced as of its order's date."""
    asks = t.sql("""
        SELECT o_orderkey AS request_id, code, odate AS as_of FROM
          (SELECT DISTINCT l_orderkey, 'PT' || lpad(CAST(l_partkey AS STRING), 8, '0') AS code FROM {lineitem})
          JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS odate FROM {orders}) ON o_orderkey = l_orderkey""")
    return history.asof_one(asks, periods, "code", "as_of", ["price_raw"]).select(
        "request_id", "code", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "price_raw",
        F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
    )


@query("d01_asof_interval_join", AS_ORDERED)
def d01(t: Tables):
    return _priced(t, t["periods"])


@query("d01_asof_stored_by_key", AS_ORDERED)
def d01_stored(t: Tables):
    """The same from a history that is stored by its key, of which nothing is shuffled."""
    path = fresh_path(t.spark, "history")
    stored = history.store_history(t["periods"], "code", ["price_raw"], path)
    # Opened again, as another application would.
    return _priced(t, history.open_history(t.spark, path, "code", stored.buckets))


@query(
    "d01_asof_overlapping_periods",
    """SELECT DISTINCT p.code, strftime(a.d, '%Y-%m-%d') AS as_of, x.price_raw, x.ord
       FROM (SELECT DISTINCT code, start_date + 20 AS d FROM {broken_periods}) a JOIN (SELECT DISTINCT code FROM {items}) p USING (code),
            LATERAL (SELECT MIN(price_raw) AS price_raw, MIN(ord) AS ord, COUNT(*) AS n FROM {broken_periods} b
                     WHERE b.code = p.code AND a.d BETWEEN b.start_date AND b.end_date) x
       WHERE x.n = 1""",
)
def d01_overlap(t: Tables):
    """Where histories overlap, a date that two periods cover resolves to nothing."""
    periods = t["broken_periods"]
    asks = periods.select("code", F.date_add("start_date", 20).alias("as_of")).distinct()
    return history.asof_one(asks, periods, "code", "as_of", ["price_raw", "ord"]).select(
        "code", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "price_raw", "ord"
    )


@query(
    "e01_to_history",
    """SELECT code, row_number() OVER (PARTITION BY code ORDER BY start_date, end_date, ord) AS seq,
              strftime(start_date, '%Y-%m-%d') AS start_date, price_raw,
              first_value(price_raw) OVER (PARTITION BY code ORDER BY ord) AS first_price,
              COUNT(*) OVER (PARTITION BY code) AS n_periods FROM {periods}""",
)
def e01(t: Tables):
    rows = t["periods"].withColumn("first_price", F.col("price_raw"))
    return history.to_history(rows, "code", ["first_price"]).select(
        "code", "seq", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"), "price_raw", "first_price", "n_periods"
    )


@query(
    "g03_history_order",
    """SELECT code, ord, row_number() OVER (PARTITION BY code ORDER BY start_date, end_date, ord) AS seq
       FROM {broken_periods}""",
)
def g03(t: Tables):
    return history.numbered_periods(t["broken_periods"], "code").select("code", "ord", "seq")


@query(
    "f01_interval_overlaps",
    """SELECT code, ord, earlier_end FROM (
         SELECT code, ord, MAX(end_date) OVER w >= start_date AS hit,
                strftime(MAX(end_date) OVER w, '%Y-%m-%d') AS earlier_end FROM {broken_periods}
         WINDOW w AS (PARTITION BY code ORDER BY start_date, end_date, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
       WHERE hit""",
)
def f01(t: Tables):
    return history.overlaps(t["broken_periods"], "code").select(
        "code", "ord", F.date_format("earlier_end", "yyyy-MM-dd").alias("earlier_end")
    )


@query(
    "f02_interval_gaps",
    """SELECT code, strftime(CAST(covered + 1 AS DATE), '%Y-%m-%d') AS gap_start,
              strftime(CAST(start_date - 1 AS DATE), '%Y-%m-%d') AS gap_end, CAST(start_date - covered - 1 AS BIGINT) AS gap_days
       FROM (SELECT code, start_date, MAX(end_date) OVER (PARTITION BY code ORDER BY start_date
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM {periods})
       WHERE start_date - covered > 1""",
)
def f02(t: Tables):
    found = history.gaps(t["periods"], "code")
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("gap_start", "gap_end")})


@query(
    "b12_is_zero_price",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price_raw,
              COALESCE(TRY_CAST(trim(price_raw) AS DOUBLE) = 0, false) AS zero FROM {price_texts}""",
)
def b12(t: Tables):
    return t["price_texts"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_raw", is_zero(F.col("price_raw")).alias("zero")
    )


@query(
    "c07_drop_zero_priced",
    """SELECT l_partkey, COUNT(*) FILTER (TRY_CAST(trim(price_raw) AS DOUBLE) IS DISTINCT FROM 0) AS n_matches,
              COUNT(*) FILTER (TRY_CAST(trim(price_raw) AS DOUBLE) = 0) AS excluded_zero
       FROM {price_texts} GROUP BY l_partkey""",
)
def c07(t: Tables):
    return drop_zero(t["price_texts"], "price_raw", ["l_partkey"])[1]


@query(
    "c07_kept_rows",
    """SELECT l_partkey, COUNT(*) AS n, COUNT(DISTINCT price_raw) AS prices FROM {price_texts}
       WHERE TRY_CAST(trim(price_raw) AS DOUBLE) IS DISTINCT FROM 0 GROUP BY l_partkey""",
)
def c07_kept(t: Tables):
    kept = drop_zero(t["price_texts"], "price_raw", ["l_partkey"])[0]
    return kept.groupBy("l_partkey").agg(F.count("*").alias("n"), F.countDistinct("price_raw").alias("prices"))


@query(
    "c10_expect_count",
    """SELECT 'count' AS check_id, 'periods' AS dataset, '' AS key, CAST(COUNT(*) AS STRING) AS detail FROM {periods}""",
)
def c10(t: Tables):
    """The check reports the count it found, since no dataset has a negative one."""
    return contracts.expect_count(t["periods"], -1, "periods")


@query(
    "c11_expect_valid",
    """SELECT 'valid' AS check_id, 'periods' AS dataset, code || '|' || CAST(ord AS STRING) AS key, rule AS detail FROM (
         SELECT code, ord, 'price' AS rule FROM {broken_periods} WHERE price_raw < '2'
         UNION ALL SELECT code, ord, 'dates' FROM {broken_periods} WHERE NOT (start_date + 40 <= end_date)
         UNION ALL SELECT code, ord, 'code' FROM {broken_periods} WHERE NOT regexp_full_match(code, '[A-Z0-9]{{10}}'))""",
)
def c11(t: Tables):
    rules = {
        "price": F.col("price_raw") >= "2",
        "dates": F.date_add("start_date", 40) <= F.col("end_date"),
        "code": is_code(F.col("code")),
    }
    return contracts.expect_valid(t["broken_periods"], rules, "periods", ["code", "ord"])


@query(
    "e02_attribute_invariance",
    """WITH v AS (SELECT o_custkey, 'status' AS field, o_orderstatus AS v, o_orderkey FROM {orders}
                  UNION ALL SELECT o_custkey, 'priority', o_orderpriority, o_orderkey FROM {orders}),
            f AS (SELECT *, first_value(v) OVER (PARTITION BY o_custkey, field ORDER BY o_orderkey) AS v1,
                         MIN(o_orderkey) OVER (PARTITION BY o_custkey, field) AS k1 FROM v)
       SELECT 'invariant' AS check_id, 'orders' AS dataset, CAST(o_custkey AS STRING) AS key,
              'rows ' || CAST(k1 AS STRING) || ' and ' || CAST(MIN(o_orderkey) AS STRING) || ' differ in ' || field AS detail
       FROM f WHERE v <> v1 GROUP BY o_custkey, field, k1""",
)
def e02(t: Tables):
    rows = t["orders"].select(
        "o_custkey", F.col("o_orderkey").alias("row_no"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    return contracts.expect_invariant(rows, "o_custkey", ["status", "priority"], "orders")


@query(
    "e15_expect_cardinality",
    """SELECT 'cardinality' AS check_id, 'part' AS dataset, key, CAST(n AS STRING) AS detail FROM (
         SELECT 'p_brand' AS key, COUNT(DISTINCT p_brand) AS n FROM {part}
         UNION ALL SELECT 'p_type', COUNT(DISTINCT p_type) FROM {part}
         UNION ALL SELECT 'p_name', COUNT(DISTINCT p_name) FROM {part}) WHERE n > 20""",
)
def e15(t: Tables):
    return contracts.expect_cardinality(t["part"], ["p_brand", "p_type", "p_name"], 20, "part")


WIDE = ("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey", "l_orderkey")


@query(
    "e15_cardinality_by_sketches",
    " UNION ALL ".join(
        f"SELECT 'cardinality' AS check_id, 'lineitem' AS dataset, '{c}' AS key, CAST(COUNT(DISTINCT {c}) AS STRING) AS detail FROM {{lineitem}} HAVING COUNT(DISTINCT {c}) > 1500"
        for c in WIDE
    ),
)
def e15_sketches(t: Tables):
    """Sketches per line status, merged; only columns near the bound or over it are counted."""
    kept = cut(contracts.column_sketches(t["lineitem"], WIDE, ["l_linestatus"]).withColumnRenamed("l_linestatus", "part"), "sketches")
    return contracts.expect_cardinality(t["lineitem"], WIDE, 1500, "lineitem", kept)
