"""Input shapes of the operators, derived from the test tables.

Each binding is one SELECT in the SQL that Spark and the checking engine share, over {table} and
{binding} names. All of them read their whole tables, so the work grows with the data. CASE expressions
spread the shapes over the rows; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refledger.operators.lookup import Dataset

DATASET = Dataset("v1", "1995-06-01", "2001-12-31")

BINDINGS: dict[str, str] = {
    # Price periods per part: one per ship day, up to the day before the next. Days with only N lines
    # close after two weeks, which leaves gaps. A last period with returned lines is delisted at zero.
    "ship_days": """
        SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS start_date,
               CAST(MIN(l_extendedprice) AS DECIMAL(18,2)) AS price, MAX(l_returnflag) AS flag
        FROM {lineitem} GROUP BY l_partkey, CAST(l_shipdate AS DATE)""",
    "ship_spans": """
        SELECT *, LEAD(start_date) OVER (PARTITION BY k ORDER BY start_date) AS nxt FROM {ship_days}""",
    "periods": """
        SELECT 'PT' || lpad(CAST(k AS STRING), 8, '0') AS code, start_date,
               CASE WHEN flag = 'N' THEN LEAST(COALESCE(nxt - 1, start_date + 13), start_date + 13)
                    WHEN nxt IS NULL THEN DATE '9999-12-31' ELSE nxt - 1 END AS end_date,
               CASE WHEN nxt IS NULL AND flag = 'R' THEN '0.00' ELSE CAST(price AS STRING) END AS price_raw,
               CAST(k * 100000000 + year(start_date) * 10000 + month(start_date) * 100 + day(start_date) AS BIGINT) AS ord
        FROM {ship_spans}""",
    # The same with overlaps: periods that open with an A flag run on for thirty days.
    "broken_periods": """
        SELECT 'PT' || lpad(CAST(k AS STRING), 8, '0') AS code, start_date,
               CASE WHEN flag = 'A' THEN start_date + 30 WHEN nxt IS NULL THEN DATE '9999-12-31' ELSE nxt - 1 END AS end_date,
               CAST(price AS STRING) AS price_raw,
               CAST(k * 100000000 + year(start_date) * 10000 + month(start_date) * 100 + day(start_date) AS BIGINT) AS ord
        FROM {ship_spans}""",
    # Items: code, two names, an ingredient text with amounts, in source order.
    "items": """
        SELECT 'PT' || lpad(CAST(p_partkey AS STRING), 8, '0') AS code,
               CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN p_name || ' Tablets ' || CAST(p_size AS STRING) || 'mg'
                    ELSE p_name END AS name_en,
               p_brand AS name_zh,
               upper(p_type)
               || CASE WHEN p_size > 45 THEN ''
                       WHEN p_type = 'LARGE' THEN ' ' || CAST(p_size AS STRING) || ' GM'
                       WHEN p_type = 'ECONOMY' THEN ' ' || CAST(p_size AS STRING) || '.50 IU'
                       ELSE ' ' || CAST(p_size AS STRING) || '.00 MG' END
               || CASE WHEN p_type = 'PROMO' THEN '+' || upper(p_name) || ' 10.50 MG/GM' ELSE '' END AS ingredient,
               CASE WHEN p_size > 40 THEN '' ELSE CAST(p_size AS STRING) END AS spec_amount,
               CASE WHEN p_size > 30 THEN '' ELSE 'GM' END AS spec_unit,
               p_name, p_brand, p_type, p_size, p_retailprice, CAST(p_partkey AS BIGINT) AS ord
        FROM {part}""",
    # Sparse announcement: the smaller half-shelf is listed, the smallest sizes are repriced.
    "announcement": """
        SELECT code, name_en, CASE WHEN p_type <> 'ECONOMY' THEN ingredient END AS ingredient, p_type AS category,
               CASE WHEN p_size <= 7 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING) END AS price_before,
               CASE WHEN p_size <= 7 THEN CAST(CAST(p_retailprice - 10 AS DECIMAL(18,2)) AS STRING) END AS price_after,
               CASE WHEN p_size <= 12 THEN '2000-09-01' END AS effective_date,
               CASE WHEN p_type <> 'LARGE' THEN 'rule ' || p_brand END AS coverage_rule, ord
        FROM {items} WHERE p_size <= 14""",
    # Requests: one per order, for the part with the customer's number.
    "requests": """
        SELECT o_orderkey AS request_id,
               CASE o_orderpriority
                    WHEN '1-URGENT' THEN 'pt-' || substr(lpad(CAST(o_custkey AS STRING), 8, '0'), 1, 4) || ' '
                                         || substr(lpad(CAST(o_custkey AS STRING), 8, '0'), 5, 4)
                    WHEN '2-HIGH' THEN p_name
                    WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'P' THEN substr(p_name, 1, 2)
                                              ELSE 'ZZ' || lpad(CAST(o_custkey AS STRING), 8, '0') END
                    WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN p_name || ' qqxw'
                                                     WHEN 'O' THEN upper(p_name) || '  ' || CAST(p_size AS STRING) || ' MG'
                                                     ELSE '  ' END
                    ELSE p_name END AS query,
               CASE o_orderpriority
                    WHEN '5-LOW' THEN CASE o_orderstatus WHEN 'F' THEN '1997-02-30' WHEN 'O' THEN '10000-01-01' ELSE '2003-01-01' END
                    WHEN '1-URGENT' THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
                    ELSE CASE o_orderstatus WHEN 'F' THEN '1995-03-15' WHEN 'O' THEN '2000-01-15' ELSE '1998-12-31' END
               END AS as_of,
               CASE WHEN o_totalprice > 450000 THEN 'v0' WHEN o_totalprice > 400000 THEN 'v1' END AS dataset_version
        FROM {orders} JOIN {part} ON p_partkey = o_custkey""",
    # Phrase requests for the announcement: names, name parts, categories, codes, nonsense.
    "phrase_requests": """
        SELECT o_orderkey AS request_id,
               CASE o_orderpriority
                    WHEN '1-URGENT' THEN 'PT' || lpad(CAST(o_custkey AS STRING), 8, '0')
                    WHEN '2-HIGH' THEN '  ' || upper(p_name)
                    WHEN '3-MEDIUM' THEN p_type
                    WHEN '4-NOT SPECIFIED' THEN p_brand || ' ' || p_name
                    ELSE CASE o_orderstatus WHEN 'F' THEN ' ' ELSE substr(p_name, 1, 2) END END AS query,
               CASE o_orderstatus WHEN 'F' THEN '1995-03-15' WHEN 'O' THEN '2000-01-15' ELSE '2030-12-31' END AS as_of,
               CASE WHEN o_totalprice > 450000 THEN 'v0' END AS dataset_version
        FROM {orders} JOIN {part} ON p_partkey = o_custkey""",
    # Class requests: one per order, class and date from its attributes.
    "class_requests": """
        SELECT o_orderkey AS request_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'promo' WHEN '2-HIGH' THEN 'ring' WHEN '3-MEDIUM' THEN 'other'
                                    WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'ring' END AS class,
               CASE o_orderstatus WHEN 'F' THEN '1995-03-15' WHEN 'O' THEN '2000-01-15' ELSE '1998-12-31' END AS as_of
        FROM {orders}""",
    # Four sources that overlap by key and contradict each other in two fields.
    "source1": "SELECT code, name_en, 'A' AS exception_note, ord AS row_no FROM {items} WHERE p_size <= 20",
    "source2": """SELECT code, name_en, 'B' AS exception_note, ord AS row_no
                  FROM {items} WHERE p_size BETWEEN 18 AND 35""",
    "source3": """SELECT code, name_en, CASE WHEN p_size > 45 THEN '' ELSE ingredient END AS ingredient,
                         p_brand AS manufacturer, ord AS row_no FROM {items} WHERE p_type IN ('PROMO', 'LARGE')""",
    "source4": """SELECT code, CASE WHEN p_size = 50 THEN upper(name_en) ELSE name_en END AS name_en,
                         p_type AS ingredient_category, '' AS exception_note, ord AS row_no FROM {items} WHERE p_size > 30""",
    # Code lists: one per order, its parts and one code that no item has.
    "listed": """
        SELECT 'R' || CAST(l_orderkey AS STRING) AS rule_id, l_partkey AS pos,
               'PT' || lpad(CAST(l_partkey AS STRING), 8, '0') AS code
        FROM {lineitem} GROUP BY l_orderkey, l_partkey
        UNION ALL
        SELECT 'R' || CAST(o_orderkey AS STRING), CAST(-1 AS BIGINT), 'ZZ' || lpad(CAST(o_orderkey AS STRING), 8, '0') FROM {orders}""",
    "rule_requests": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE 'R' END || CAST(o_orderkey AS STRING) AS rule_id,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN '1999-02-29'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS as_of
        FROM {orders}""",
    # Answer log: a subject is one user's week; the id comes from event type and third of the day.
    "answer_log": """
        SELECT event_id, ts, user_id, CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS week, value,
               CASE event_type WHEN 'signup' THEN CASE WHEN hour(ts) < 16 THEN 'prerequisite' ELSE 'criterion' END
                               WHEN 'view' THEN 'criterion' WHEN 'click' THEN 'criterion' ELSE 'factor' END AS kind,
               CASE event_type
                    WHEN 'signup' THEN CASE WHEN hour(ts) < 8 THEN 'a-1' WHEN hour(ts) < 16 THEN 'a-2' ELSE 'a-3' END
                    WHEN 'view' THEN CASE WHEN hour(ts) < 8 THEN 'a-1-1' WHEN hour(ts) < 16 THEN 'a-1-2' ELSE 'a-2-1' END
                    WHEN 'click' THEN CASE WHEN hour(ts) < 8 THEN 'b-1' WHEN hour(ts) < 16 THEN 'b-2' ELSE 'c-1' END
                    WHEN 'purchase' THEN CASE WHEN hour(ts) < 8 THEN 'f-1' WHEN hour(ts) < 16 THEN 'f-2' ELSE 'f-3' END
                    ELSE CASE WHEN hour(ts) < 8 THEN 'f-4-1' WHEN hour(ts) < 16 THEN 'f-4-2' ELSE 'f-4-3' END END AS id,
               CASE WHEN value >= 3 THEN value > 60 END AS answer
        FROM {events}""",
    "subjects": """
        SELECT user_id, week, CASE WHEN COUNT(*) >= 10 THEN MAX(value) END AS measure
        FROM {answer_log} GROUP BY user_id, week""",
    # Token lists and a shelf of codes.
    "tokens": "SELECT p_partkey, p_type || ',' || p_brand AS sections, 'PT' || lpad(CAST(p_partkey AS STRING), 8, '0') AS code FROM {part}",
    "shipped": "SELECT DISTINCT 'PT' || lpad(CAST(l_partkey AS STRING), 8, '0') AS code FROM {lineitem} WHERE l_quantity = 50 AND l_returnflag = 'R'",
    # Two snapshots of the parts.
    "snapshot_old": "SELECT p_partkey, p_name, p_brand, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM {part} WHERE p_brand <> 'Brand#9'",
    "snapshot_new": """SELECT p_partkey, p_name, p_brand, CAST(CASE WHEN p_size > 45 THEN p_retailprice + 1 ELSE p_retailprice END AS DECIMAL(18,2)) AS price
                       FROM {part} WHERE p_brand <> 'Brand#7'""",
    # Criteria over the parts: each brand is a group whose prerequisite is its first name.
    "criteria": """
        SELECT 'C' || CAST(p_partkey AS STRING) AS criterion_id, p_brand AS group_id, p_name || '。' AS text,
               prerequisite_label, p_partkey AS ord
        FROM {part} JOIN (SELECT p_brand AS of_brand, MIN(p_name) AS prerequisite_label FROM {part} GROUP BY p_brand) ON of_brand = p_brand""",
    # Turns of a conversation as a self-referencing table: every turn but the first names the first.
    "turns": """
        SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS factor_id,
               CASE WHEN turn > 0 THEN CAST(conv_id AS STRING) || ':0' END AS parent_id,
               CASE WHEN turn = 0 THEN 3 END AS required, conv_id, turn, role, text,
               conv_id * 100000 + turn AS ord
        FROM {conversations}""",
    # Request log: a name, an amount, a date in one of several spellings, a filter word. The test table is
    # one file, hence one split; mining costs more than a shuffle of its lines, so they are spread first, over as
    # many partitions as the session's settings and the size of the rows give.
    "request_log": """
        SELECT /*+ REPARTITION */ o_orderkey AS request_id, p_name, p_brand, p_size, o_orderstatus AS st, o_orderpriority AS pr,
               CAST(o_orderdate AS DATE) AS odate,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN p_name || ' ' || p_brand
                    ELSE p_name || ' ' || p_brand || ' ' || CAST(p_size AS STRING) || '.50 MG '
                         || CASE WHEN o_orderpriority = '5-LOW' THEN '1997-02-30 9/1'
                                 WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
                                 WHEN o_orderstatus = 'O' THEN CAST(year(o_orderdate) - 1911 AS STRING) || '/'
                                      || CAST(month(o_orderdate) AS STRING) || '/' || CAST(day(o_orderdate) AS STRING)
                                 ELSE 'Today' END
                         || CASE o_orderpriority WHEN '1-URGENT' THEN ' repriced' WHEN '2-HIGH' THEN ' price not changed'
                                 WHEN '3-MEDIUM' THEN ' 未調價的' ELSE '' END END AS line,
               '1998-12-31' AS as_of, '2000-06-15' AS today, '2000-09-01' AS announced,
               CAST(NULL AS STRING) AS dataset_version
        FROM {orders} JOIN {part} ON p_partkey = o_custkey""",
    # Order dates printed as packed era dates, some of them no dates.
    "packed_dates": """
        SELECT o_orderkey,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN '9991231'
                    WHEN o_orderpriority = '5-LOW' THEN '  991331'
                    ELSE lpad(CAST(year(o_orderdate) - 1911 AS STRING), 3, ' ')
                         || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') END AS packed,
               CASE WHEN o_orderpriority = '5-LOW' THEN '99/13/31'
                    ELSE CAST(year(o_orderdate) - 1911 AS STRING) || CASE o_orderstatus WHEN 'F' THEN '/' WHEN 'O' THEN '.' ELSE '-' END
                         || CAST(month(o_orderdate) AS STRING) || CASE o_orderstatus WHEN 'F' THEN '/' WHEN 'O' THEN '.' ELSE '-' END
                         || CAST(day(o_orderdate) AS STRING) END AS spelt,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS iso, o_orderpriority, o_orderstatus
        FROM {orders}""",
    # Price texts as a file may hold them.
    "price_texts": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_discount = 0 THEN ' 0.00 ' WHEN l_tax = 0 THEN '-' WHEN l_tax > 0.07 THEN '0'
                    ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS price_raw, l_quantity, l_tax
        FROM {lineitem}""",
    # Rule texts: an order is a document, its lines are headings, groups, nested and flat items.
    "rule_parts": """
        SELECT l_orderkey AS doc, l_linenumber AS ln, MIN(l_returnflag) AS flag, MIN(l_linestatus) AS st,
               MIN(p_name) AS name, MIN(p_size) AS size
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber""",
    "rule_lines": """
        SELECT DISTINCT doc, 1 AS ord, '●CRITERIA：' AS line FROM {rule_parts}
        UNION ALL SELECT DISTINCT doc, 2, '一、Tier A：' FROM {rule_parts}
        UNION ALL SELECT DISTINCT doc, 3, 'PAGE HEADER    right column' FROM {rule_parts}
        UNION ALL SELECT doc, ln * 10, '二、Tier B：' FROM {rule_parts} WHERE flag = 'R'
        UNION ALL SELECT doc, ln * 10, '(一)' || name || '，包含：' FROM {rule_parts} WHERE flag = 'A'
        UNION ALL SELECT doc, ln * 10 + 1, '    1. view of' FROM {rule_parts} WHERE flag = 'A'
        UNION ALL SELECT doc, ln * 10 + 2, '          2' FROM {rule_parts} WHERE flag = 'A' AND st = 'F'
        UNION ALL SELECT doc, ln * 10 + 3, '       ' || name || ' m' FROM {rule_parts} WHERE flag = 'A'
        UNION ALL SELECT doc, ln * 10 + 4, '    2. 第' || CAST(size AS STRING) || '項' FROM {rule_parts} WHERE flag = 'A'
        UNION ALL SELECT doc, ln * 10, '(二) flat ' || name FROM {rule_parts} WHERE flag = 'N'
        UNION ALL SELECT DISTINCT doc, 900, '●FACTORS：' FROM {rule_parts}
        UNION ALL SELECT doc, 900 + ln * 10, substr('一二三四五六七', ln, 1) || '、' || name FROM {rule_parts} WHERE st = 'F'
        UNION ALL SELECT doc, 900 + ln * 10, substr('一二三四五六七', ln, 1) || '、' || name || '符合以下至少二項：' FROM {rule_parts} WHERE st = 'O'
        UNION ALL SELECT doc, 900 + ln * 10 + 1, '(一)part one' FROM {rule_parts} WHERE st = 'O'
        UNION ALL SELECT doc, 900 + ln * 10 + 2, '(二)part two of' FROM {rule_parts} WHERE st = 'O'
        UNION ALL SELECT doc, 900 + ln * 10 + 3, '    -' || name FROM {rule_parts} WHERE st = 'O'
        UNION ALL SELECT DISTINCT doc, 990, '●END：' FROM {rule_parts}""",
}


# Bindings whose group keys are nearly unique: adding rows up before the shuffle only fills memory with a whole split of
# the file, so the table is dealt out by the keys first and added up once.
DEALT: dict[str, dict[str, list[str]]] = {
    "ship_days": {"lineitem": ["l_partkey"]},
    "listed": {"lineitem": ["l_orderkey"]},
}


# Order lines of one part of the rule texts, and parts at most.
PART_ROWS, MOST_PARTS = 1 << 16, 100_000


def rule_parts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The binding `rule_parts`, its rows dealt out by document once, for all steps that work within one."""
    named = lineitem.join(part, F.col("p_partkey") == F.col("l_partkey"))
    named = named.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("ln"), "l_returnflag", "l_linestatus", "p_name", "p_size")
    # Each row becomes several lines, which are sorted more than once where they lie: parts are sized by rows for that.
    parts = max(1, min(MOST_PARTS, -(-lineitem.count() // PART_ROWS)))
    return named.repartition(parts, "doc").groupBy("doc", "ln").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("st"), F.min("p_name").alias("name"), F.min("p_size").alias("size")
    )


def rule_lines(parts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The binding `rule_lines` in one pass: each order line gives its text lines, the first one also the frame.

    Columns in `keep` stand beside the lines; `first` among them is the document's first line number.
    """
    # Texts: those that hold it, its place (a fixed one, or beyond ten times the line number), and prefix, numeral, part, suffix.
    texts = [
        ("opens", (0, 1), ("●CRITERIA：", 0, "", "")),
        ("opens", (0, 2), ("一、Tier A：", 0, "", "")),
        ("opens", (0, 3), ("PAGE HEADER    right column", 0, "", "")),
        ("R", (10, 0), ("二、Tier B：", 0, "", "")),
        ("A", (10, 0), ("(一)", 0, "name", "，包含：")),
        ("A", (10, 1), ("    1. view of", 0, "", "")),
        ("AF", (10, 2), ("          2", 0, "", "")),
        ("A", (10, 3), ("       ", 0, "name", " m")),
        ("A", (10, 4), ("    2. 第", 0, "size", "項")),
        ("N", (10, 0), ("(二) flat ", 0, "name", "")),
        ("opens", (0, 900), ("●FACTORS：", 0, "", "")),
        ("F", (10, 900), ("", 1, "name", "")),
        ("O", (10, 900), ("", 1, "name", "符合以下至少二項：")),
        ("O", (10, 901), ("(一)part one", 0, "", "")),
        ("O", (10, 902), ("(二)part two of", 0, "", "")),
        ("O", (10, 903), ("    -", 0, "name", "")),
        ("opens", (0, 990), ("●END：", 0, "", "")),
    ]
    # At most seven line numbers per order.
    first = parts.withColumn("first", F.min("ln").over(Window.partitionBy("doc")))
    # The texts of each kind of row stand in a table: rows of conditions and texts make code that is too long to be compiled.
    flags, states = ("", "A", "R", "N"), ("", "F", "O")
    held = [
        F.array(*[F.lit(i) for i, (who, *_) in enumerate(texts) if who in {"opens" * opens, flag, state, flag + state} - {""}]).cast("array<int>")
        for opens in (0, 1) for flag in flags for state in states
    ]
    number = lambda col, words: sum((F.when(F.col(col) == w, i).otherwise(0) for i, w in enumerate(words) if w), F.lit(0))
    opens = F.when(F.col("ln") == F.col("first"), 1).otherwise(0)
    kind = (opens * len(flags) + number("flag", flags)) * len(states) + number("st", states)
    made = first.select("doc", "ln", "name", "size", "first", F.explode(F.get(F.array(*held), kind)).alias("i"))
    of = lambda values: F.get(F.lit(list(values)), F.col("i"))
    factor = of(t[1][0] for t in texts)
    place = F.when(factor == 0, 0).otherwise(F.col("ln") * factor) + of(t[1][1] for t in texts)
    word = F.when(of(t[2][1] for t in texts) == 1, F.concat(F.substring(F.lit("一二三四五六七"), F.col("ln"), F.lit(1)), F.lit("、"))).otherwise("")
    which = of(t[2][2] for t in texts)
    part = F.when(which == "name", F.col("name")).when(which == "size", F.col("size").cast("string")).otherwise("")
    line = F.concat(of(t[2][0] for t in texts), word, part, of(t[2][3] for t in texts))
    return made.select("doc", place.cast("int").alias("ord"), line.alias("line"), *keep)


# Only the checking engine reads these: the same shapes derived in another way.
ORACLE_BINDINGS: dict[str, str] = {
    "o_lines": """
        SELECT doc_id, generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS line
        FROM (SELECT doc_id, string_split(replace(text, chr(12), ''), chr(10)) AS l FROM {documents})""",
    "o_fields": r"""
        SELECT *, regexp_replace(lower(name_en), '(\d)\s+(mg|mcg|gm|ml|iu|g)\b', '\1\2', 'g') AS f_en, lower(name_zh) AS f_zh,
               regexp_replace(lower(ingredient), '(\d)\s+(mg|mcg|gm|ml|iu|g)\b', '\1\2', 'g') AS f_in FROM {items}""",
    "o_gated": """
        SELECT *, COALESCE(regexp_full_match(as_of, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(as_of AS DATE) IS NOT NULL
                  AND as_of <= '2001-12-31' AND COALESCE(dataset_version, 'v1') = 'v1', false) AS answerable FROM {requests}""",
    "o_queries": r"""
        SELECT DISTINCT query, upper(regexp_replace(query, '[\s-]', '', 'g')) AS as_code,
               regexp_replace(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), '(\d)\s+(mg|mcg|gm|ml|iu|g)\b', '\1\2', 'g') AS as_text
        FROM {o_gated} WHERE answerable""",
    "o_code_hits": """
        SELECT query, code, ord FROM {o_queries} JOIN {items} ON as_code = code
        WHERE regexp_full_match(as_code, '[A-Z0-9]{{10}}')""",
    "o_term_hits": """
        SELECT query, code, ord FROM {o_queries} JOIN {o_fields}
          ON as_text <> '' AND len(list_filter(string_split(as_text, ' '),
               lambda t: NOT (contains(f_en, t) OR contains(f_zh, t) OR contains(f_in, t)))) = 0
        WHERE query NOT IN (SELECT query FROM {o_code_hits})""",
    "o_candidates": "SELECT * FROM {o_code_hits} UNION ALL SELECT * FROM {o_term_hits}",
    "o_priced": """
        SELECT a.query, a.as_of, c.code, c.ord, MIN(p.price_raw) AS price_raw
        FROM (SELECT DISTINCT query, as_of FROM {o_gated} WHERE answerable) a JOIN {o_candidates} c USING (query)
        JOIN {periods} p ON p.code = c.code AND CAST(a.as_of AS DATE) BETWEEN p.start_date AND p.end_date
        GROUP BY a.query, a.as_of, c.code, c.ord HAVING COUNT(*) = 1""",
    "o_counts": """
        SELECT query, as_of, COUNT(*) FILTER (TRY_CAST(price_raw AS DOUBLE) IS DISTINCT FROM 0) AS n_matches,
               COUNT(*) FILTER (TRY_CAST(price_raw AS DOUBLE) = 0) AS excluded_zero FROM {o_priced} GROUP BY query, as_of""",
    "o_raw_mentions": r"""
        SELECT code, ord, 1 AS fld, unnest(regexp_extract_all(ingredient, '(?i)\d+(?:\.\d+)?\s*(?:MCG|MG|GM|ML|IU|G|%)(?:\s*/\s*(?:MCG|MG|GM|ML|G))?')) AS raw FROM {items}
        UNION ALL
        SELECT code, ord, 2, unnest(regexp_extract_all(name_en, '(?i)\d+(?:\.\d+)?\s*(?:MCG|MG|GM|ML|IU|G|%)(?:\s*/\s*(?:MCG|MG|GM|ML|G))?')) FROM {items}""",
    "o_mentions": r"""
        SELECT DISTINCT code, ord, amount, unit, num || unit AS key, num || ' ' || unit AS label FROM (
          SELECT code, ord, CAST(regexp_extract(raw, '^[0-9.]+') AS DOUBLE) AS amount,
                 regexp_replace(regexp_replace(regexp_extract(raw, '^[0-9.]+'), '(\.\d*?)0+$', '\1'), '\.$', '') AS num,
                 CASE upper(regexp_extract(raw, '[A-Za-z%].*$')) WHEN 'MG' THEN 'mg' WHEN 'GM' THEN 'g' WHEN 'IU' THEN 'IU' WHEN 'MG/GM' THEN 'mg/g' END AS unit
          FROM {o_raw_mentions})""",
    "o_answers": """
        SELECT user_id, week, kind, id, answer FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, week, kind, id ORDER BY ts DESC, event_id DESC) AS rn FROM {answer_log})
        WHERE rn = 1 AND answer IS NOT NULL""",
    "o_sheet": "SELECT s.user_id, s.week, ANY_VALUE(measure) AS measure, "
    + ", ".join(
        f"bool_or(answer) FILTER (kind = '{kind}' AND id = '{id_}') AS {name}"
        for kind, id_, name in (
            ("prerequisite", "a-1", "pa1"), ("prerequisite", "a-2", "pa2"),
            ("criterion", "a-1-1", "a11"), ("criterion", "a-1-2", "a12"), ("criterion", "a-2-1", "a21"), ("criterion", "a-3", "a3"),
            ("criterion", "b-1", "b1"), ("criterion", "b-2", "b2"), ("criterion", "c-1", "c1"),
            ("factor", "f-1", "f1"), ("factor", "f-2", "f2"), ("factor", "f-3", "f3"),
            ("factor", "f-4-1", "f41"), ("factor", "f-4-2", "f42"), ("factor", "f-4-3", "f43"),
        )
    )
    + " FROM {subjects} s LEFT JOIN {o_answers} a ON a.user_id = s.user_id AND a.week = s.week GROUP BY s.user_id, s.week",
    "o_facts": """
        SELECT *, CASE WHEN a3 IS NULL THEN pa1 WHEN pa1 IS NULL OR pa1 = a3 THEN a3 END AS fact, measure >= 200 AS c2,
               CASE WHEN yes4 >= 2 THEN true WHEN yes4 + unk4 < 2 THEN false END AS f4
        FROM (SELECT *, COALESCE(CAST(f41 AS INT), 0) + COALESCE(CAST(f42 AS INT), 0) + COALESCE(CAST(f43 AS INT), 0) AS yes4,
                     CAST(f41 IS NULL AS INT) + CAST(f42 IS NULL AS INT) + CAST(f43 IS NULL AS INT) AS unk4 FROM {o_sheet})""",
    "o_truths": """
        SELECT *, ga1 OR ga2 OR fact AS ta FROM (
          SELECT *, fact AND (a11 OR a12) AS ga1, pa2 AND a21 AS ga2, b1 OR b2 AS tb, c1 OR c2 AS tc FROM {o_facts})""",
}
