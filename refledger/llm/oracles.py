"""The same results as SQL over the test tables, for the operators that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from refledger.llm.url_graph import Rule, rounds_for

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def link_trust(rules: Sequence[Rule], damping: float = 0.85, tolerance: float = 1e-6, seed_share: float = 0.5, threshold: float = 1.0) -> str:
    """Rules, links, and propagation to the tolerance. Seeds are links out of '', which keeps what it has."""
    listed = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', '{r.name}')" for r in rules)
    low = f"'{_UPPER}', '{_LOWER}'"
    rounds = rounds_for(damping, tolerance)
    return rf"""
    WITH RECURSIVE r(ruled, rhost, rpath, rule) AS (VALUES {listed}),
    p AS MATERIALIZED (SELECT page_id, html, COALESCE(translate(regexp_extract(rest, '^([^/?#]*)', 1), {low}), '') AS host,
                              COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
          FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
    hp AS (SELECT DISTINCT host, path FROM p WHERE host <> ''),
    best AS MATERIALIZED (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(ruled, length(rule)) AS ruled
             FROM hp JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
    judged AS MATERIALIZED (SELECT page_id, p.host, p.path, rule, ruled FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path),
    hosts AS (SELECT host, AVG(CASE WHEN ruled = 'allow' THEN 1.0 ELSE 0 END) AS good, AVG(CASE WHEN ruled = 'block' THEN 1.0 ELSE 0 END) AS bad
              FROM judged WHERE host <> '' GROUP BY host),
    seeds AS (SELECT host, CASE WHEN good >= {seed_share} THEN good ELSE 0 END AS good, CASE WHEN bad >= {seed_share} THEN bad ELSE 0 END AS bad FROM hosts),
    told AS MATERIALIZED (SELECT src, dst, CAST(COUNT(*) AS DOUBLE) AS links FROM (
              SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html,
                '(?i)(?:href|src|action)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1), lambda x: translate(x, {low})))) AS dst FROM p WHERE host <> '')
            WHERE src <> dst GROUP BY src, dst),
    known AS MATERIALIZED (SELECT DISTINCT host FROM p WHERE host <> '' UNION SELECT dst FROM told),
    above AS (SELECT host, up, array_to_string(list_slice(string_split(host, '.'), up + 1, NULL), '.') AS domain
              FROM (SELECT host, unnest(range(1, len(string_split(host, '.')))) AS up FROM known)),
    kin AS (SELECT a.host, arg_min(a.domain, a.up) AS domain FROM above a JOIN known k ON k.host = a.domain GROUP BY a.host),
    edges AS MATERIALIZED (SELECT src, dst, SUM(links) AS links FROM (
              SELECT * FROM told UNION ALL SELECT host, domain, 1 FROM kin UNION ALL SELECT domain, host, 1 FROM kin) GROUP BY src, dst),
    steps AS MATERIALIZED (SELECT here, dst, SUM(f) AS f, SUM(b) AS b FROM (
              SELECT src AS here, dst, links / SUM(links) OVER (PARTITION BY src) AS f, 0.0 AS b FROM edges
              UNION ALL SELECT dst, src, 0.0, links / SUM(links) OVER (PARTITION BY dst) FROM edges) GROUP BY here, dst),
    state_0 AS MATERIALIZED (SELECT host, COALESCE(good / NULLIF(SUM(good) OVER (), 0), 0) AS trust, COALESCE(bad / NULLIF(SUM(bad) OVER (), 0), 0) AS distrust FROM seeds),
    flow AS MATERIALIZED (SELECT here, dst, {damping} * f AS f, {damping} * b AS b FROM steps
              UNION ALL SELECT '', host, {1 - damping} * trust, {1 - damping} * distrust FROM state_0 UNION ALL SELECT '', '', 1.0, 1.0),
    state(i, host, trust, distrust) AS (SELECT 0, host, trust, distrust FROM state_0 UNION ALL SELECT 0, '', 1.0, 1.0
              UNION ALL SELECT i + 1, dst, SUM(f * trust), SUM(b * distrust) FROM state JOIN flow ON here = host WHERE i < {rounds} GROUP BY i, dst),
    scores AS MATERIALIZED (SELECT host, COALESCE(trust / NULLIF(SUM(trust) OVER (), 0), 0) AS trust, COALESCE(distrust / NULLIF(SUM(distrust) OVER (), 0), 0) AS distrust
               FROM state WHERE i = {rounds} AND host <> '')
    SELECT page_id, j.host, path, rule,
           COALESCE(ruled, CASE WHEN distrust > trust AND distrust >= {threshold} * (SELECT AVG(distrust) FROM scores) THEN 'block' ELSE 'allow' END) AS verdict,
           round(COALESCE(trust, 0), 6) AS trust, round(COALESCE(distrust, 0), 6) AS distrust
    FROM judged j LEFT JOIN scores s ON s.host = j.host"""


def rendezvous(shards: int, overhead: int = 8) -> str:
    """Equal weights, `shards` of them and then one more. CRC-32 goes byte by byte through its table."""
    return f"""
    WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
    b AS (SELECT doc_id, hex(encode(text)) AS h, CAST(strlen(text) AS BIGINT) AS n, CAST(doc_id AS VARCHAR) AS k FROM documents),
    s AS (SELECT *, md5(COALESCE(k, '')) AS place, list_transform(range({shards + 1}), lambda i:
            -ln((CAST(('0x' || substr(md5(COALESCE(k, '') || '|' || CAST(i AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)) AS cost FROM b),
    c AS (SELECT *, list_position(cost[1:{shards}], list_min(cost[1:{shards}])) - 1 AS shard, list_position(cost, list_min(cost)) - 1 AS grown FROM s),
    d AS (SELECT doc_id, CAST(COALESCE(n, 0) + {overhead} AS BIGINT) AS size, xor(4294967295, list_reduce(
            list_concat([4294967295], list_transform(regexp_extract_all(h, '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
            lambda c, x: xor(crc[CAST((xor(c, x) & 255) + 1 AS BIGINT)], c >> 8))) AS text_crc32, shard, grown, place FROM c, t)
    SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM d"""


_CRC = """t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text, byte by byte through the table `crc` of t."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295],
            list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(('0x' || x) AS BIGINT))),
            lambda c, x: xor(crc[CAST((xor(c, x) & 255) + 1 AS BIGINT)], c >> 8)))"""


def manifest() -> str:
    """Pairs of nodes, level by level; proofs are the siblings on the way, and leaves are folded along it."""

    def told(value: str) -> str:
        return f"COALESCE(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""{name}(tree, height, level, pos, d) AS (SELECT tree, height, 0, pos, d FROM {leaves}
            UNION ALL SELECT tree, height, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM {name}
            WHERE level < height GROUP BY tree, height, level, pos // 2)"""

    def height(n: str) -> str:
        return f"CAST(len(list_filter(range(62), lambda i: (1::BIGINT << i::INTEGER) < {n})) AS INTEGER)"

    return f"""
    WITH RECURSIVE {_CRC},
    d AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {leaf('n_chars + 1')} END AS tampered FROM documents, t),
    trees AS (SELECT lang, {height('count(*)')} AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM d GROUP BY lang),
    leaves AS MATERIALIZED (SELECT d.*, tree, height, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d
               FROM d JOIN trees ON d.lang IS NOT DISTINCT FROM trees.lang),
    {levels('low', 'leaves')},
    subs AS MATERIALIZED (SELECT tree AS pos, d, (SELECT {height('count(*)')} FROM trees) AS height, 0 AS tree FROM low WHERE level = height),
    {levels('high', 'subs')},
    nodes AS MATERIALIZED (SELECT tree, level, pos, d FROM low WHERE level < height
               UNION ALL SELECT -1, level, pos, d FROM high WHERE level < height),
    folds(tree, pos, leaf, level, here, place, levels, upper, acc, proof) AS (
      SELECT l.tree, l.pos, l.leaf, 0, l.tree, l.pos, l.height, (SELECT any_value(height) FROM subs), COALESCE(tampered, leaf), '' FROM leaves l
      UNION ALL
      SELECT f.tree, f.pos, f.leaf, CASE WHEN f.here >= 0 AND f.level = f.levels THEN 0 ELSE f.level + 1 END,
             CASE WHEN f.here >= 0 AND f.level = f.levels THEN -1 ELSE f.here END,
             CASE WHEN f.here >= 0 AND f.level = f.levels THEN f.tree ELSE f.place // 2 END, f.levels, f.upper,
             CASE WHEN f.here >= 0 AND f.level = f.levels THEN f.acc
                  WHEN f.place % 2 = 0 THEN sha256(f.acc || COALESCE(n.d, '')) ELSE sha256(n.d || f.acc) END,
             f.proof || COALESCE(n.d, '')
      FROM folds f LEFT JOIN nodes n ON n.tree = f.here AND n.level = f.level AND n.pos = f.place + 1 - 2 * (f.place % 2)
           AND NOT (f.here >= 0 AND f.level = f.levels)
      WHERE f.here >= 0 OR f.level < f.upper)
    SELECT l.doc_id, l.leaf, s.d AS subroot, h.d AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = h.d AS verified
    FROM leaves l JOIN folds f ON f.tree = l.tree AND f.pos = l.pos AND f.here = -1 AND f.level = f.upper
    JOIN subs s ON s.pos = l.tree JOIN high h ON h.level = h.height"""


def spelling(every: int = 199, least: int = 6, often: int = 5, times: int = 5) -> str:
    """Words at one edit share what is left when one of them, or both at the same place, loses a code point."""
    return f"""
    WITH RECURSIVE {_CRC},
    runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text,
               '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents) WHERE length(run) >= {least} GROUP BY ALL),
    hashed AS (SELECT run, k, {_crc32("COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, t),
    kept AS (SELECT CASE WHEN h % {every} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
    w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM kept WHERE length(word) >= {least} GROUP BY word HAVING sum(k) >= {often}),
    cuts AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
    pairs AS (SELECT a.word, b.word AS near, b.n AS n_of FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM cuts a JOIN w b ON a.rest = b.word
              UNION SELECT b.word, a.word, a.n FROM cuts a JOIN w b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(n_of) AS m FROM pairs GROUP BY word),
    formed AS (SELECT p.word, min(near) AS form, any_value(m) AS form_n FROM pairs p JOIN best b ON b.word = p.word AND b.m = p.n_of
               JOIN w ON w.word = p.word WHERE m >= {times} * w.n GROUP BY p.word),
    way(word, root) AS (SELECT word, word FROM w UNION ALL SELECT way.word, form FROM way JOIN formed ON formed.word = way.root),
    roots AS (SELECT way.word, way.root FROM way ANTI JOIN formed ON formed.word = way.root)
    SELECT w.word, form, root, w.n, COALESCE(n_near, 0) AS n_near, form_n FROM w JOIN roots ON roots.word = w.word
    LEFT JOIN best ON best.word = w.word LEFT JOIN formed ON formed.word = w.word"""
