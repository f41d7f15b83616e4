"""Spans of request lines beside a plain version, on short lines and on one of a megabyte."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from refledger.operators import mining
from refledger.operators.stage import computed

WORDS = ("20mg", "444.4 MG/GM", "repriced", "price not changed", "未調價", "調價", "的", "2024-02-29", "2024-02-31", "113/2/29", "9/1", "today", "plain", "\U0001f600", "x", "  ")
NAMES = "id long, line string, today string, announced string"


def line_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice((" ", "", " ")) for _ in range(n))


def resolved(hits):
    """Accepted hits, by a mark for every character that one of them holds."""
    held, kept = set(), []
    for h in hits:
        if not any(c in held for c in range(h.start, h.end)):
            held.update(range(h.start, h.end))
            kept.append(h)
    return sorted(kept, key=lambda h: h.start)


def check(line, hits, mined):
    assert all(line[h.start : h.end] == h.raw for h in hits)
    for rank in range(len(mining.DETECTORS)):
        own = [h for h in hits if h.rank == rank]
        assert all(a.end <= b.start for a, b in zip(own, own[1:]))
    kept = resolved([h for h in hits if h.value is not None])
    assert [tuple(s) for s in mined.spans] == [tuple(h) for h in kept]
    rest, at = [], 0
    for h in kept:
        rest.append(line[at : h.start])
        at = h.end
    text = " ".join([*rest, line[at:]]) if kept else line
    assert mined.search_text.split() == text.split() and "  " not in mined.search_text


def both(spark, lines):
    df = spark.createDataFrame([(i, x, "2024-05-05", "2024-06-06") for i, x in enumerate(lines)], NAMES)
    hits = mining.detect(df, "line", "today", "announced").select("id", "hits")
    return hits.join(mining.mine(df, "line", "today", "announced"), "id").collect()


def test_lines_beside_a_plain_version(spark):
    rng = random.Random(4)
    lines = [line_of(rng, n) for n in [0, 1, 2, 3, 5, 8, 13, 40, 200] for _ in range(20)] + ["", " "]
    rows = both(spark, lines)
    assert len(rows) == len(lines) and sum(len(r.spans) for r in rows) > 1000
    for r in rows:
        check(r.line, r.hits, r)


def test_a_line_of_a_megabyte(spark):
    line = line_of(random.Random(5), 140_000)
    assert len(line.encode()) > 1_000_000
    start = time.time()
    (row,) = both(spark, [line])
    seconds = time.time() - start
    assert len(row.hits) > 50_000 and seconds < 120
    check(row.line, row.hits, row)


def test_sums_before(spark):
    rng = random.Random(6)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in [*range(20), 99, 1000, 4097]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for r in df.select("x", mining.sums_before(F.col("x")).alias("got")).collect():
        assert r.got == [sum(r.x[:i]) for i in range(len(r.x))]


def test_any_ranks(spark):
    """Hits as any detectors may give them: of one rank they never overlap, of two they may in every way."""
    rng = random.Random(7)
    rows = []
    for n in range(60):
        hits = []
        for rank in range(9):
            at = 0
            while rng.random() < 0.7 and at < 60:
                start = at + rng.randint(0, 9)
                at = start + rng.randint(1, 12)
                if at <= 80:
                    hits.append((start, at, rank))
        rows.append((n, "x" * 80, hits))
    df = spark.createDataFrame(rows, "id long, text string, hits array<struct<start:int,end:int,rank:int>>")
    got = computed(df).select("hits", mining.resolve_spans(F.col("hits"), F.col("text")).alias("spans")).collect()
    assert all(r.spans == resolved(r.hits) for r in got)
