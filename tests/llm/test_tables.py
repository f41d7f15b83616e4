"""URL trust, nearest neighbours, sharding, mixing, and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from refledger.llm import ann, mixing, queries, shards, url_graph
from tests.compare import compare, duck
from tests.llm import helpers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


# --- URL trust ---------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "x://h?q", "x://h#f/", "a://b://c/d", "http://É.net/P"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(url_graph.host_of(F.col("url")), url_graph.path_of(F.col("url"))).collect()]
    assert got == [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/x"), ("h", ""), ("h", ""), ("b:", "//c/d"), ("É.net", "/P")]


def rank_brute(edges, seeds, damping, rounds):
    total = sum(seeds.values())
    start = {h: w / total for h, w in seeds.items()}
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    state = dict(start)
    for _ in range(rounds):
        new = {h: (1 - damping) * w for h, w in start.items()}
        for s, d, n in edges:
            new[d] = new.get(d, 0) + damping * state.get(s, 0) * n / out[s]
        state = new
    total = sum(state.values())
    return {h: w / total for h, w in state.items()}


def test_propagation(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 4.0), ("x", "d", 1.0)]
    df = spark.createDataFrame(edges, "src string, dst string, links double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.5, 0.0), ("c", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: r for r in url_graph.propagate(df, seeds, rounds=7, every=3).collect()}
    spread = {r.host: r for r in url_graph.propagate(df, seeds, rounds=7, every=3, few=0).collect()}
    assert {h: (round(r.trust, 12), round(r.distrust, 12)) for h, r in got.items()} == {h: (round(r.trust, 12), round(r.distrust, 12)) for h, r in spread.items()}
    trust = rank_brute(edges, {"a": 1.0, "d": 0.5}, 0.85, 7)
    distrust = rank_brute([(d, s, n) for s, d, n in edges], {"c": 1.0}, 0.85, 7)
    for h in "abcdx":
        r = got.get(h)
        assert (r.trust if r else 0) == pytest.approx(trust.get(h, 0)) and (r.distrust if r else 0) == pytest.approx(distrust.get(h, 0))


def solved(edges, start, damping=0.85):
    """The fixed point itself, by solving the linear equations."""
    names = sorted({h for s, d, _ in edges for h in (s, d)} | set(start))
    at = {h: i for i, h in enumerate(names)}
    m, out = np.zeros((len(names), len(names))), {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    for s, d, n in edges:
        m[at[d], at[s]] += n / out[s]
    b = np.array([start.get(h, 0.0) for h in names])
    x = np.linalg.solve(np.eye(len(names)) - damping * m, (1 - damping) * b / b.sum())
    return dict(zip(names, x / x.sum()))


CHAIN = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(15)]
FARM = [(f"f{i}", "money", 1.0) for i in range(30)] + [("money", f"f{i}", 1.0) for i in range(30)]


@pytest.mark.parametrize("edges, good, bad", [([("a", "b", 1.0), ("b", "a", 1.0)], "a", "b"), (CHAIN, "h0", "h15"), (FARM + CHAIN, "money", "h14")])
def test_propagation_ends_at_the_fixed_point(spark, edges, good, bad):
    """Two hosts linked both ways, hosts far beyond ten links from a seed, and a farm, against the solved equations."""
    df = spark.createDataFrame(edges, "src string, dst string, links double")
    seeds = spark.createDataFrame([(good, 1.0, 0.0), (bad, 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: r for r in url_graph.propagate(df, seeds).collect()}
    trust, distrust = solved(edges, {good: 1.0}), solved([(d, s, n) for s, d, n in edges], {bad: 1.0})
    assert all(abs((got[h].trust if h in got else 0) - x) < 1e-6 for h, x in trust.items())
    assert all(abs((got[h].distrust if h in got else 0) - x) < 1e-6 for h, x in distrust.items())


def test_pages(spark):
    link = lambda h: f'<a href="https://{h}/x">y</a>'
    rows = [
        (1, "http://bad.net/x", ""), (2, "http://bad.net/y", ""), (3, "http://spam.com/a", link("bad.net") * 3),
        (4, "http://spam.com/b", link("BAD.net")), (5, "http://ok.org/fr/a", link("fine.com")), (6, "http://fine.com/", ""),
        (7, None, None), (8, "nothing", "<a href='/rel'>"), (9, "http://sub.example.net/en/q", ""), (9, "http://sub.example.net/en/q", ""),
        (10, "http://alone.com", link("nowhere.info")), (None, "http://x.example.com/de/1", ""),
    ]
    pages = pages_of(spark, rows).withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    found = url_graph.judge(pages, url_graph.rules_of(spark, queries.URL_RULES)).collect()
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found), key=str)
    assert got == sorted(
        [
            (1, "bad.net", "/x", "net/", "block"), (2, "bad.net", "/y", "net/", "block"), (3, "spam.com", "/a", None, "block"),
            (4, "spam.com", "/b", None, "block"), (5, "ok.org", "/fr/a", "org/fr/", "allow"), (6, "fine.com", "/", None, "allow"),
            (7, "", "", None, "allow"), (8, "", "", None, "allow"),
            (9, "sub.example.net", "/en/q", "example.net/en/", "allow"), (9, "sub.example.net", "/en/q", "example.net/en/", "allow"),
            (10, "alone.com", "", None, "allow"), (None, "x.example.com", "/de/1", "example.com/de/", "block"),
        ], key=str,
    )
    assert url_graph.judge(pages.limit(0), url_graph.rules_of(spark, queries.URL_RULES)).count() == 0


# --- Nearest neighbours --------------------------------------------------------------------------------


def nearest_brute(ids, vectors, q, k):
    i = ids.index(q)
    distance = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((ids, distance)) if ids[j] != q][:k]
    return [(ids[j], distance[j]) for j in order]


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = queries.QUERIES["op7_multi_index"](spark, SF).collect()
    own = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, vectors = [i for i, _ in own], np.array([v for _, v in own], dtype=float)
    hits = 0
    asked = [i for i in ids if i % 100 == 0]
    for q in asked:
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        due = nearest_brute(ids, vectors, q, 10)
        assert [r for r, *_ in got] == list(range(1, 11))
        hits += len({i for _, i, _ in got} & {i for i, _ in due})
        for _, i, s in got:
            assert s == pytest.approx(np.sqrt(((vectors[ids.index(i)] - vectors[ids.index(q)]) ** 2).sum()), abs=1e-12)
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, [float(i), 1.0, -float(i), 2.0]) for i in range(1, 30)] + [(100 + i, same) for i in range(12)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 2.0, 3.0]), (203, [nan, 1.0, 1.0, 1.0]), (204, [inf, 1.0, 1.0, 1.0])]
    rows += [(205, [1.0, 2.0]), (None, same), (100, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    model = ann.fit(df.where(ann.usable(F.col("embedding"))), "vec_id", "embedding")
    found = ann.search(df, df.where("vec_id IN (100, 5, 200, 201, 205)"), model, k=10).collect()
    assert {r.query_id for r in found} == {100, 5}
    # Ties go to the smaller id; rows of the query's own id are no candidates.
    top = sorted((r.rank, r.vec_id) for r in found if r.query_id == 100 and r.score == 0)
    assert [i for _, i in top[:10]][:5] == [101, 102, 103, 104, 105]
    few = df.where("vec_id < 4")
    assert ann.search(few, few.where("vec_id = 1"), ann.fit(few, "vec_id", "embedding")).count() == 2
    none = df.limit(0)
    assert ann.fit(none, "vec_id", "embedding") is None and ann.search(none, none, None).count() == 0


def test_probing_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 1 << 16, (400, 4)).astype(np.uint16)
    codes[:50] = codes[0] ^ (1 << r.integers(0, 16, (50, 4))).astype(np.uint16)
    tables = ann.Tables(codes)
    for radius in (0, 3, 8, 20, 70):
        due = np.flatnonzero(ann.hamming(codes, codes[0]) <= radius)
        assert sorted(tables.within(codes[0], radius)) == due.tolist()


# --- Sharding ------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(5, "text 5"), (None, None), (None, "x"), (7, "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("size", F.lit("clash"))
    even = {s: 1.0 for s in range(6)}
    found = shards.assign(df, even, grown=even | {6: 1.0}).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 6) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id == 5}) == 1 and len({r.shard for r in found if r.doc_id is None}) == 1
    assert {r.size for r in found if r.doc_id is None} == {8, 9}
    moved = sum(r.grown_shard == 6 for r in found) / len(found)
    assert 0.08 < moved < 0.22
    assert shards.assign(df.limit(0), even).count() == 0


def test_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r.shard: r["count"] for r in shards.assign(df, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()}
    assert 0.7 < counts[1] / 4000 < 0.8
    with pytest.raises(ValueError):
        shards.assign(df, {0: 0.0})


# --- Mixing --------------------------------------------------------------------------------------------


def test_targets():
    sizes = {"b": 100, "a": 50, None: 10, "c": 40}
    got = mixing.targets(sizes, mixing.cyclic((3, 1, 2)), 300, 2)
    # a, b, c, null weigh 3, 1, 2, 3: a, c and null are full, b takes the rest.
    assert got == {"a": 100.0, "c": 80.0, None: 20.0, "b": 100.0}
    assert mixing.targets({"a": 10}, mixing.cyclic((1,)), 100, 2) == {"a": 20.0}
    assert mixing.targets({}, mixing.cyclic((1,)), 0, 2) == {}


def test_mix(spark):
    rows = [(i, "w " * (i % 37 + 2 * (i % 4)), f"s{i % 4}" if i % 4 else None) for i in range(800)] + [(3, "w w", "s1"), (3, "w w", "s1"), (None, None, "s2")]
    df = spark.createDataFrame(rows, SCHEMA + ", source string").withColumn("size", F.lit("clash")).withColumn("row", F.lit("clash"))
    m = mixing.mix(df, mixing.cyclic((3, 1, 2)), block=8, slots=64)
    found = mixing.mixed_documents(m).collect()
    assert len(found) == len(rows)
    again = mixing.mixed_documents(mixing.mix(df.repartition(5), mixing.cyclic((3, 1, 2)), block=8, slots=64)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    sums = {}
    for r in found:
        assert 0 <= r.taken <= 2 * r["size"]
        sums.setdefault((r.source_size, r.target), [0, 0])
        sums[r.source_size, r.target][0] += r["size"]
        sums[r.source_size, r.target][1] += r.taken
    for (size, target), (seen, taken) in sums.items():
        assert seen == size and abs(taken - target) <= max(0.03 * target, 16)
    # Slots of the output hold whole blocks, each of them at most twice.
    placed = m.placed().groupBy("shard", "slot").agg(F.sum("words").alias("n")).collect()
    assert max(r.n for r in placed) == 8 and sum(r.n for r in placed) == sum(t for _, t in sums.values())
    assert m.slots.groupBy("src", "block").count().agg(F.max("count")).first()[0] <= 2


def shares_brute(rows, weights, block):
    """Sizes, targets, blocks and slots per source by plain loops; no target is missed by more than half a block."""
    sums = {}
    for _, text, src in rows:
        sums[src] = sums.get(src, 0) + len((text or "").split())
    given = mixing.targets(sums, mixing.cyclic(weights), 1.5 * sum(sums.values()), 2)
    shares = [mixing.share_of(s, sums[s], given[s], block, 2) for s in given]
    assert all(abs(s.slots * s.size / max(1, s.blocks) - s.target) <= s.size / max(1, s.blocks) / 2 + 1e-9 for s in shares)
    return shares


def test_mix_meets_small_targets(spark):
    """Sources of a word, of a part of a block, and of a few blocks: each within a block of its target."""
    sizes = {"a": 1, "b": 20, "c": 130, "d": 300, "e": 5000, "f": 0, None: 50}
    rows = [(i, "w " * n, s) for i, (s, total) in enumerate(sizes.items()) for n in ([total] if total < 200 else [total // 4] * 4)]
    df = spark.createDataFrame(rows, SCHEMA + ", source string")
    shares = shares_brute(rows, (3, 1, 2), 128)
    m = mixing.mix(df, mixing.cyclic((3, 1, 2)))
    assert m.plan.shares == tuple(shares)
    found = mixing.mixed_documents(m).collect()
    by_size = {s.size: [s, 0] for s in shares}
    for r in found:
        assert r.taken <= 2 * r["size"] and r.target == by_size[r.source_size][0].target
        by_size[r.source_size][1] += r.taken
    for size, (share, taken) in by_size.items():
        assert abs(taken - share.target) <= -(-size // share.blocks) if size else taken == 0
    assert {20: 40, 130: 260, 1: 2}.items() <= {size: taken for size, (_, taken) in by_size.items()}.items()
    # The whole way again in plain Python, from the slots' blocks: words at a block's places, as often as it is placed.
    times = {}
    for r in m.slots.collect():
        times[r.src, r.block] = times.get((r.src, r.block), 0) + 1
    for r in m.rows.collect():
        share, own = shares[r.src], 0
        low, more = divmod(share.size, share.blocks) if share.blocks else (0, 0)
        edges = [k * low + min(k, more) for k in range(share.blocks + 1)]
        for k in range(share.blocks):
            own += times.get((r.src, k), 0) * max(0, min(edges[k + 1], r.start + r["size"]) - max(edges[k], r.start))
        assert own == {t.row: t.taken for t in m.taken().collect()}.get(r.row, 0)
    # The turns of a source run without gaps, and shards differ by one slot at most.
    turns = {}
    for r in m.slots.collect():
        turns.setdefault(r.src, []).append(r.turn)
    assert all(sorted(t) == list(range(shares[src].slots)) for src, t in turns.items())
    many = mixing.mix(df, mixing.cyclic((3, 1, 2)), slots=16)
    per = [sorted(x.slot for x in many.slots.where(F.col("shard") == i).collect()) for i in range(many.plan.shards)]
    assert len(per) > 5 and all(p == list(range(len(p))) for p in per) and max(map(len, per)) - min(map(len, per)) <= 1


def test_mix_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 61), f"host{i % 1000:04d}") for i in range(3000)]
    m = mixing.mix(spark.createDataFrame(rows, SCHEMA + ", source string"), mixing.cyclic((3, 1, 2)))
    found = m.rows.join(m.taken(), "row", "left").groupBy("src").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.first("source_size").alias("n")).collect()
    assert len(found) == 1000
    assert all(abs((r.t or 0) - r.target) <= -(-r.n // m.plan.shares[r.src].blocks) for r in found)


def test_mix_of_one_key(spark, monkeypatch):
    """One key and text with most of the rows is counted, not ordered, and unfolded in runs."""
    monkeypatch.setattr(mixing, "RUN", 64)
    rows = [(7, "a b c", "s")] * 1000 + [(i, "w " * (i % 9), "s") for i in range(300)]
    found = mixing.mixed_documents(mixing.mix(spark.createDataFrame(rows, SCHEMA + ", source string"), mixing.cyclic((1,)), block=16)).collect()
    assert len(found) == 1300 and all(r.taken <= 2 * r["size"] for r in found)
    assert abs(sum(r.taken for r in found) - found[0].target) <= 16


def test_permutation(spark):
    p = mixing.Plan((mixing.Share("a", 0, 1.0, 700, 0), mixing.Share("b", 0, 1.0, 5, 0)), 1)
    rows = mixing.permutation(p.sources(spark), p).collect()
    for src, n in ((0, 700), (1, 5)):
        own = [(r.block, r.place) for r in rows if r.src == src]
        assert sorted(b for b, _ in own) == sorted(q for _, q in own) == list(range(n))
    assert sum(r.block == r.place for r in rows) < 50


def test_mix_sends_no_unfolded_rows_to_the_driver(spark):
    """Slots and blocks come from a row a source, and pieces from a row a document, which is all that Spark knows of their number."""
    rows = [(i, "w " * 5_000, "s") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA + ", source string")
    m = mixing.mix(df, mixing.cyclic((1,)), block=8, slots=64)
    for found in (m.slots, m.taken(), m.placed(), mixing.mixed_documents(m)):
        found.write.format("noop").mode("overwrite").save()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, plan


def test_repeated_documents_send_no_unfolded_rows_to_the_driver(spark):
    df = spark.createDataFrame([(i, "w " * 5_000, "s") for i in range(4)], SCHEMA + ", source string")
    found = mixing.repeated(df, mixing.mix(df, mixing.cyclic((1,)), block=8, slots=64))
    # How often each text appears is all that may be broadcast, and that is a row a text.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") == 5, plan
    assert sorted({r.doc_id for r in found.collect()}) == [0, 1, 2, 3]


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA + ", source string")
    assert mixing.mixed_documents(mixing.mix(df, mixing.cyclic((1,)))).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], SCHEMA + ", source string")
    assert [r.taken for r in mixing.mixed_documents(mixing.mix(blank, mixing.cyclic((1,)))).collect()] == [0, 0]


# --- Pipeline --------------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        docs = corpus_pipeline.cut(out, name)
        kept[name] = docs.collect()
    near = kept["near_duplicates"]
    sets = [helpers.shingles(r.text, 5) for r in near]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    clean = kept["decontamination"]
    leaked = {r.doc_id for r in near if any(b in " ".join(r.text.lower().split()) for b in bench)}
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == leaked
    assert {r.doc_id for r in kept["mixing"]} <= {r.doc_id for r in clean}
    last = kept["sharding"]
    assert len(last) == len(kept["mixing"]) and all(0 <= r.shard < 24 for r in last)


@pytest.mark.parametrize("edge", ["empty", "odd"])
def test_pipeline_edges(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if edge == "empty":
        rows = docs.limit(0)
    else:
        odd = [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (None, "some plain words here", "en", None, 21)]
        rows = docs.limit(30).unionByName(spark.createDataFrame(odd, docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.cut(stage(spark, rows, SF), "edge")
    assert (rows.count() == 0) == (edge == "empty")


def test_pipeline_keeps_other_columns(spark):
    """Columns with names of the stages' own, with dots and of types without order come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    names = ["size", "LAW", "shard", "slot", "a.b", "__number", "__text", "__place", "__times", "__copy", "__language", "__row", "text_crc32"]
    odd = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.substring("text", 1, 9)) for n in names})
    rows = odd.withColumn("map", F.create_map(F.lit("k"), F.substring("text", 1, 9)))
    first = rows
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns
        rows = corpus_pipeline.cut(out, name)
    assert rows.columns == first.columns + ["_size", "_shard", "_slot"]
    found = rows.collect()
    assert found and all(r[n] == f"{n}:" + r.text[:9] for r in found for n in names) and all(r.map == {"k": r.text[:9]} for r in found)
    assert all(0 <= r["_shard"] < 24 for r in found)


def test_ids_do_not_stand_for_documents(spark):
    """Rows of a shared id stay or go by their own texts, and a leak needs no id to go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    plain = lambda name: " ".join(f"{name}{i}" for i in range(60))
    row = lambda i, text: (i, text, "en", "src0", len(text))
    rows = [row(1, plain("a")), row(2, plain("b")), row(2, plain("c")), row(2, plain("a")), row(2, plain("c")), row(None, plain("d"))]
    rows += [row(None, plain("d")), row(None, plain("e")), row(None, plain("b") + " more"), row(2, plain("f") + " " + leak), row(None, plain("g") + " " + leak)]
    rows = spark.createDataFrame(rows, docs.schema)
    near = corpus_pipeline.cut(corpus_pipeline.drop_near_duplicates(spark, rows, SF), "near")
    kept = [(r.doc_id, r.text.split()[0][0]) for r in near.collect()]
    assert sorted(x for _, x in kept) == list("abcdefg")
    assert {(1, "a"), (2, "c"), (None, "d"), (None, "e"), (2, "f"), (None, "g")} <= set(kept)
    again = corpus_pipeline.drop_near_duplicates(spark, rows.repartition(7), SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, near.collect()))
    clean = corpus_pipeline.drop_benchmark_leaks(spark, near, SF)
    assert clean.columns == docs.columns
    assert sorted(r.text[0] for r in clean.collect()) == list("abcde")


# --- Registered queries ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name])
    assert ok, note
