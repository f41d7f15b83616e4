"""Merkle manifests, spelling variants and token files, beside plain Python versions."""

from __future__ import annotations

import glob
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.orc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refledger.llm import merkle, queries, spelling, token_files
from refledger.sources.workspace import fresh_path
from tests.compare import compare, duck
from tests.llm import helpers

SF = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CLASHING = ("leaf", "root", "tree", "at", "word", "n", "key", "part", "ids", "__row", "a.b")


def documents(spark, rows):
    """Rows (doc_id, lang, text, n_chars) with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long").withColumn("source", F.lit("s"))
    return df.withColumns({c: F.lit("other") for c in CLASHING})


# --- manifests ---------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    values = dict(zip(("doc_id", "lang", "text", "n_chars"), row), source="s")
    if values["n_chars"] is not None:
        values["n_chars"] += more
    return sha("".join("-" if values[f] is None else f"{len(str(values[f]).encode())}:{values[f]}" for f in FIELDS))


def climb(level, run):
    """The root, and per leaf the siblings to its left and right on every level."""
    place = list(range(len(level)))
    proofs = [[] for _ in level]
    while len(level) > 1:
        for i, p in enumerate(place):
            first = p - p % run
            proofs[i].append((level[first:p], level[p + 1 : first + run]))
            place[i] = p // run
        level = [sha("".join(level[i : i + run])) for i in range(0, len(level), run)]
    return level[0], proofs


def manifest_brute(rows, run):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = (own, *climb([leaf_of(r) for r in own], run))
    root, upper = climb([trees[x][1] for x in langs], run)
    out = []
    for lang, way in zip(langs, upper):
        own, sub, proofs = trees[lang]
        for r, proof in zip(own, proofs):
            proof = proof + way
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf_of(r, 1 if tampered else 0)
            for left, right in proof:
                acc = sha("".join(left) + acc + "".join(right))
            told = sha("".join("".join(left) + "".join(right) for left, right in proof))
            out.append((r[0], leaf_of(r), sub, root, told, acc))
    return Counter(out)


def manifest_of(docs, run):
    changed = merkle.record_digest([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed)
    df = merkle.manifest(docs, FIELDS, also={"tampered": tampered}, run=run)
    proof = F.col("proof")
    return df.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(proof), merkle.fold(F.coalesce("tampered", "leaf"), proof))


@pytest.mark.parametrize("run", [2, 3])
def test_manifest(spark, run):
    rng = random.Random(run)
    rows = [(i, "big", f"text {rng.random()}", i) for i in range(700)]
    rows += [(i, rng.choice([None, "é", "z", ""]), rng.choice([None, "", "t"]), rng.choice([None, 5])) for i in range(700, 760)]
    rows += [(None, "big", "same", 1)] * 3 + [(7, "big", "x" * 200_000, 1)] * 2 + [(1, "lone", "y", None)]
    got = Counter(tuple(r) for r in manifest_of(documents(spark, rows), run).collect())
    assert got == manifest_brute(rows, run)


def test_one_leaf_and_none(spark):
    assert manifest_of(documents(spark, []), 2).count() == 0
    (row,) = manifest_of(documents(spark, [(3, None, None, None)]), 2).collect()
    assert row[1] == row[2] == row[3] == row[5] == leaf_of((3, None, None, None)) and row[4] == sha("")


def test_proofs_show_every_change(spark):
    got = queries.QUERIES["op11_merkle"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0 or r.n_chars is None)


@pytest.mark.parametrize("name", ["op11_merkle", "op12_spelling"])
def test_beside_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name])
    assert ok, note


# --- spelling ----------------------------------------------------------------------------------------


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_brute(rows, every, least, often):
    n = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def one_edit(a, b):
    return a != b and abs(len(a) - len(b)) < 2 and helpers.levenshtein(a, b) == 1


def variants_brute(n, times):
    forms, out = {}, {}
    for w in n:
        close = sorted((-n[x], x) for x in n if one_edit(w, x))
        forms[w] = close[0][1] if close and -close[0][0] >= times * n[w] else None
        out[w] = len(close)

    def root(w):
        return root(forms[w]) if forms[w] else w

    return Counter((w, forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] else None) for w in n)


def test_vocabulary(spark):
    rng = random.Random(3)
    parts = ["Colour", "COLOUR", "Étranger", "étranger", "naïveté×÷", "abc", "snow中man\U0001f600figures", "x-ray", "letters9letters"]
    rows = [(rng.choice([None, 1, 2, 3, i]), rng.choice([None, "", " ".join(rng.choices(parts, k=12))])) for i in range(300)]
    rows += [(5, "z" * 3000), (5, "word " * 400_000), (6, "longrun" * 200_000 + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in CLASHING})
    for every, least, often in ((199, 6, 5), (3, 6, 2), (2, 1, 1)):
        got = spelling.vocabulary(df, every=every, least=least, often=often).collect()
        assert {r.word: r.n for r in got} == words_brute(rows, every, least, often)


@pytest.mark.parametrize("symbols", [1 << 18, 60])
def test_variants(spark, symbols):
    """With small indexes most halves fill one alone, so that words are dealt to blocks."""
    rng = random.Random(symbols)
    n = {"".join(rng.choices("abéÿ", k=rng.randint(2, 7))): rng.choice([1, 2, 5, 10, 26, 26, 140, 700]) for _ in range(400)}
    n |= {"q" * 300: 3, "q" * 299 + "r": 30, "r" + "q" * 300: 150, "aaaaaa": 9, "aaaaaaa": 45}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = Counter(tuple(r) for r in spelling.variants(df, symbols=symbols).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == variants_brute(n, 5)


def test_index_beside_all_pairs():
    rng = random.Random(9)
    for _ in range(20):
        words = list({"".join(rng.choices("abé", k=rng.randint(2, 9))) for _ in range(120)})
        asked = words + ["zzzz", "abz中"]
        exact = np.array([len(w) // 2 for w in asked])
        a, b = spelling.near(spelling.Index(words), asked, exact, at_once=rng.choice([5, 1 << 20]))
        due = {(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if one_edit(x, y) and y.startswith(x[: len(x) // 2])}
        assert set(zip(a.tolist(), b.tolist())) == due and len(a) == len(due)


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    none = spark.createDataFrame([(1, None), (2, ""), (3, "short 1234567")], "doc_id long, text string")
    assert spelling.vocabulary(none).count() == 0


# --- token files -------------------------------------------------------------------------------------


def tokens_brute(rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for k, t in rows)


def rows_of_files(spark, rows, **options):
    path = fresh_path(spark, "test-ids")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in CLASHING})
    token_files.write_ids(df, path, **options)
    return path, token_files.read_ids(spark, path).withColumn("crc", token_files.ids_crc32(F.col("ids"))).collect()


def test_token_files(spark):
    rows = [(i * 37 % 500, f"Text {i} with é中 and 12345" * (i % 9)) for i in range(500)]
    rows += [(None, "a"), (None, None), (600, ""), (601, "x<|endoftext|> y"), (602, "z" * 50_000), (603, "long words \n\n and lines " * 20_000)]
    rows += [(44, "again"), (44, "again"), (44, "other")]
    _, got = rows_of_files(spark, rows, piece=1000)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == tokens_brute(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.crc == zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in r.ids))
        at += r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_no_documents(spark):
    assert rows_of_files(spark, [])[1] == []


def test_stripes_and_lookups(spark):
    rows = [(i, " ".join(str(hash((i, j))) for j in range(40))) for i in range(3000)]
    path, got = rows_of_files(spark, rows, stripe=64 << 10, stride=1000, block=16 << 10)
    assert len(got) == len(rows)
    files = glob.glob(f"{path.removeprefix('file:')}/part-*")
    assert sum(pyarrow.orc.ORCFile(f).nstripes for f in files) > len(files)
    # Each part's ids follow those of the part before, in the file as in the result.
    for f in files:
        held = pyarrow.orc.ORCFile(f).read(["doc_id", "at", "n_tokens"]).to_pydict()
        assert held["doc_id"] == sorted(held["doc_id"]) and held["at"] == [sum(held["n_tokens"][:i]) for i in range(len(held["at"]))]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        parted = spark.read.orc(path)
        assert parted.rdd.getNumPartitions() > len(files) and parted.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lookup_reads_few_rows(spark):
    """Even ids only: an odd one lies within the ranges, so nothing but the Bloom filter rules it out."""
    path = fresh_path(spark, "test-ids")
    df = spark.range(0, 100_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    token_files.write_ids(df.coalesce(1), path, stride=1000)

    def scanned(keys):
        found = token_files.find_ids(spark, path, keys)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return len(rows), sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))

    n, read = scanned([4242])
    assert n == 1 and read <= 4000
    n, read = scanned([4243])
    assert n == 0 and read <= 4000


def test_same_rows_as_the_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    due, at = [], 0
    for (k, ids), _ in sorted(tokens_brute(docs.items()).items()):
        due.append((k, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.QUERIES["op13_token_orc"](spark, SF).collect()) == due
