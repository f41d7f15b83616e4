"""Language, near duplicates, decontamination, token counts, repeats, lines: against brute force, and on edge cases."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refledger.llm import decontaminate, language, line_dedup, near_dup, repeats, token_count
from tests.llm import helpers

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def with_clashes(df):
    """Columns named like those that the operators use within."""
    for name in ("id", "doc", "row", "h", "n", "s", "e", "key", "line", "label", "node", "found", "bands", "size", "place"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# --- Language -------------------------------------------------------------------------------------


def test_language_on_held_out(documents):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = language.fit(documents.where(~held))
    rows = documents.where(held).select("lang", language.identify(F.col("text"), model).alias("f")).collect()
    assert sum(r.lang == r.f.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.f.score <= 1 for r in rows)


def test_language_edges(spark, documents):
    model = language.fit(documents)
    odd = docs_of(spark, [*helpers.EDGES, "12 34 !"])
    found = {r.doc_id: r.f for r in with_clashes(odd).select("doc_id", language.identify(F.col("text"), model).alias("f")).collect()}
    for i in (0, 1, 2, 8):
        assert (found[i].lang, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert all(found[i].lang in model.languages for i in (3, 4, 5, 6, 7))
    kept = language.drop_rejected(with_clashes(odd), model)
    assert kept.columns == with_clashes(odd).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, f in found.items() if not f.rejected}


def test_language_of_long_texts_only(spark, documents):
    """A language of which every labelled text is long is learned, and from all of its sampled texts."""
    rows = documents.where("lang IN ('en', 'de')").select("doc_id", "text", "lang")
    once = {r.lang: r.t for r in rows.groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).collect()}
    long = F.when(F.col("lang") == "de", F.concat(F.repeat(F.lit("0" * 99 + " "), 300), F.repeat(F.concat("text", F.lit(" ")), 60))).otherwise(F.col("text"))
    model = language.fit(rows.withColumn("text", long))
    assert set(model.languages) == {"en", "de"}
    compressors = language._compressors(model)
    assert {g: language.judge(t[-4000:], model, compressors)[0] for g, t in once.items()} == {"en": "en", "de": "de"}


def test_dictionaries_are_equal_shares():
    texts = [bytes([97 + i]) * n for i, n in enumerate((50_000, 10, 30_000, 40_000))]
    made = language.shares(texts, 3_000)
    held = [made.count(bytes([97 + i])) for i in range(4)]
    assert len(made) <= 3_000 and held[1] == 10 and min(held[0], *held[2:]) > 980 and max(held) - min(held[0], *held[2:]) <= 2
    assert language.shares([], 100) == b"" and language.shares([b"", b"ab"], 100) == b"ab"
    assert language.shares(["é".encode() * 50], 52).decode("utf8") == "é" * 25


def test_language_of_nothing(spark, documents):
    empty = documents.limit(0)
    model = language.fit(empty)
    assert model.languages == ()
    rows = documents.limit(3).select(language.identify(F.col("text"), model).alias("f")).collect()
    assert {r.f.lang for r in rows} == {"und"}
    assert empty.select(language.identify(F.col("text"), model).alias("f")).count() == 0
    # Null and wordless rows teach nothing.
    odd = spark.createDataFrame([(1, None, "xx"), (2, "...", "yy"), (3, "only some words", None)], "doc_id long, text string, lang string")
    assert language.fit(odd).languages == ()


# --- Near duplicates --------------------------------------------------------------------------------


def near_brute(rows, size, num, den):
    sets = {i: helpers.shingles(t, size) for i, t in rows}
    full = [i for i in sets if sets[i]]
    linked = [(a, b) for k, a in enumerate(full) for b in full[:k] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, helpers.classes(sets, linked)


def family(seed, n, size, edits):
    """Copies of one text with a few words changed each."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(size)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("busy,tile", [(32, 512), (3, 4)])
def test_near_duplicates(spark, busy, tile):
    texts = family(1, 60, 90, 6) + family(2, 8, 40, 2) + family(3, 20, 300, 30) + helpers.EDGES + ["Two  WORDS", "two\twords"]
    texts += texts[:5]
    rows = list(enumerate(texts))
    sizes, due = near_brute(rows, 3, 85, 100)
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found = near_dup.near_duplicates(df, shingle=3, num=85, den=100, busy=busy, tile=tile).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (sizes[i], due[i], due[i] == i) for i in due}


def test_near_duplicates_edges(spark):
    same = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, None)]
    found = near_dup.near_duplicates(spark.createDataFrame(same, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True), (None, 0, None, True), (2, 0, 2, True)], key=str
    )
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_is_corrected_for_collisions():
    sketcher = near_dup.Sketcher(64, 4, 2)
    r = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.9):
        a = r.integers(0, 1 << 63, 2000).astype(np.uint64)
        b = np.concatenate((a[: int(2000 * share)], r.integers(0, 1 << 63, 2000 - int(2000 * share)).astype(np.uint64)))
        true = share / (2 - share)
        x, y = (sketcher(v)[1].view(np.uint64) for v in (a, b))
        odd = x ^ y
        odd |= odd >> np.uint64(1)
        equal = 1 - np.bitwise_count(odd & np.uint64(0x5555555555555555)).sum() / 256
        assert abs((equal - 0.25) / 0.75 - true) < 0.15


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 4))
def test_shingles_are_those_of_the_words(text, size):
    text = text.encode("utf8", "replace").decode()
    assert len(near_dup.shingles_of(text, size)) == len(helpers.shingles(text, size))


def test_long_texts_are_read_in_segments(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)) + " " + "x" * 900
    whole = near_dup.words_of(text)
    monkeypatch.setattr(near_dup, "_SEGMENT", 256)
    assert (near_dup.words_of(text) == whole).all()


# --- Decontamination ----------------------------------------------------------------------------------

ITEMS = [
    (1, "A train leaves at 7 and travels 120 km to the coast in 3 hours. How fast does it go on its way there?"),
    (2, "Plain words without any slot stand here for a test of exact passages in documents of all kinds."),
    (3, None),
    (4, ""),
    (5, "tiny one"),
]


def leaks(spark, texts, items=ITEMS, **options):
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    found = decontaminate.find_leaks(with_clashes(docs_of(spark, texts)), bench, **options).collect()
    return {(r.doc_id, r.item_id): r for r in found}


@pytest.mark.parametrize("part_chars", [16_000_000, 60])
def test_leaks(spark, part_chars):
    again = "A train leaves at 9 and travels 250 km to the coast in 5 hours. How fast does it go on its way there?"
    texts = [
        "Some words before. " + ITEMS[0][1] + " Some words after it.",
        "intro " + again,
        "BEFORE IT " + ITEMS[1][1].upper().replace(" ", "  "),
        "Plain words without any slot, and then something else entirely that no item holds.",
        "a tiny one here",
        *helpers.EDGES,
    ]
    found = leaks(spark, texts, part_chars=part_chars)
    assert set(found) == {(0, 1), (1, 1), (2, 2), (4, 5)}
    assert found[0, 1].kind == "exact" and found[1, 1].kind == "reparameterised" and found[1, 1].changed == 3
    r = found[0, 1]
    assert texts[0][r.start : r.end].endswith(ITEMS[0][1][-30:]) and r.coverage > 0.9


def test_slots_must_be_filled_consistently(spark):
    item = "then Anna gives Berta 2 and Carla 3 while Doris gives Emma 4 and Fanny 5"
    texts = ["then Xena gives Yara 8 and Zoe 9 while Vera gives Wilma 6 and Ulla 7", "then Xena gives Xena 8 and Zoe 8 while Zoe gives Xena 8 and Ulla 7"]
    found = leaks(spark, texts, [(1, item)], literals=2)
    assert set(found) == {(0, 1)} and found[0, 1].changed == 10


def test_leaks_dense_in_slots(spark):
    """Few literal words in every window of eight, or in the whole item, under the parameters of the queries."""
    items = [
        (1, "then Anna gives Berta 2 and Carla 3 while Doris gives Emma 4 and Fanny 5"),
        (2, "What is 3 times 4?"),
        (3, "so 2 4 6 8 10 12 14 16 18 make one even row"),
        (4, "11 22 33 44 55 66 77 88 99"),
        (5, "take 1 2 3 4 from 5 6 7 8 giving 9"),
    ]
    texts = [
        "Once then Xena gives Yara 8 and Zoe 9 while Vera gives Wilma 6 and Ulla 7 again",
        "then Xena gives Xena 8 and Zoe 8 while Zoe gives Xena 8 and Ulla 7",
        "Tell me: what is 12 times 70?",
        "so 1 3 5 7 9 11 13 15 17 make one even row",
        "here are 11 22 33 44 55 66 77 88 99 and 21 32 43 54 65 76 87 98 19",
        "21 32 43 54 65 76 87 98 19",
        "take 9 8 7 6 from 5 4 3 2 giving 1",
        "1 2 3 4 " * 3000,
    ]
    found = leaks(spark, texts, items)
    assert set(found) == {(0, 1), (2, 2), (3, 3), (4, 4), (6, 5)}
    assert {k for k, r in found.items() if r.kind == "reparameterised"} == {(0, 1), (2, 2), (3, 3), (6, 5)}
    assert found[2, 2].changed == 2 and found[2, 2].coverage == 1.0
    assert found[3, 3].changed == 9 and found[3, 3].coverage == 1.0


def test_leaks_of_nothing(spark):
    assert leaks(spark, ["some text"], items=[]) == {}
    assert leaks(spark, []) == {}
    docs = with_clashes(docs_of(spark, ["a tiny one", "clean", None]))
    kept = decontaminate.drop_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2}


def test_items_of_the_benchmark_in_documents(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    due = {(r.doc_id, i) for r in documents.collect() for i, t in items.items() if t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(documents, bench).collect()} == due


# --- Token counts ----------------------------------------------------------------------------------------


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (200, 16)])
def test_token_counts(spark, documents, chunk, overlap):
    texts = [r.text for r in documents.limit(60).collect()] + helpers.EDGES
    texts += ["<|endoftext|>a <|endoftext|> b" * 90, " " * 900 + "x", "日本語 のテキスト " * 90, "a\u2003b\x1cc \n\n d" * 80, texts[0]]
    own = library()
    found = {r.doc_id: r for r in token_count.count_tokens(with_clashes(docs_of(spark, texts)), chunk=chunk, overlap=overlap).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def test_token_counts_of_nothing(spark):
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spliced_ids(spark):
    text = "Some words, and 12 numbers; " * 200
    rows = spark.createDataFrame([("h", text)], "h string, text string")
    spliced = token_count.splice(rows, token_count.vocabulary_path(), chunk=300, overlap=32, keep_ids=True).orderBy("no").collect()
    assert len(spliced) > 10
    assert [i for r in spliced for i in r.ids] == library().encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_is_the_library(text):
    text = text.encode("utf8", "replace").decode()
    assert token_count.encoder(token_count.vocabulary_path()).ids(text) == library().encode(text, add_special_tokens=False).ids


# --- Repeats -----------------------------------------------------------------------------------------------


def patched_texts(seed):
    r = random.Random(seed)
    rnd = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [rnd(r.choice([20, 40, 60, 100, 200])) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(r.randrange(5)):
            x = r.choice(passages)
            if r.random() < 0.3:
                k = r.randrange(len(x))
                x = x[:k] + "#" + x[k:]
            parts += [rnd(r.randrange(50)), x]
        texts.append("".join(parts))
    return texts + helpers.EDGES + ["ab" * 100, texts[3], "z" * 41]


@pytest.mark.parametrize("most,nested", [(20_000, False), (2, False), (20_000, True)])
def test_repeats(spark, most, nested):
    texts = patched_texts(5)
    found = repeats.without_repeats(with_clashes(docs_of(spark, texts)), least=40, window=20, most=most, nested=nested).collect()
    due = helpers.without_repeats(texts, 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == dict(enumerate(due))


def test_repeats_of_repeated_rows(spark):
    text = "".join(random.Random(1).choice("abc") for _ in range(90))
    rows = [(1, text), (1, text), (None, text), (2, "other"), (2, text[:50])]
    found = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), least=40, window=20).collect()
    due = helpers.without_repeats([t for _, t in rows], 40)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_removed, r.n_spans) for r in found), key=key) == sorted([(i, d[1], d[2]) for (i, _), d in zip(rows, due)], key=key)
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_hold_all_occurrences(spark):
    r = random.Random(2)
    rnd = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = rnd(60)
    texts = [rnd(30) + passage + rnd(30) for _ in range(5)]
    found = repeats.repeats(docs_of(spark, texts), least=40, window=20, nested=True).collect()
    groups = defaultdict(set)
    for row in found:
        for x in row.spans:
            if x.g >= 0:
                groups[x.f, x.g].add((row.doc, x.s, x.e))
    assert all(len({texts[d].encode()[s:e] for d, s, e in members}) == 1 for members in groups.values())
    assert max(len({d for d, *_ in members}) for members in groups.values()) == 5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=12).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=2, max_size=7))
def test_maximal_repeats(contexts):
    anchors = [len(c) // 2 for c in contexts]
    due = set()
    for i in range(len(contexts)):
        for j in range(i):
            back = on = 0
            a, b = contexts[i], contexts[j]
            while back < min(anchors[i], anchors[j]) and a[anchors[i] - back - 1] == b[anchors[j] - back - 1]:
                back += 1
            while anchors[i] + on < len(a) and anchors[j] + on < len(b) and a[anchors[i] + on] == b[anchors[j] + on]:
                on += 1
            if back + on >= 3:
                due.add((i, back, on))
                due.add((j, back, on))
    groups = repeats.maximal_repeats(contexts, anchors, 3)
    got = {(m, back, on) for back, on, members in groups for m in members}
    # Every pair's repeat is in a group, every group's repeat is some pair's, and members are all that hold it.
    assert {x[1:] for x in got} <= {x[1:] for x in due}
    for back, on, members in groups:
        held = {c[a - back : a + on] for c, a in zip((contexts[m] for m in members), (anchors[m] for m in members))}
        assert len(held) == 1
        whole = next(iter(held))
        assert sorted(members) == [i for i, (c, a) in enumerate(zip(contexts, anchors)) if a >= back and c[a - back : a + on] == whole]
    assert all(any(m == x and b >= back and o >= on for x, b, o in got) for m, back, on in due)


# --- Lines -------------------------------------------------------------------------------------------------


def line_texts(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([5, 12, 25, 40]))).strip() for _ in range(25)]
    out = []
    for _ in range(40):
        lines = []
        for _ in range(5):
            s = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                i = r.randrange(max(1, len(s)))
                s[i : i + r.randrange(2)] = r.choice(["x", ""])
            lines.append("".join(s))
        out.append("\n".join(lines))
    return out + helpers.EDGES


@pytest.mark.parametrize("hot", [64, 1])
def test_lines(spark, monkeypatch, hot):
    own = line_dedup.similar_lines
    monkeypatch.setattr(line_dedup, "similar_lines", lambda lines, **kw: own(lines, hot=hot, **kw))
    texts = line_texts(3)
    found = {(r.doc, r.no): ((r.class_doc, r.class_no), r.exact) for r in line_dedup.duplicate_lines(with_clashes(docs_of(spark, texts)), "doc_id").collect()}
    strip = "\x20\t\n\x0b\x0c\r"
    told = [(i, n, line.strip(strip)) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"), 1) if line.strip(strip)]
    distinct = sorted({line for *_, line in told})
    linked = []
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            limit = min(2, min(len(a), len(b)) // 10)
            if limit and abs(len(a) - len(b)) <= limit and levenshtein_within(a, b, limit):
                linked.append((a, b))
    label = helpers.classes(distinct, linked)
    head = {}
    for i, n, line in told:
        head.setdefault(label[line], (i, n, line))
    assert found == {(i, n): (head[label[line]][:2], head[label[line]][2] == line) for i, n, line in told}


def levenshtein_within(a, b, limit):
    return a == b or (len(a) < 200 and helpers.levenshtein(a, b) <= limit)


def test_lines_of_one_segment_are_not_all_paired(spark, monkeypatch):
    """Of lines that share their first segment and nothing else, pairs grow no faster than the lines."""
    r = random.Random(7)
    start = "".join(r.choice("abcdefgh ") for _ in range(43)) + "."
    lines = [start + "".join(r.choice("abcdefghijklmnop ") for _ in range(85)) + "." for _ in range(60)]
    lines.append(lines[7][:90] + "X" + lines[7][91:])
    counted, own = [], line_dedup._verified

    def verified(pairs, *rest):
        counted.append(pairs.count())
        return own(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", verified)
    found = {r.no: (r.class_no, r.exact) for r in line_dedup.duplicate_lines(docs_of(spark, ["\n".join(lines)])).collect()}
    assert found == {**{no: (no, True) for no in range(1, 61)}, 61: (8, False)}
    assert sum(counted) <= 2 * len(lines)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_lines_of_a_key_across_batches(size):
    r = random.Random(size)
    owned = {(k, y): r.random() < 0.3 for k, y in ((r.randrange(-20, 20), r.randrange(12)) for _ in range(150))}
    rows = sorted((k, y - (1 << 63) * own) for (k, y), own in owned.items() for _ in range(r.randrange(1, 4)))
    batches = [pa.RecordBatch.from_pydict({"k": [k for k, _ in part], "v": [v for _, v in part]}) for part in (rows[i : i + size] for i in range(0, len(rows), size))]
    got = [tuple(x.values()) for batch in line_dedup._stars(iter(batches)) for x in batch.to_pylist()]
    first = {k: min(y for (j, y), own in owned.items() if j == k and own) for k in {k for (k, _), own in owned.items() if own}}
    assert sorted(got) == sorted((k, first[k], y, own) for (k, y), own in owned.items() if k in first and y != first[k])


def test_lines_removed(spark):
    texts = ["a line of some length here\nanother line", "a line of some length herE\nanother line\n\nnew", None, ""]
    docs = with_clashes(docs_of(spark, texts))
    found = line_dedup.dedup_lines(docs)
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near, r.removed) for r in found.collect()} == {
        0: (2, 0, 0, []), 1: (3, 1, 1, [1, 2]), 2: (0, 0, 0, []), 3: (0, 0, 0, [])
    }
    cleaned = line_dedup.without_lines(docs, found)
    assert cleaned.columns == docs.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {0: texts[0], 1: "\nnew", 2: None, 3: ""}
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 3)), min_size=1, max_size=6))
def test_banded_automaton(cases):
    points = lambda t: np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
    got = line_dedup.within([(points(a), points(b)) for a, b, _ in cases], [k for *_, k in cases])
    assert got.tolist() == [helpers.levenshtein(a, b) <= k for a, b, k in cases]


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=40), st.integers(0, 3), st.randoms(use_true_random=False))
def test_lines_within_reach_share_a_key(line, edits, r):
    other = list(line)
    for _ in range(r.randrange(edits + 1)):
        i = r.randrange(len(other) + 1)
        other[i : i + r.randrange(2)] = r.choice(["x", "a", ""])
    short, long = sorted((line, "".join(other)), key=len)
    if len(short) > edits:
        own, asked = (set(line_dedup.keys_of([t], edits, probe)[0].tolist()) for t, probe in ((short, False), (long, True)))
        assert own & asked


def _plain_code(coder, token):
    """A token's flags and raw value by the patterns alone."""
    d = decontaminate
    core = d._core(token)
    low = core.lower()
    if not core:
        return d.NOTHING | (d._ENDS if token[-1] in ".!?:" else 0) << 24
    made = d._GLUE.fullmatch(low) if low[0] in "$€£" or low[0].isdigit() else None
    number = d._NUMBER.fullmatch(low)
    flags = d._IS_NUMBER * bool(number) | d._GLUED * bool(not number and made and (made[1] or made[3]) and (not made[3] or made[3] in d.UNITS))
    flags |= d._IS_UNIT * (low in d.UNITS) | d._IS_NAME * (core[0].isupper() and core[1:].islower())
    flags |= d._ENDS * (token.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":"))
    return (d.xxhash.xxh64_intdigest(low) & ((1 << 34) - 1)) << 29 | flags << 24 | coder.words.get(low, d.UNKNOWN)


def test_codes_of_odd_tokens():
    parts = ["a", "Ab", "İ", "ß", "ª", "²", "٣", "5", "12.5", "km", "$", "€", "%", "°", "_", "-", "+", ".", ":", "\"", "(", ")", "”", "中", "É", "́", "½", "Ⅷ", "x9"]
    tokens = {a + b + c for a in parts for b in ["", *parts] for c in ["", *parts]}
    coder = decontaminate.Coder({"a": 8, "abkm": 9, "5": 10}, learning=False)
    assert len(tokens) > 20_000 and [t for t in tokens if coder.of(t) != _plain_code(coder, t)] == []


def test_plain_words_pass_no_pattern(monkeypatch):
    """Most words are letters alone: their codes follow without a regular expression."""
    calls = []
    core = decontaminate._core
    monkeypatch.setattr(decontaminate, "_core", lambda t: calls.append(t) or core(t))
    coder = decontaminate.Coder()
    coder.tokens("Plain words of a text, with two marks.")
    assert sorted(calls) == ["marks.", "text,"]
