"""Spelling variants: the words of a corpus, their neighbours at one edit, and the forms they lead to.

Neighbours are found with the two-part search scheme for one error. Of a word's two halves one must stand in its
neighbour unchanged: either the left half is matched exactly and the search runs on to the right, allowing one error,
or the right half is matched and the search runs on to the left. Each search keeps its direction, so each has an index
of its own reading direction: the FM-index of the delimited vocabulary or of its mirror image, in which a step is two
ranks and a set of words is an interval of suffixes.

Spark deals the vocabulary out by those halves, so a word is asked only where words with the same half are indexed. A
half that very many words share is split into blocks, each of which is asked.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

# Symbols in one index; distinct words that a task counts before it passes them on; bytes of a text at a time.
SYMBOLS, HELD, PIECE = 1 << 18, 1 << 17, 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_OTHER = re.compile(rb"[^a-z\xc0-\xff]")


def _counted(every: int, least: int):
    """Words of (key, text) batches with their counts, in parts of a bounded number of words.

    Letters of the class are those of Latin-1, so a text is read in that encoding, a byte for each code point, and
    anything else in it ends a run.
    """
    run_of = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def pieces(raw: bytes) -> Iterator[bytes]:
        start = 0
        while start < len(raw):
            other = _OTHER.search(raw, start + PIECE)
            end = other.start() if other else len(raw)
            yield raw[start:end]
            start = end

    def told(held: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc = zlib.crc32
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                start = crc(f"{key.as_py()}:".encode())
                for piece in pieces(text.encode("latin-1", "replace").translate(_LOWER)):
                    runs = run_of.findall(piece)
                    held.update(runs)
                    if piece.isascii():
                        hashes = [crc(w, start) for w in runs]
                    else:
                        hashes = [crc(w if w.isascii() else w.decode("latin-1").encode(), start) for w in runs]
                    for w, h in zip(runs, hashes):
                        if h % every == 0:
                            held[w] -= 1
                            at = h % len(w)
                            if len(w) > least:
                                held[w[:at] + w[at + 1 :]] += 1
                    if len(held) > HELD:
                        yield told(held)
                        held.clear()
        if held:
            yield told(held)

    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", *, every: int = 199, least: int = 6, often: int = 5) -> DataFrame:
    """Words (word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased.

    A run whose crc32 of `<key>:<run>` the number `every` divides loses the code point at crc32 modulo its length. Words
    have at least `least` code points and occur `often` times in all. Null and empty texts have no words, a null key is
    written as the empty text; repeated rows count each time; only the named columns are read.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.col(f"`{text}`")).toDF("key", "text")
    counted = rows.where("text IS NOT NULL").mapInArrow(_counted(every, least), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# --- the index ---------------------------------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and the range each belongs to."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return starts[of] + np.arange(len(of)) - first[of], of


class Index:
    """FM-index of delimited words, each written backwards, so that a step reads a word's next symbol.

    Symbol 0 is the delimiter. An interval [lo, hi) of suffix ranks stands for all words that go on alike.
    """

    def __init__(self, words: list[str]):
        self.words = words
        flat, size = _flat(words)
        self.letters = np.unique(flat)
        n = len(flat) + len(words) + 1
        text = np.zeros(n, dtype=np.int64)
        # The delimiter, then each word from its end to its start, and a delimiter after it.
        start = 1 + np.cumsum(size + 1) - (size + 1)
        place, of = _ranges(start, size)
        text[2 * start[of] + size[of] - 1 - place] = np.searchsorted(self.letters, flat) + 1
        order = _suffixes(text)
        before = text[order - 1]
        self.n = n
        self.before = before
        # A symbol's ranks, in order: how many of them lie below a rank is one binary search.
        self.steps = np.sort(before * (n + 1) + np.arange(n))
        # A search ends with the delimiter before a word that is written backwards.
        word_at = np.full(n, -1, dtype=np.int64)
        word_at[start - 1] = np.arange(len(words))
        self.word_of = word_at[order[: len(words) + 1]]
        self.delimiters = len(words) + 1

    def coded(self, flat: np.ndarray) -> np.ndarray:
        """Symbols of letters; a letter that no word has gets a symbol that is nowhere."""
        at = np.searchsorted(self.letters, flat)
        known = at < len(self.letters)
        known[known] = self.letters[at[known]] == flat[known]
        return np.where(known, at + 1, len(self.letters) + 1)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.n + 1)
        return np.searchsorted(self.steps, base + lo), np.searchsorted(self.steps, base + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for every letter that goes on from it: read off narrow intervals, tried in wide ones."""
        tried = len(self.letters)
        wide = hi - lo > 4 * tried
        narrow = np.flatnonzero(~wide)
        at, of = _ranges(lo[narrow], (hi - lo)[narrow])
        seen = np.unique(narrow[of] * (tried + 2) + self.before[at])
        i, letter = seen // (tried + 2), seen % (tried + 2)
        wide = np.flatnonzero(wide)
        i = np.concatenate([i, np.repeat(wide, tried)])
        letter = np.concatenate([letter, np.tile(np.arange(1, tried + 1), len(wide))])
        return i[letter > 0], letter[letter > 0]


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after another, and the length of each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return flat, np.array([len(w) for w in words], dtype=np.int64)


def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; a suffix that ends is less than any that goes on."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        later = np.full(n, -1, dtype=np.int64)
        later[: max(0, n - width)] = rank[width:]
        both = rank * (n + 1) + later + 1
        order = np.argsort(both)
        both = both[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(both[1:] != both[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


def near(index: Index, asked: list[str], exact: np.ndarray, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(asked, indexed) numbers of words at one edit whose first `exact` letters are the asked word's own."""
    if not asked:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    flat, size = _flat(asked)
    start = np.cumsum(size + 1) - (size + 1)
    pattern = np.zeros(len(flat) + len(asked), dtype=np.int64)
    place, _ = _ranges(start, size)
    pattern[place] = index.coded(flat)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def finish(q: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The rest of the word and its delimiter, without another error."""
        while len(q):
            symbol = pattern[start[q] + t]
            lo, hi = index.step(symbol, lo, hi)
            alive = lo < hi
            ended = alive & (symbol == 0)
            if ended.any():
                word = index.word_of[lo[ended]]
                found.append((q[ended][word >= 0], word[word >= 0]))
            alive &= symbol > 0
            q, t, lo, hi = q[alive], t[alive] + 1, lo[alive], hi[alive]

    q = np.arange(len(asked))
    lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), index.delimiters, dtype=np.int64)
    for depth in range(int(exact.max())):
        now = q[(exact[q] > depth) & (lo[q] < hi[q])]
        lo[now], hi[now] = index.step(pattern[start[now] + depth], lo[now], hi[now])
    q, t = q[lo < hi], exact[lo < hi].astype(np.int64)
    lo, hi = lo[q], hi[q]
    while len(q):
        letter = pattern[start[q] + t]
        inside = letter > 0
        # The asked letter is one too many. Of equal letters in a row, the last one counts as such.
        lost = inside.copy()
        lost[inside] = pattern[start[q[inside]] + t[inside] + 1] != letter[inside]
        finish(q[lost], t[lost] + 1, lo[lost], hi[lost])
        ways, of = np.unique(lo * (index.n + 1) + hi, return_inverse=True)
        way_lo, way_hi = ways // (index.n + 1), ways % (index.n + 1)
        i, child = index.children(way_lo, way_hi)
        by = np.argsort(i, kind="stable")
        i, child = i[by], child[by]
        child_lo, child_hi = index.step(child, way_lo[i], way_hi[i])
        first = np.searchsorted(i, np.arange(len(ways)))
        many = np.searchsorted(i, np.arange(len(ways)), side="right") - first
        # Other letters: in the place of the asked one, or before it. A few words at a time.
        load = np.cumsum(many[of])
        for part in np.split(np.arange(len(q)), np.searchsorted(load, np.arange(at_once, int(load[-1]), at_once))):
            if len(part) == 0:
                continue
            c, p = _ranges(first[of[part]], many[of[part]])
            p = part[p]
            other = (child[c] != letter[p]) & (child_lo[c] < child_hi[c])
            c, p = c[other], p[other]
            finish(q[p], t[p], child_lo[c], child_hi[c])
            swap = inside[p]
            finish(q[p[swap]], t[p[swap]] + 1, child_lo[c[swap]], child_hi[c[swap]])
        q, t, lo, hi, letter = q[inside], t[inside] + 1, lo[inside], hi[inside], letter[inside]
        lo, hi = index.step(letter, lo, hi)
        alive = lo < hi
        q, t, lo, hi = q[alive], t[alive], lo[alive], hi[alive]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.concatenate([a for a, _ in found]) * len(index.words) + np.concatenate([b for _, b in found]))
    return pairs // len(index.words), pairs % len(index.words)


# --- neighbours and forms ----------------------------------------------------------------------------


def _search(table: pa.Table) -> pa.Table:
    """Neighbours within one shard: rows (side, half, asked, word, n) of words to be indexed and words to be asked."""
    out = []
    sides, halves, asks, words, counts = (table.column(c).to_pylist() for c in ("side", "half", "asked", "word", "n"))
    for side in (0, 1):
        indexed = {w: n for s, a, w, n in zip(sides, asks, words, counts) if s == side and not a}
        asked = [(w, h) for s, a, w, h in zip(sides, asks, words, halves) if s == side and a]
        if not indexed or not asked:
            continue
        # From the right, words are read backwards.
        way = slice(None, None, -1 if side else 1)
        names = list(indexed)
        a, b = near(Index([w[way] for w in names]), [w[way] for w, _ in asked], np.array([h for _, h in asked]))
        out.append((pa.array([asked[i][0] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array([indexed[names[i]] for i in b], pa.int64())))
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("n_of", pa.int64())])
    return pa.concat_tables([pa.Table.from_arrays(list(x), schema=schema) for x in out]) if out else schema.empty_table()


def neighbours(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs (word, near, n_of) of distinct words (word, n) at exactly one edit, in both orders; n_of is near's n.

    Words need two code points at least. `words` is read several times, so it should be a written table.
    """
    size = F.length("word")
    # A word of length m is asked with its left half m // 2 and its right half m - m // 2. It is indexed under each half
    # with which a word of length m - 1, m or m + 1 may ask.
    left = F.array_distinct(F.transform(F.array(size - 1, size, size + 1), lambda m: F.floor(m / 2).cast("int")))
    right = F.array_distinct(F.transform(F.array(size - 1, size, size + 1), lambda m: (m - F.floor(m / 2)).cast("int")))

    def posted(side: int, halves: Column, asked: bool) -> DataFrame:
        rows = words.select("word", "n", F.explode(halves).alias("half")).where((F.col("half") > 0) & (F.col("half") <= size))
        part = F.expr("left(word, half)") if side == 0 else F.expr("right(word, half)")
        return rows.select(F.lit(side).alias("side"), "half", F.lit(asked).alias("asked"), "word", "n", F.xxhash64(F.lit(side), "half", part).alias("key"))

    rows = posted(0, left, False).unionByName(posted(1, right, False))
    own_left, own_right = F.floor(size / 2).cast("int"), (size - F.floor(size / 2)).cast("int")
    rows = rows.unionByName(posted(0, F.array(own_left), True)).unionByName(posted(1, F.array(own_right), True))
    rows = cut(rows, "spelling-postings")
    weights = cut(rows.where("NOT asked").groupBy("key").agg(F.sum(F.length("word") + 1).alias("load")), "spelling-loads")
    total = weights.agg(F.sum("load")).first()[0] or 0
    shards = total // symbols + 1
    # Halves that fill an index alone; there are at most as many of them as indexes.
    busy = weights.where(F.col("load") > symbols).select("key", F.ceil(F.col("load") / symbols).alias("blocks"))
    busy = F.broadcast(busy) if shards <= 1 << 20 else busy
    rows = rows.join(busy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("blocks")))
    rows = rows.withColumn("block", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(own)))
    shard = F.when(F.col("blocks") > 1, F.struct(F.col("key").alias("a"), F.col("block").alias("b"))).otherwise(
        F.struct(F.pmod("key", F.lit(shards)).alias("a"), F.lit(-1).cast("long").alias("b"))
    )
    found = rows.select(shard.alias("shard"), "side", "half", "asked", "word", "n").groupBy("shard").applyInArrow(_search, "word string, near string, n_of long")
    return found.distinct()


def variants(words: DataFrame, *, times: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """Per word (word, n): `form`, `root`, `n_near`, `form_n` beside them.

    The form is the neighbour with the largest n, of equal ones the smallest in code-point order, if its n is at least
    `times` the word's; else null, as for a word without neighbours. The root is where forms lead to from the word, or
    the word itself. Counts rise from form to form, so chains end; they are followed by doubling.
    """
    words = cut(words.select("word", "n"), "spelling-words")
    best = F.min(F.struct((-F.col("n_of")).alias("m"), F.col("near").alias("w")))
    found = neighbours(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(found, "word", "left")
    has = -F.col("best.m") >= times * F.col("n")
    found = cut(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")),
        "spelling-forms",
    )
    way = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        way = cut(way.join(further, "root", "left"), "spelling-roots")
        moved = not way.where("__next IS NOT NULL").isEmpty()
        way = way.select("word", F.coalesce("__next", "root").alias("root"))
        if not moved:
            break
    out = found.join(way, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
