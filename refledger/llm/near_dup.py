"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct word shingles. Documents with equal sets are collapsed first. Each set has
one minimum per hash function; full minima form the keys of the bands, and of each minimum only its lowest
b bits are kept, packed into whole numbers. Two sets that share a band are candidates. The share of equal b-bit
fields, corrected for chance collisions, estimates their similarity; candidates that are not clearly below
the threshold are compared on the full sets.

No bucket is expanded into all its pairs. First every member of a bucket is compared with the bucket's smallest
member only. After that, members of a bucket that are still in different components are compared: in small
buckets by a join; in large ones within tiles of bounded size that hold the members' full sets, so that only
links leave the task and a link that joins two components spares all further comparisons between them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.llm.common import by_ids, components
from refledger.sources.workspace import cut

_U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20
_DENSE = 1 << 24
_POWERS: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads whole numbers over all 64 bits."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=_U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _segment_words(data: np.ndarray) -> np.ndarray:
    """One hash per word of bytes that start and end at a word's edge."""
    inside = np.concatenate(([False], ~_IS_SPACE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, dtype=_U64)
    up, down = _powers(len(data))
    # A word's hash is a difference of prefix sums of a polynomial, shifted back to the word's start.
    sums = np.concatenate((np.zeros(1, _U64), np.cumsum((_LOWER[data].astype(_U64) + _U64(1)) * up[: len(data)], dtype=_U64)))
    return _mixed((sums[end] - sums[start]) * down[start])


def words_of(text: str) -> np.ndarray:
    """Hashes of the text's words, A-Z in lower case; long texts are read in segments that end between words."""
    data = text.encode("utf8", "replace")
    if len(data) <= _SEGMENT:
        return _segment_words(np.frombuffer(data, dtype=np.uint8))
    parts, at = [], 0
    while at < len(data):
        edge = _SPACE.search(data, min(len(data), at + _SEGMENT))
        end = edge.start() if edge else len(data)
        parts.append(_segment_words(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)))
        at = end
    return np.concatenate(parts)


def shingles_of(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text's whole sequence is its one shingle."""
    words = words_of(text) if text else np.empty(0, dtype=_U64)
    if not len(words):
        return words
    wide = min(size, len(words))
    total = np.full(len(words) - wide + 1, wide * 0x632BE59BD9B4E019 & _MASK, dtype=_U64)
    for i in range(wide):
        total = _mixed(total + words[i : len(words) - wide + 1 + i])
    return np.unique(total)


class Sketcher:
    """Band keys and packed b-bit fields of a set, with hash functions that never change."""

    def __init__(self, bands: int, rows: int, bits: int):
        if bits not in (1, 2, 4, 8):
            raise ValueError("bits must be 1, 2, 4 or 8")
        self.bands, self.rows, self.bits = bands, rows, bits
        n = bands * rows
        seeds = _mixed(np.arange(1, 2 * n + 1, dtype=_U64))
        self.times = (seeds[:n] | _U64(1)).astype(np.uint32)[:, None]
        self.plus = seeds[n:].astype(np.uint32)[:, None]
        per = 64 // bits
        self.longs = -(-n // per)
        self.shift = (np.arange(per, dtype=_U64) * _U64(bits))[None, :]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes ^ (hashes >> _U64(32))).astype(np.uint32)
        least = np.full(len(self.times), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(least, (self.times * x[None, i : i + 2048] + self.plus).min(axis=1), out=least)
        return least

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = self.minima(hashes).astype(_U64)
        key = np.arange(self.bands, dtype=_U64)
        for column in least.reshape(self.bands, self.rows).T:
            key = _mixed(key * _U64(_BASE) + column)
        low = _mixed(least) & _U64((1 << self.bits) - 1)
        fields = np.zeros(self.longs * self.shift.shape[1], dtype=_U64)
        fields[: len(low)] = low
        packed = np.bitwise_or.reduce(fields.reshape(self.longs, -1) << self.shift, axis=1)
        return key.view(np.int64), packed.view(np.int64)


def sketch(text: Column, shingle: int, bands: int, rows: int, bits: int) -> Column:
    """Struct of `n` (set size), `fp` (the set's fingerprint), `bands` and `bits`; the last three null for no words."""

    @F.pandas_udf("n long, fp binary, bands array<long>, bits array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(bands, rows, bits)
        for batch in batches:
            out = []
            for t in batch:
                found = shingles_of(t, shingle)
                out.append((len(found), xxhash.xxh128_digest(found.tobytes()), *sketcher(found)) if len(found) else (0, None, None, None))
            yield pd.DataFrame(out, columns=["n", "fp", "bands", "bits"])

    return run(text)


def shingle_set(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t, shingle).view(np.int64) for t in batch], index=batch.index, dtype=object)

    return run(text)


def unequal_fields(a: Column, b: Column, longs: int, bits: int) -> Column:
    """Number of b-bit fields in which two packed signatures differ."""
    total = F.lit(0)
    mask = sum(1 << i for i in range(0, 64, bits))
    mask -= (mask >> 63) << 64
    for i in range(longs):
        x = a[i].bitwiseXOR(b[i])
        step = 1
        while step < bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        total = total + F.bit_count(x.bitwiseAND(F.lit(mask)))
    return total


def estimate(a: Column, b: Column, functions: int, bits: int) -> Column:
    """Similarity from the share of equal fields, less what equals by chance."""
    longs = -(-functions // (64 // bits))
    chance = 2.0**-bits
    equal = 1 - unequal_fields(a, b, longs, bits) / functions
    return (equal - chance) / (1 - chance)


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(den * common >= num * union).select("a", "b")


def _overlaps(hashes: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """For sets in one tile: the sizes of a member's intersections with all members."""
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    _, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    first = np.concatenate(([0], np.cumsum(count)))
    listed = owner[np.argsort(place, kind="stable")]
    begin = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))

    # Only what several members hold counts. If that is not too much, one product of matrices counts it all.
    several = np.flatnonzero(count > 1)
    if len(several) * len(hashes) <= _DENSE:
        column = np.full(len(count), -1)
        column[several] = np.arange(len(several))
        at = column[place]
        held = np.zeros((len(hashes), len(several)), dtype=np.float32)
        held[owner[at >= 0], at[at >= 0]] = 1
        common = (held @ held.T).astype(np.int64)
        return common.__getitem__

    def of(i: int) -> np.ndarray:
        own = place[begin[i] : begin[i + 1]]
        sizes = count[own]
        steps = np.repeat(first[own] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return np.bincount(listed[steps], minlength=len(hashes))

    return of


def _tile_links(num: int, den: int, bits: int, functions: int, floor: float):
    """Links within a tile that join members of different components."""
    mask = _U64(sum(1 << i for i in range(0, 64, bits)))

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("node").reset_index(drop=True)
        node, own, n, low = (tile[c].to_numpy() for c in ("node", "own", "n", "place"))
        _, label = np.unique(tile["label"].to_numpy(), return_inverse=True)
        same_salt = tile["t"].iloc[0] == tile["u"].iloc[0]
        packed = np.stack(tile["bits"].to_numpy()).view(_U64)
        keys = np.stack(tile["bands"].to_numpy())
        overlap = None
        links = []
        for i in range(len(tile) - 1):
            j = np.arange(i + 1, len(tile))
            j = j[(label[j] != label[i]) & (same_salt | (own[j] != own[i]))]
            j = j[den * np.minimum(n[j], n[i]) >= num * np.maximum(n[j], n[i])]
            if not len(j):
                continue
            odd = packed[j] ^ packed[i]
            step = 1
            while step < bits:
                odd |= odd >> _U64(step)
                step *= 2
            equal = 1 - np.bitwise_count(odd & mask).sum(axis=1) / functions
            chance = 2.0**-bits
            j = j[(equal - chance) / (1 - chance) >= floor]
            # A pair is compared in the first band that it shares.
            j = j[(keys[j] == keys[i]).argmax(axis=1) == low[0]]
            if not len(j):
                continue
            overlap = overlap or _overlaps(tile["hashes"].tolist())
            common = overlap(i)[j]
            for other in j[den * common >= num * (n[j] + n[i] - common)]:
                if label[other] != label[i]:
                    links.append((node[i], node[other]))
                    label[label == label[other]] = label[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    shingle: int = 5,
    num: int = 80,
    den: int = 100,
    bands: int = 25,
    rows: int = 5,
    bits: int = 2,
    slack: float = 5.0,
    busy: int = 32,
    tile: int = 512,
) -> DataFrame:
    """One row per document: key, `n_shingles`, `component_id` and `kept`.

    Documents are linked if den * |A and B| >= num * |A or B|. `component_id` is the smallest id that links
    reach. Null texts and texts without words have no shingles and are linked with nothing; so are rows
    without an id, whose `component_id` is null and which are kept. Rows that share an id count as one
    document. Only the named columns are read, whatever else the table holds; an empty table gives no rows.

    `bands` times `rows` hash functions: a pair at the threshold of 0.8 shares no band with a probability of
    5e-5, at 0.85 of 4e-7. `slack` is the number of standard deviations that an estimate may
    lie under the threshold before the full comparison is left out.
    """
    functions = bands * rows
    named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketched = named.select("id", sketch(F.col("text"), shingle, bands, rows, bits).alias("s")).select("id", "s.*")
    sketched = cut(sketched, "near-sketches")
    # Equal sets stand together under their smallest id.
    classes = sketched.where("fp IS NOT NULL AND id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("node"))
    nodes = classes.join(sketched.select(F.col("id").alias("node"), "fp", "n", "bands", "bits"), ["fp", "node"])
    nodes = cut(nodes.select("node", "n", "bands", "bits"), "near-nodes")

    members = nodes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("m")).where("a < z")
    buckets = cut(buckets, "near-buckets")

    share = num / den
    equal = share + (1 - share) * 2.0**-bits
    spread = (equal * (1 - equal) / functions) ** 0.5 / (1 - 2.0**-bits)
    floor = share - slack * spread

    def possible(n: str, o: str, x: str, y: str) -> Column:
        """Neither size nor estimate excludes the pair."""
        sizes = den * F.least(n, o) >= num * F.greatest(n, o)
        return sizes & (estimate(F.col(x), F.col(y), functions, bits) >= floor)

    small = nodes.select("node", "n", "bits")

    def as_(letter: str) -> DataFrame:
        return small.select(F.col("node").alias(letter), F.col("n").alias(f"n_{letter}"), F.col("bits").alias(f"bits_{letter}"))

    # First: each member with its bucket's smallest.
    star = members.join(buckets.select("band", "a"), "band").where("node > a").select("a", F.col("node").alias("b")).distinct()
    star = star.join(as_("a"), "a").join(as_("b"), "b").where(possible("n_a", "n_b", "bits_a", "bits_b"))
    star = cut(star.select("a", "b").distinct(), "near-star")

    shared = buckets.where("m > 2").select("band", "m")
    meeting = cut(members.join(shared, "band"), "near-meeting")
    wanted = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).unionByName(meeting.select(F.col("node").alias("id"))).distinct()
    # Texts are read again once, for all sets that any later step compares.
    texts = by_ids(named, cut(wanted, "near-wanted"), "id", "left_semi")
    sets = cut(texts.select(F.col("id").alias("node"), shingle_set(F.col("text"), shingle).alias("hashes")), "near-sets")

    linked = cut(_links(star, sets, num, den), "near-links")
    labels = components(linked)

    # Then: members of a bucket that are not connected yet.
    labelled = meeting.join(labels, "node", "left").select("band", "m", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    open_members = cut(labelled.join(mixed, "band", "left_semi"), "near-open")

    few = open_members.where(F.col("m") <= busy).join(small, "node")
    x, y = few.alias("x"), few.alias("y")
    met = (
        (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
        & possible("x.n", "y.n", "x.bits", "y.bits")
    )
    rest = x.join(y, met).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    links = linked.unionByName(_links(cut(rest, "near-rest"), sets, num, den))

    side = F.ceil(F.col("m") / tile).cast("int")
    dealt = open_members.where(F.col("m") > busy).withColumn("own", F.pmod(F.xxhash64("node"), side).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), side - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "own", "node", "label")
    dealt = dealt.join(nodes, "node").join(sets, "node").withColumn("place", F.array_position("bands", F.col("band")) - 1)
    links = links.unionByName(dealt.groupBy("band", "t", "u").applyInPandas(_tile_links(num, den, bits, functions, floor), "a long, b long"))
    labels = components(links)

    placed = classes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("found"))
    out = sketched.select("id", "n", "fp").join(placed, "fp", "left")
    component = F.coalesce("found", "id")
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
