"""Near-duplicate lines by partition into segments and an edit join.

If two lines are within t edits, and the shorter one is cut into t + 1 segments, one segment stands
unchanged in the longer one, not far from its place. So every line's segments go into an index by length, number
and content, and every line probes it with those of its substrings that could be such a segment. Lines that meet
under a key are held against the key's first line, and only those that this leaves apart against each other. Pairs
are verified with a banded automaton whose states are bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refledger.llm.common import FEW_IDS, by_ids, components
from refledger.llm.near_dup import _mixed, _powers
from refledger.sources.workspace import cut


_BLANK = " \t\n\x0b\x0c\r"
_NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)
_SIGN = np.uint64(1 << 63)
# Lines whose hashes a task remembers, so that it posts a frequent line once.
_SEEN = 1 << 17


def _node(line: str) -> bytes:
    return hashlib.md5(line.encode("utf8"), usedforsecurity=False).digest()


def _lids(nodes: list[bytes]) -> np.ndarray:
    """The first 63 bits of each node."""
    return (np.frombuffer(b"".join(nodes), dtype=">u8")[::2] >> np.uint64(1)).astype(np.uint64)


def _find_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, no, nodes, n = [], [], [], []
        last = batch.num_rows - 1
        for row, text in enumerate(batch.column(1)):
            for i, line in enumerate(text.as_py().split("\n"), 1):
                line = line.strip(_BLANK)
                if line:
                    rows.append(row)
                    no.append(i)
                    nodes.append(_node(line))
                    n.append(len(line))
            if len(rows) >= 1 << 16 or row == last and rows:
                told = [pa.array(no, pa.int32()), pa.array(nodes, pa.binary()), pa.array(_lids(nodes).view(np.int64)), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *told], names=["doc", "no", "node", "lid", "n"])
                rows, no, nodes, n = [], [], [], []


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines without white space at their ends, of `doc` and `text`, neither null; blank lines are none.

    Per line: `doc`, `no` (from 1), `node` (the MD5 of its UTF-8), `lid` (the first 63 bits of it) and `n`, its length.
    """
    told = [("no", T.IntegerType()), ("node", T.BinaryType()), ("lid", T.LongType()), ("n", T.IntegerType())]
    schema = T.StructType([T.StructField("doc", docs.schema["doc"].dataType), *[T.StructField(c, t) for c, t in told]])
    return docs.select("doc", "text").mapInArrow(_find_lines, schema)


def allowed(length: Column, edits: int, per: int) -> Column:
    """Edits that a line of this length may be away: one for each `per` characters, `edits` at most."""
    return F.least(F.lit(edits), F.floor(length / per)).cast("int")


def _segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (from 0) and size of segment i (from 1) of lines of these lengths.

    Of three or more segments the first and the last have a multiple of four characters, so that lines of similar
    length have equal ones; those in the middle share the rest.
    """
    even = length // parts
    if parts < 3:
        start = (i - 1) * even
        return start, (even if i < parts else length - start)
    edge = np.where(even >= 4, even - even % 4, even)
    if i in (1, parts):
        return (np.zeros_like(length) if i == 1 else length - edge), edge
    base, longer = np.divmod(length - 2 * edge, parts - 2)
    short = parts - 2 - longer
    return edge + (i - 2) * base + np.maximum(0, i - 2 - short), base + (i - 1 > short)


def _places(length: np.ndarray, edits: int, probe: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Segments to index, or substrings to probe with: number, start, size, length of the line they belong to, and whether
    they are the line's own segments.

    A line probes for lines that are shorter by 0 to `edits` characters. A match of segment i with i - 1 edits or
    fewer before it, and no more than are left behind it, suffices: that bounds how far the substring can lie
    from the segment's own place.
    """
    parts = edits + 1
    for less in range(edits + 1 if probe else 1):
        target = length - less
        for i in range(1, parts + 1):
            start, size = _segment(target, i, parts)
            shifts = range(max(1 - i, less - (parts - i)), min(i - 1, less + parts - i) + 1) if probe else (0,)
            for shift in shifts:
                yield i, start + shift, size, target, not less and not shift


def _hashed(lines: list[str], edits: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each line, a row a line, `_NOTHING` where one does not fit; and which columns are of the line's own segments.

    A key is a segment's number, its content, and the length of its line; for the first and the last of three or
    more segments, which lie at the line's ends whatever its length, their size stands for it.
    """
    data = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32)
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    begin = np.concatenate(([0], np.cumsum(length)))[:-1]
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    found, owned = [], []
    for i, start, size, target, own in _places(length, edits, probe):
        fits = (start >= 0) & (start + size <= length) & (size > 0)
        a = begin + np.where(fits, start, 0)
        b = a + np.where(fits, size, 0)
        of = size if edits >= 2 and i in (1, edits + 1) else target
        hashed = _mixed((sums[b] - sums[a]) * down[a] + _mixed((of * (edits + 2) + i).astype(np.uint64)))
        found.append(np.where(fits, hashed, _NOTHING))
        owned.append(own)
    return np.stack(found, axis=1), np.array(owned)


def keys_of(lines: list[str], edits: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each line, and the number of the line that each belongs to."""
    keys = np.sort(_hashed(lines, edits, probe)[0], axis=1)
    kept = keys != _NOTHING
    kept[:, 1:] &= keys[:, 1:] != keys[:, :-1]
    return keys[kept].view(np.int64), np.repeat(np.arange(len(lines)), kept.sum(axis=1))


def marked_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (63 bits) that each line probes, the number of its line, and whether it is a segment of the line itself."""
    found, own = _hashed(lines, edits, True)
    # The last bit tells; of a line's equal keys the last one has it, if any.
    keys = np.sort(np.where(found == _NOTHING, _NOTHING, (found & ~np.uint64(1)) | own.astype(np.uint64)), axis=1)
    kept = keys != _NOTHING
    kept[:, :-1] &= keys[:, :-1] >> np.uint64(1) != keys[:, 1:] >> np.uint64(1)
    chosen = keys[kept]
    return (chosen >> np.uint64(1)).view(np.int64), np.repeat(np.arange(len(lines)), kept.sum(axis=1)), chosen & np.uint64(1) == 1


def _postings(edits: int, per: int):
    """Of texts: (k, v) for each key of a line; v is the line's hash, and negative where the key is a segment of its own."""
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64())])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
        """Lines in portions of bounded size."""
        seen: set[bytes] = set()
        nodes, lines, size = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    line = line.strip(_BLANK)
                    if len(line) < per:
                        continue
                    node = _node(line)
                    if node in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    lines.append(line)
                    size += len(line)
                    if size >= 1 << 18:
                        yield nodes, lines
                        nodes, lines, size = [], [], 0
        if lines:
            yield nodes, lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, lines in some(batches):
            keys, owner, own = marked_keys(lines, edits)
            v = _lids(nodes)[owner] | np.where(own, _SIGN, np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v.view(np.int64))], schema=schema)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by key and line: the first line that has the key as its own segment, beside every other line of the key.

    Lines that own the key come first. A key that no line owns, or one line only has, gives nothing. No key is held.
    """
    schema = pa.schema([("k", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("own", pa.bool_())])
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key, line, centre = before or (k[0], v[0], v[0])
        starts = np.concatenate(([before is None or k[0] != key], k[1:] != k[:-1]))
        other = np.concatenate(([v[0] != line], v[1:] != v[:-1])) & ~starts
        at = np.maximum.accumulate(np.where(starts, np.arange(len(k)), -1))
        first = np.where(at >= 0, v[at], centre)
        met = other & (first < 0)
        bare = lambda a: (a[met].view(np.uint64) & ~_SIGN).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[met], bare(first), bare(v), v[met] < 0)], schema=schema)
        before = k[-1], v[-1], first[-1]


def within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """Which pairs of code point arrays are within their limits of edits.

    Common ends are dropped first. The state of a pair is one bit set per number of edits e: bit d + k tells
    whether the first i characters of b are within e edits of the first i + d of a.
    """
    out = np.zeros(len(pairs), dtype=bool)
    rest = []
    for p, ((a, b), k) in enumerate(zip(pairs, limits)):
        m = min(len(a), len(b))
        odd = np.flatnonzero(a[:m] != b[:m])
        lo = int(odd[0]) if len(odd) else m
        a, b = a[lo:], b[lo:]
        m = min(len(a), len(b))
        odd = np.flatnonzero(a[len(a) - m :][::-1] != b[len(b) - m :][::-1])
        hi = int(odd[0]) if len(odd) else m
        a, b = a[: len(a) - hi], b[: len(b) - hi]
        if abs(len(a) - len(b)) <= k:
            if not len(a) or not len(b):
                out[p] = max(len(a), len(b)) <= k
            else:
                rest.append((len(b), p, a, b, k))
    rest.sort(key=lambda r: r[:2])
    at = 0
    while at < len(rest):
        # As many pairs as fit into a matrix of bounded size; the longest is the last.
        end = at + 1
        while end < len(rest) and (end + 1 - at) * rest[end][0] <= 1 << 21:
            end += 1
        some = rest[at:end]
        out[[p for _, p, *_ in some]] = _banded([r[2] for r in some], [r[3] for r in some], np.array([r[4] for r in some]))
        at = end
    return out


def _banded(first: list[np.ndarray], second: list[np.ndarray], limits: np.ndarray) -> np.ndarray:
    k = int(limits.max())
    width, n = 2 * k + 1, max(len(b) for b in second)
    # Characters of a stand k places to the right, so that column i + d + k is its character i + d + 1.
    a = np.zeros((len(first), n + 2 * k + 1), dtype=np.int32)
    b = np.full((len(first), n), -1, dtype=np.int32)
    for i, (x, y) in enumerate(zip(first, second)):
        a[i, k : k + len(x)] = x[: n + k + 1]
        b[i, : len(y)] = y
    size_a, size_b = np.array([len(x) for x in first]), np.array([len(y) for y in second])
    full = np.int64((1 << width) - 1)
    state = [np.full(len(first), ((1 << (e + 1)) - 1) << k, dtype=np.int64) & full for e in range(k + 1)]
    live, out = np.arange(len(first)), np.zeros(len(first), dtype=bool)
    for i in range(n):
        own = b[live, i]
        equal = np.zeros(len(live), dtype=np.int64)
        for d in range(width):
            equal |= (a[live, i + d] == own).astype(np.int64) << d
        fresh = [state[0] & equal]
        for e in range(1, k + 1):
            fresh.append(((state[e] & equal) | state[e - 1] | (state[e - 1] >> 1) | (fresh[e - 1] << 1)) & full)
        state = fresh
        over = size_b[live] == i + 1
        if over.any():
            at = live[over]
            bit = size_a[at] - size_b[at] + k
            by_edits = np.stack([s[over] for s in state])[limits[at], np.arange(len(at))]
            out[at] = (by_edits >> bit & 1).astype(bool)
        keep = ~over & (state[k] != 0)
        if not keep.all():
            live, state = live[keep], [s[keep] for s in state]
            if not len(live):
                break
    return out


def close_enough(a: Column, b: Column, limit: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right, limits in batches:
            points = lambda t: np.frombuffer(t.encode("utf-32-le"), dtype=np.int32)
            found = []
            for lo in range(0, len(left), 1024):
                pairs = [(points(x), points(y)) for x, y in zip(left[lo : lo + 1024], right[lo : lo + 1024])]
                found.append(within(pairs, limits[lo : lo + 1024].tolist()))
            yield pd.Series(np.concatenate(found) if found else np.empty(0, dtype=bool))

    return run(a, b, limit)


def marks(line: Column, edits: int) -> Column:
    """4 * edits + 1 numbers: each tells which of 64 classes of pairs of neighbours appear an odd number of times.

    An edit flips four classes at most, so of lines within `edits` edits one number is equal, and 4 * edits bits differ at most.
    """
    parts = 4 * edits + 1

    @F.pandas_udf("array<long>")
    def run(batch: pd.Series) -> pd.Series:
        out = []
        for t in batch:
            points = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            h = _mixed((points[:-1] << np.uint64(32)) | points[1:])
            at = (h % np.uint64(parts)) * np.uint64(64) + (h >> np.uint64(58))
            odd = np.bincount(at.astype(np.int64), minlength=64 * parts) & 1
            out.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        return pd.Series(out)

    return run(line)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and the lines wanted of them: the lines. Another text of the same document may have another line in a place."""
    schema = pa.schema([("node", pa.binary()), ("lid", pa.int64()), ("line", pa.string()), ("n", pa.int32())])
    for batch in batches:
        found, size = [], 0
        for text, wanted in zip(batch.column(0), batch.column(1)):
            lines = text.as_py().split("\n")
            for w in wanted.as_py():
                line = lines[w["no"] - 1].strip(_BLANK) if w["no"] <= len(lines) else ""
                if _node(line) == w["node"]:
                    found.append({"node": w["node"], "lid": w["lid"], "line": line, "n": w["n"]})
                    size += len(line)
            if size >= 1 << 22:
                yield pa.RecordBatch.from_pylist(found, schema)
                found, size = [], 0
        yield pa.RecordBatch.from_pylist(found, schema)


def _texts(docs: DataFrame, places: DataFrame, lids: DataFrame) -> DataFrame:
    """Each distinct line among the hashes once: `node`, `lid`, `line`, `n`. Lines whose hashes collide are all there."""
    some = by_ids(places, cut(lids.distinct(), "line-wanted"), "lid", "left_semi")
    first = some.groupBy("node", "lid", "n").agg(F.min(F.struct("doc", "no")).alias("at"))
    first = cut(first.select("node", "lid", "n", "at.doc", "at.no"), "line-first")
    wanted = first.groupBy("doc").agg(F.collect_list(F.struct("no", "node", "lid", "n")).alias("wanted"))
    # These rows are wider than ids.
    wanted = F.broadcast(wanted) if first.count() <= FEW_IDS // 4 else wanted.hint("merge")
    found = docs.join(wanted, "doc").select("text", "wanted").mapInArrow(_pick, "node binary, lid long, line string, n int")
    return cut(found.dropDuplicates(["node"]), "line-texts")


def _verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, edits: int, per: int) -> DataFrame:
    """Links (a, b) between nodes, from pairs (x, y) of line hashes."""
    pairs = cut(pairs, "line-pairs")
    lines = _texts(docs, places, pairs.select(F.explode(F.array("x", "y")).alias("lid")))
    one = lines.select(F.col("lid").alias("x"), F.col("node").alias("a"), F.col("line").alias("line_a"), F.col("n").alias("n_a"))
    two = lines.select(F.col("lid").alias("y"), F.col("node").alias("b"), F.col("line").alias("line_b"), F.col("n").alias("n_b"))
    met = pairs.join(one, "x").join(two, "y").withColumn("limit", allowed(F.least("n_a", "n_b"), edits, per))
    met = met.where((F.abs(F.col("n_a") - F.col("n_b")) <= F.col("limit")) & (F.col("limit") > 0))
    return met.where(close_enough(F.col("line_a"), F.col("line_b"), F.col("limit"))).select("a", "b")


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def similar_lines(docs: DataFrame, places: DataFrame, *, edits: int = 2, per: int = 10, hot: int = 64) -> DataFrame:
    """Links (a, b) between distinct lines' nodes that connect all lines within reach.

    `docs` holds `doc` and `text`, neither null, and `places` is the written table of their `lines_of`. Only hashes of
    segments and lines are shuffled; texts follow for the lines that a pair names. All lines of a key are compared with
    the first line that owns it. After that only lines of a key that are still unconnected are compared, if their marks
    allow it; where over `hot` of them share the key, only those that share one of their marks as well. The links are then
    fewer than all, but connect the same lines.
    """
    postings = docs.select("text").mapInArrow(_postings(edits, per), "k long, v long").repartition("k").sortWithinPartitions("k", "v")
    stars = cut(postings.mapInArrow(_stars, "k long, x long, y long, own boolean"), "line-stars")
    links = cut(_verified(stars.select(*_pairs(F.col("x"), F.col("y"))).distinct(), docs, places, edits, per), "line-links")
    shared = stars.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    held = cut(stars.join(shared, "k").select("k", F.col("y").alias("lid"), "own", "m"), "line-held")
    if held.isEmpty():
        return links
    labels = cut(components(links), "line-labels")
    known = by_ids(places, cut(held.select("lid").distinct(), "line-held-lids"), "lid", "left_semi").select("lid", "node", "n").distinct()
    known = known.join(labels, "node", "left").select("lid", "n", F.coalesce("label", "node").alias("label"))
    full = cut(held.join(known, "lid"), "line-labelled")
    open_keys = full.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("own").alias("owned"))
    full = cut(full.join(open_keys.where("owned AND lo < hi").select("k"), "k"), "line-apart")
    joined = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    if full.isEmpty():
        return joined
    marked = _texts(docs, places, full.select("lid")).select("lid", marks(F.col("line"), edits).alias("marks"))
    each = F.transform("marks", lambda mark, i: F.struct(i.alias("part"), mark.alias("mark")))
    alone = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("mark")))
    dealt = full.join(cut(marked, "line-marked"), "lid").select("*", F.explode(F.when(F.col("m") > hot, each).otherwise(alone)).alias("deal"))
    dealt = dealt.select("k", "deal.*", "lid", "own", "n", "label", "marks")
    x, y = dealt.where("own").alias("x"), dealt.alias("y")
    apart = sum((F.bit_count(F.col("x.marks")[i].bitwiseXOR(F.col("y.marks")[i])) for i in range(4 * edits + 1)), F.lit(0))
    near = (
        (F.col("x.k") == F.col("y.k")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.mark") == F.col("y.mark"))
        & (F.col("x.label") != F.col("y.label")) & (F.abs(F.col("x.n") - F.col("y.n")) <= edits) & (apart <= 4 * edits)
    )
    rest = x.join(y, near).select(*_pairs(F.col("x.lid"), F.col("y.lid"))).distinct()
    return joined.unionByName(_verified(rest, docs, places, edits, per))


def duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, edits: int = 2, per: int = 10) -> DataFrame:
    """Per line: `doc`, `no`, `class_doc` and `class_no` (the first line of its class), `exact` (its text is that line's).

    Lines of one class are joined by links of at most one edit (insertion, deletion, substitution of a
    character) for each `per` characters of the shorter line, `edits` at most. The first line is that of the
    smallest document and number; rows that share an id share their numbers.
    """
    told = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    places = cut(lines_of(told), "line-places")
    labels = components(similar_lines(told, places=places, edits=edits, per=per))
    first = places.groupBy("node").agg(F.min(F.struct("doc", "no")).alias("first"))
    known = first.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    heads = known.groupBy("label").agg(F.min(F.struct("first", "node")).alias("head"))
    classes = known.join(heads, "label").select("node", F.col("head.first").alias("first"), (F.col("head.node") == F.col("node")).alias("exact"))
    return places.join(classes, "node").select("doc", "no", F.col("first.doc").alias("class_doc"), F.col("first.no").alias("class_no"), "exact")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, edits: int = 2, per: int = 10) -> DataFrame:
    """Per document: key, `n_lines`, `n_exact` and `n_near` (lines to remove), `removed` (their numbers, rising).

    Every line but the first of its class is removed. Null and empty texts and blank lines have no lines; rows that
    share an id count as one document and their lines once; rows without an id are no part of the result. An empty
    table gives no rows. Only the named columns are read.
    """
    found = duplicate_lines(docs, key, text, edits=edits, per=per)
    out = (F.col("doc") != F.col("class_doc")) | (F.col("no") != F.col("class_no"))
    per_doc = found.groupBy("doc").agg(
        F.count_if(out & F.col("exact")).alias("n_exact"),
        F.count_if(out & ~F.col("exact")).alias("n_near"),
        F.count("*").alias("n_lines"),
        F.array_sort(F.collect_set(F.when(out, F.col("no")))).alias("removed"),
    )
    ids = docs.select(F.col(key).alias("doc")).where("doc IS NOT NULL").distinct()
    zero = F.lit(0).cast("long")
    return ids.join(per_doc, "doc", "left").select(
        F.col("doc").alias(key),
        *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_exact", "n_near")],
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' own columns, with the removed lines taken out of the text."""
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.col("__removed"), (i + 1).cast("int")))
    met = docs.join(found.select(F.col(key), F.col("removed").alias("__removed")), key, "left")
    new = F.when(F.size("__removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    return met.withColumn(text, new).select(*docs.columns)
