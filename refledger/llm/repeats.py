"""Repeated passages: maximal repeats from enhanced suffix arrays, anchored so that they can be built in parts.

Of each stretch of `window` places in a text, the place with the smallest hash is its anchor. Equal strings of the
least length have equal anchors, so they meet under the bytes that follow their anchor. Places in a row with the
same anchor are a run. Runs with equal content are one class: if it has two members, all its strings repeat. Only
where an anchor's bytes are shared by different classes is there more to find out. For these, the suffixes from the
anchor are sorted, a stack over their common prefixes gives the tree of prefix intervals, and within each
interval the contexts to the left are told apart the same way: what neither grows to the right nor to the left
without losing a member is a maximal repeat, and the members are all its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.llm.common import by_ids
from refledger.llm.near_dup import _mixed, _powers
from refledger.sources.workspace import cut

_U64 = np.uint64
_GRAM = 16
_BLOCK = 1 << 20


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data))
    return np.concatenate((np.zeros(1, _U64), np.cumsum((data.astype(_U64) + _U64(1)) * up[: len(data)], dtype=_U64)))


def _hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from begin to end, for many such pairs."""
    _, down = _powers(len(sums))
    return _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U64))


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values: of a block's tail and of the next block's head."""
    n = len(x)
    wide = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=_U64)
    wide[:n] = x
    blocks = wide.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def runs_of(data: bytes, least: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of a text's places: first and last place, anchor, hash after the anchor, and hash of the content."""
    for lo in range(0, max(0, len(data) - least + 1), _BLOCK):
        part = np.frombuffer(data, dtype=np.uint8)[lo : lo + _BLOCK + least - 1]
        n = len(part) - least + 1  # places in this block
        sums = _sums(part)
        at = np.arange(n + window - 1)
        gram = _hashes(sums, at, at + _GRAM)
        anchor = (_sliding_minimum((gram >> _U64(32) << _U64(32)) | at.astype(_U64), window) & _U64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        own = anchor[first]
        after = _hashes(sums, own, own + (least - window + 1))
        content = _mixed(_hashes(sums, first, last + least) + (own - first).astype(_U64))
        yield first + lo, last + lo, own + lo, after.view(np.int64), content.view(np.int64)


_RUN = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("a", pa.int64()), ("f", pa.int64()), ("c", pa.int64())])


def _find_runs(least: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer()
                if data is None or data.size < least:
                    continue
                for s, e, a, f, c in runs_of(data, least, window):
                    same = [pa.array([doc] * len(s), pa.int64()), pa.array(np.full(len(s), row))]
                    yield pa.RecordBatch.from_arrays(same + [pa.array(x) for x in (s, e, a, f, c)], schema=_RUN)

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def prefix_intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """Intervals of a sorted array with their common prefix: (length, first, last), inner ones before outer ones.

    `lcp[i]` is the common prefix of entries i and i + 1. The stack holds the open intervals, longest on top.
    """
    out, stack = [], []
    for i, length in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > length:
            was, first = stack.pop()
            if i > first:
                out.append((was, first, i))
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return out


def maximal_repeats(contexts: list[bytes], anchors: list[int], least: int) -> list[tuple[int, int, list[int]]]:
    """Repeats of the least length that reach over the anchors: (left, right, members).

    `anchors` are the places in the contexts under which they meet. A repeat reaches `left` bytes back and `right` bytes
    on from the anchors of all its members, and can be prolonged on neither side, as far as the contexts go.
    """
    right = [c[a:] for c, a in zip(contexts, anchors)]
    left = [c[:a][::-1] for c, a in zip(contexts, anchors)]
    order = sorted(range(len(contexts)), key=right.__getitem__)
    lcp = [_common(right[i], right[j]) for i, j in zip(order, order[1:])]
    place = {m: i for i, m in enumerate(order)}
    most = max(anchors)
    found = []
    for on, first, last in prefix_intervals(lcp):
        if on + most < least:
            continue
        members = sorted(order[first : last + 1], key=left.__getitem__)
        lefts = [_common(left[i], left[j]) for i, j in zip(members, members[1:])]
        for back, lo, hi in prefix_intervals(lefts):
            if back + on < least:
                continue
            some = members[lo : hi + 1]
            spots = [place[m] for m in some]
            # Members that all go on together belong to an inner interval.
            if min(lcp[min(spots) : max(spots)]) == on:
                found.append((back, on, some))
    return found


def _outer(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without those that lie within another; of equals the first stays."""
    kept, end = [], -1
    for s, e, g in sorted(spans, key=lambda x: (x[0], -x[1])):
        if e > end:
            kept.append((s, e, g))
            end = e
    return kept


_FOUND = pa.schema([("f", pa.int64()), ("c", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("g", pa.int64())])))])


def _repeats_by_anchor(least: int, nested: bool):
    """Classes that stand sorted by anchor: each class's spans, counted from its context's start, with their group."""

    def of(group: list[dict]) -> list[dict]:
        spans: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for i, r in enumerate(group):
            if r["n"] > 1:
                spans[i].append((0, len(r["context"]), -1 - i))
        if len(group) > 1:
            anchors = [r["at"] for r in group]
            for g, (back, on, members) in enumerate(maximal_repeats([r["context"] for r in group], anchors, least)):
                for m in members:
                    spans[m].append((anchors[m] - back, anchors[m] + on, g))
        named = [s if nested else _outer(s) for s in spans]
        return [
            {"f": r["f"], "c": r["c"], "spans": [{"s": s, "e": e, "g": g} for s, e, g in own]}
            for r, own in zip(group, named) if own
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if group and group[0]["f"] != r["f"]:
                    out += of(group)
                    group = []
                # Repeated rows bring one class's context more than once.
                if not group or group[-1]["c"] != r["c"]:
                    group.append(r)
            yield pa.RecordBatch.from_pylist(out, _FOUND)
        if group:
            yield pa.RecordBatch.from_pylist(of(group), _FOUND)

    return run


def _windows(least: int):
    """All strings of the least length in a class's context: the way for anchors that more classes share than a task holds."""
    schema = pa.schema([("f", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("d", pa.int64()), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sums = _sums(np.frombuffer(r["context"], dtype=np.uint8))
                s = np.arange(len(r["context"]) - least + 1)
                same = [pa.array(np.full(len(s), r[k])) for k in ("f", "c", "n")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(s), pa.array(r["at"] - s), pa.array(_hashes(sums, s, s + least).view(np.int64))], schema=schema)

    return run


def _cut_contexts(least: int):
    schema = pa.schema([("f", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_buffer()
                own = [{"f": w["f"], "c": w["c"], "n": w["n"], "at": w["a"] - w["s"], "context": data[w["s"] : w["e"] + least].to_pybytes()} for w in wanted]
                yield pa.RecordBatch.from_pylist(own, schema)

    return run


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = 400, window: int = 300, nested: bool = False, most: int = 20_000) -> DataFrame:
    """Occurrences of maximal repeats: `doc`, `row`, and `spans` (s, e, f, g) of bytes per run of the document.

    Spans with equal `f` and `g` (not negative) are the occurrences of one repeat; a negative `g` is a run whose whole content
    repeats, `c` telling which. Repeats are followed as far as their run's context goes, and longer ones are reported
    run by run, overlapping by at least `least` - 1 bytes. A null id shows as the smallest whole number. With `nested`, shorter repeats within longer ones are listed too.
    `row` tells apart documents that share an id but not their text. Null texts are empty.
    """
    if not _GRAM <= least - window + 1:
        raise ValueError("the window leaves no bytes after the anchor")
    named = _named(docs, key, text)
    runs = cut(named.select("doc", "row", "text").mapInArrow(_find_runs(least, window), "doc long, row long, s long, e long, a long, f long, c long"), "repeat-runs")
    shared = runs.groupBy("f").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    # Written, so that a join of two plain tables follows, in which a crowded anchor can be split.
    shared = cut(shared, "repeat-anchors")
    met = cut(runs.join(shared.select("f", (F.col("lo") < F.col("hi")).alias("mixed")), "f"), "repeat-shared")

    first = F.min(F.struct("doc", "row", "s", "e", "a")).alias("r")
    classes = met.where("mixed").groupBy("f", "c").agg(F.count("*").alias("n"), first)
    classes = cut(classes.select("f", "c", "n", "r.*"), "repeat-classes")
    wanted = classes.groupBy("doc", "row").agg(F.collect_list(F.struct("f", "c", "n", "s", "e", "a")).alias("wanted"))
    texts = by_ids(named, wanted.select("doc", "row"), ["doc", "row"], "left_semi").join(wanted, ["doc", "row"])
    contexts = texts.select("text", "wanted").mapInArrow(_cut_contexts(least), "f long, c long, n long, at long, context binary")
    crowded = cut(classes.groupBy("f").count().where(F.col("count") > most).select("f"), "repeat-crowded")
    calm = contexts.join(crowded, "f", "left_anti")
    spans = calm.repartition("f").sortWithinPartitions("f", "c").mapInArrow(
        _repeats_by_anchor(least, nested), "f long, c long, spans array<struct<s: long, e: long, g: long>>"
    )
    if not crowded.isEmpty():
        every = contexts.join(crowded, "f", "left_semi").dropDuplicates(["f", "c"]).mapInArrow(_windows(least), "f long, c long, n long, s long, d long, w long")
        every = cut(every, "repeat-windows")
        again = every.groupBy("f", "d", "w").agg(F.sum("n").alias("n"), F.min("s").alias("g")).where("n > 1").select("f", "d", "w", F.xxhash64("d", "w").alias("g"))
        mine = every.join(again, ["f", "d", "w"]).groupBy("f", "c")
        one = F.struct("s", (F.col("s") + least).alias("e"), F.shiftrightunsigned("g", 1).alias("g"))
        spans = spans.unionByName(mine.agg(F.collect_list(one).alias("spans")))
    spans = cut(spans, "repeat-spans")
    mixed = met.where("mixed").join(spans, ["f", "c"])
    alike = met.where("NOT mixed").withColumn(
        "spans", F.array(F.struct(F.lit(0).cast("long").alias("s"), (F.col("e") - F.col("s") + least).alias("e"), F.lit(-1).cast("long").alias("g")))
    )
    start, f, c = F.col("s"), F.col("f"), F.col("c")
    placed = F.transform("spans", lambda x: F.struct((x["s"] + start).alias("s"), (x["e"] + start).alias("e"), f.alias("f"), c.alias("c"), x["g"].alias("g")))
    return mixed.unionByName(alike.select(*mixed.columns)).select("doc", "row", placed.alias("spans"))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`id` as it is, `doc` without nulls for joins, `row` that tells texts of one id apart, and `text`."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.select("id", F.coalesce("id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("id", "text").alias("row"), "text")


def _remove():
    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            out = []
            for text, own in zip(texts, spans):
                data, rest, at, runs, gone = text.encode("utf8", "replace"), hashlib.sha256(), 0, 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in own):
                    if s > at or not runs:
                        rest.update(data[at:s])
                        runs += 1
                        gone += e - s
                        at = e
                    elif e > at:
                        gone += e - at
                        at = e
                rest.update(data[at:])
                out.append((gone, runs, rest.hexdigest()))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least: int = 400, **options) -> DataFrame:
    """Per document row: key, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, without all bytes that repeat.

    A byte goes if it is covered by a string of `least` bytes that also starts elsewhere, in the same document or
    another; strings are those of the input. Null and empty texts have 0 bytes and the hash of nothing. Rows that
    repeat are copies of each other; rows without an id are texts like all others. An empty table gives no rows. Only the named columns are read.
    """
    named = _named(docs, key, text)
    found = repeats(docs, key, text, least=least, **options)
    spans = found.groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = cut(spans.where(F.size("spans") > 0).select("doc", "row", F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans")), "repeat-of-docs")
    ids = spans.select("doc", "row")
    size = F.octet_length("text").cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    clean = by_ids(named, ids, ["doc", "row"], "left_anti").select("id", size, zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    texts = by_ids(named, ids, ["doc", "row"], "left_semi").join(spans, ["doc", "row"])
    rest = texts.select("id", size, _remove()(F.col("text"), F.col("spans")).alias("x")).select("id", "n_bytes", "x.*")
    return clean.unionByName(rest).withColumnRenamed("id", key)
