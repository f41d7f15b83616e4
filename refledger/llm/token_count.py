"""Token counts of texts of any length, in overlapping chunks that are spliced where both sides must agree.

A text that is longer than a chunk is cut into chunks, each of which runs on into the next one. Every chunk is
encoded on its own, with the places where its tokens end. Two neighbours are spliced at a place in their overlap
that is a token's end for both and that no context can move: there a white space follows a mark that is none, and
the tokenizer's pattern never lets a piece run across such a place. Left of it the left chunk's tokens hold, right
of it the right chunk's. Where an overlap has no such place, the text is done again with wider overlaps.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

# The vocabulary of byte_bpe_50k.json as ranks, and its one special token, whose string in a text is that token.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256

_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n]")


class Encoder:
    """The tokens that the tokenizer file's library gives, without added tokens; see the tests for the proof."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(SPECIAL_ID + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)
        self.length[SPECIAL_ID] = len(SPECIAL)

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self._bpe.encode_ordinary(text)
        first, *rest = text.split(SPECIAL)
        found = self._bpe.encode_ordinary(first)
        for part in rest:
            found.append(SPECIAL_ID)
            found += self._bpe.encode_ordinary(part)
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a text that is encoded at once; a null text has none."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = encoder(path)
        for batch in batches:
            yield pd.Series([len(bpe.ids(t)) if t else 0 for t in batch], dtype="int64")

    return run(text)


def _split(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for lo in range(0, len(starts), 64):  # a few chunks at a time leave the task
                    own = starts[lo : lo + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "h": [h] * len(own),
                            "no": list(range(lo, lo + len(own))),
                            "last": [s == starts[-1] for s in own],
                            "begin": list(own),
                            "text": [text[s:] if s == starts[-1] else text[s : s + chunk + overlap] for s in own],
                        },
                        pa.schema([("h", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("begin", pa.int64()), ("text", pa.string())]),
                    )

    return run


def stable_pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about `size` characters that are encoded apart, cut where no token can run across."""
    start = 0
    while start < len(text):
        place = _STABLE.search(text, start + size)
        end = place.start() if place else len(text)
        yield text[start:end]
        start = end


def stable_ends(text: str, ids: list[int], lengths: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Stable places from character lo to hi, and the number of tokens before each of them."""
    places = [m.start() for m in _STABLE.finditer(text, max(1, lo), max(1, hi))]
    if not places:
        return [], []
    # Tokens end at bytes; places are characters.
    sizes = [len(text[a:b].encode("utf8")) for a, b in zip([0, *places], places)]
    at = np.cumsum(sizes)
    ends = np.cumsum(lengths[np.asarray(ids, dtype=np.int64)])
    before = np.searchsorted(ends, at, side="left")
    both = (before < len(ends)) & (ends[np.minimum(before, len(ends) - 1)] == at)
    return [p for p, ok in zip(places, both) if ok], [int(n) + 1 for n, ok in zip(before, both) if ok]


def _encode(chunk: int, overlap: int, path: str, keep: bool):
    schema = pa.schema(
        [
            ("h", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()),
            ("head", pa.list_(pa.int64())), ("head_n", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64())), ("tail_n", pa.list_(pa.int64())),
            ("ids", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for r in batch.to_pylist():
                text, begin = r["text"], r["begin"]
                ids = bpe.ids(text)
                head, head_n = stable_ends(text, ids, bpe.length, 0, overlap) if r["no"] else ([], [])
                tail, tail_n = ([], []) if r["last"] else stable_ends(text, ids, bpe.length, chunk, len(text))
                out = {
                    "h": r["h"], "no": r["no"], "last": r["last"], "n": len(ids), "ids": ids if keep else None,
                    "head": [begin + p for p in head], "head_n": head_n, "tail": [begin + p for p in tail], "tail_n": tail_n,
                }
                yield pa.RecordBatch.from_pylist([out], schema)

    return run


def splice(texts: DataFrame, path: str, *, chunk: int, overlap: int, keep_ids: bool = False) -> DataFrame:
    """Chunks of long texts (h, text; h is unique) with their own tokens only: h, `no`, `n_tokens`, `ids`.

    Overlaps grow eightfold until every text could be spliced; an overlap as long as the text leaves one chunk.
    """
    done = None
    todo = texts
    while True:
        width = max(chunk, 2 * overlap)
        chunks = todo.mapInArrow(_split(width, overlap), "h string, no long, last boolean, begin long, text string")
        # Chunks of one huge text go to many tasks.
        chunks = chunks.repartition("h", "no")
        coded = chunks.mapInArrow(
            _encode(width, overlap, path, keep_ids),
            "h string, no long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>, ids array<int>",
        )
        coded = cut(coded, "token-chunks")
        left = coded.select("h", (F.col("no") + 1).alias("no"), "tail", "tail_n")
        right = coded.select("h", "no", "head", "head_n").where("no > 0")
        seam = left.where(F.col("tail").isNotNull()).join(right, ["h", "no"])
        seam = seam.select("h", "no", F.array_min(F.array_intersect("tail", "head")).alias("place"), "tail", "tail_n", "head", "head_n")

        def before(places: str, counts: str) -> Column:
            return F.element_at(F.map_from_arrays(places, counts), F.col("place"))

        seam = seam.select("h", "no", "place", before("tail", "tail_n").alias("to"), before("head", "head_n").alias("since"))
        seam = cut(seam, "token-seams")
        failed = seam.where("place IS NULL").select("h").distinct()
        good = coded.select("h", "no", "n", "ids").join(failed, "h", "left_anti")
        good = good.join(seam.select("h", "no", "since"), ["h", "no"], "left").join(seam.select("h", (F.col("no") - 1).alias("no"), "to"), ["h", "no"], "left")
        since, to = F.coalesce("since", F.lit(0)), F.coalesce("to", "n")
        own = F.slice("ids", (since + 1).cast("int"), (to - since).cast("int"))
        good = good.select("h", "no", (to - since).alias("n_tokens"), own.alias("ids"))
        done = good if done is None else done.unionByName(good)
        failed = cut(failed, "token-failed")
        if failed.isEmpty():
            return done
        todo, overlap = todo.join(failed, "h", "left_semi"), 8 * overlap


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None, chunk: int = 32_768, overlap: int = 256, limit: int = 1024
) -> DataFrame:
    """Per document row: key, `n_bytes` (UTF-8), `n_tokens`, and `over_limit` (more than `limit` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Long texts that repeat are encoded once. Only the named
    columns are read; an empty table gives no rows.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    is_long = F.length("text") > chunk
    short = rows.where(~is_long).select("key", size, n_tokens(F.col("text"), path).alias("n_tokens"))
    long = rows.where(is_long).select("key", F.md5("text").alias("h"), "text")
    distinct = cut(long.select("h", "text").dropDuplicates(["h"]), "token-texts")
    sums = splice(distinct, path, chunk=chunk, overlap=overlap).groupBy("h").agg(F.sum("n_tokens").alias("n_tokens"))
    counted = long.select("key", size, "h").join(sums, "h").select("key", "n_bytes", "n_tokens")
    return short.unionByName(counted).select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
