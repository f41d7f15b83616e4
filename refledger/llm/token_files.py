"""Token ids as ORC files: one row per document, in ascending order of the document ids.

ORC writes integers in runs and bit-packed stretches, keeps the range of each column for every stripe and every few
thousand rows, and here a Bloom filter on the document ids. So a reader splits a file at its stripes, and a lookup of
a few documents leaves out the stripes and rows whose ranges or filters rule them out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refledger.llm.token_count import encoder, stable_pieces, vocabulary_path

# Ids that leave a task at once.
AT_ONCE = 1 << 20


def _encode(path: str, end_id: int, piece: int):
    """Batches (key, text) to (key, part, at, n_tokens, ids); `at` counts the ids before a document in its part."""

    def ids_of(bpe, text: str | None) -> np.ndarray:
        parts = [np.asarray(bpe.ids(p), dtype=np.int32) for p in stable_pieces(text, piece)] if text else []
        return np.concatenate([*parts, np.array([end_id], dtype=np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = encoder(path), TaskContext.get().partitionId(), 0

        def told(keys: pa.Array, found: list[np.ndarray], first: int) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            columns = [keys, pa.array(np.full(len(found), part), pa.int32()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), ids]
            return pa.RecordBatch.from_arrays(columns, ["key", "part", "at", "n_tokens", "ids"])

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            found, since, load = [], 0, 0
            for i in range(len(texts)):
                found.append(ids_of(bpe, texts[i].as_py()))
                load += len(found[-1])
                if load >= AT_ONCE or i == len(texts) - 1:
                    yield told(keys.slice(since, len(found)), found, at)
                    at, since, found, load = at + load, i + 1, [], 0

    return run


def write_ids(
    docs: DataFrame, to: str, key: str = "doc_id", text: str = "text", *, path: str | None = None, end_id: int = 2,
    piece: int = 1 << 15, stripe: int = 16 << 20, stride: int = 10_000, block: int = 256 << 10, fpp: float = 0.01,
) -> None:
    """Write every document's token ids and `end_id` as ORC files in `to`, in ascending order of the keys.

    Columns: the key, `part` (the number of the file's range of keys), `at` (ids before the document in its part),
    `n_tokens`, `ids`. Null keys come first, rows of one key in the order of a hash of their texts; repeated rows are
    written each. Null and empty texts have the end id alone. An empty table makes no rows. Other columns are not read.

    Rows are dealt out by ranges, of keys first, then of hashes and places, so that many rows of one key part too. Long
    texts are encoded piece by piece, cut where no token can run across. `stripe` and `block` are bytes, `stride` rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumns({"__hash": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("key"), F.col("__hash"), F.col("__row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    coded = dealt.mapInArrow(_encode(path or vocabulary_path(), end_id, piece), f"key {kind}, part int, at long, n_tokens long, ids array<int>")
    options = {
        "orc.bloom.filter.columns": key, "orc.bloom.filter.fpp": fpp, "orc.create.index": True, "orc.row.index.stride": stride,
        "orc.stripe.size": stripe, "orc.compress.size": block, "orc.rows.between.memory.checks": 64,
    }
    coded.withColumnRenamed("key", key).write.options(**options).orc(to)


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """The documents of `write_ids`: key, `start` (ids of all documents before it), `n_tokens`, `ids`.

    Only `part` and `n_tokens` are read for the parts' totals, one small row a file.
    """
    rows = spark.read.orc(at)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    key = next(c for c in rows.columns if c not in ("part", "at", "n_tokens", "ids"))
    return rows.join(F.broadcast(totals), "part").select(key, (F.col("before") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids")


def find_ids(spark: SparkSession, at: str, keys: Iterable, key: str = "doc_id") -> DataFrame:
    """Rows of the named documents; ranges and Bloom filters of the files keep most others unread."""
    return spark.read.orc(at).where(F.col(key).isin(list(keys))).select(key, "n_tokens", "ids")


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        values = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = column.offsets.to_numpy()
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())

    return run(ids)
