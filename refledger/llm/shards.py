"""Rendezvous hashing of records over weighted shards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

_DIGITS = 13


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the text's MD5."""
    whole = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(1 << (4 * _DIGITS))


def _cost(key: Column, shard: int, weight: float) -> Column:
    return -F.log(_unit(F.concat(key, F.lit(f"|{shard}")))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the lowest cost -ln(u) / weight, u being a hash of key and shard.

    A shard takes keys in proportion to its weight. Costs of a shard never depend on other shards, so a new
    shard only takes keys into itself, and a removed one only gives its own away. A null key is the key "".
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("shards need positive weights")
    text = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct(_cost(text, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return F.array_min(F.array(*costs))["shard"]


def assign(
    docs: DataFrame,
    weights: Mapping[int, float],
    key: str = "doc_id",
    text: str = "text",
    *,
    grown: Mapping[int, float] | None = None,
    carry: Sequence[str] = (),
    overhead: int = 8,
    spread: int = 3,
) -> DataFrame:
    """Per row: key, `size`, `text_crc32`, `law`, `shard`, `slot`, `grown_shard`, the last null without `grown`.

    `size` is the text's UTF-8 bytes plus `overhead`; a null text has none, and a null checksum. `slot` runs
    from 0 without gaps in each shard, in the order of the key's MD5. Repeated rows go to the same shard, in
    slots of their own; a null key is placed as the key "". An empty table gives no rows, and columns that
    are not named are not read; those in `carry` stand at the end of the result.

    A shard is numbered in blocks of MD5 prefixes (16 ** `spread` of them), never sorted in one task; block
    counts are added up in a table of shards times blocks, however many rows there are. Only repeats of one
    key share a block entirely.
    """
    placed = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("__place"),
        (F.struct(*carry) if carry else F.lit(True)).alias("__carried"),
    ).withColumn("__block", F.substring("__place", 1, spread))
    placed = cut(placed, "shards")
    counts = placed.groupBy("shard", "__block").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("shard", "__block").orderBy("__place", key, "text_crc32", "size")
    numbered = placed.withColumn("__i", F.row_number().over(within)).join(offsets, ["shard", "__block"])
    return numbered.select(
        F.col(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__before") + F.col("__i") - 1).cast("long").alias("slot"), "grown_shard",
        *[F.col(f"__carried.`{c}`") for c in carry],
    )
