"""A training corpus from the documents table: five stages, each of them one operator of `refledger.llm`.

Each stage reads what its predecessor kept, written as Parquet in the session's shared folder. Columns of any name and type
besides those of `documents` pass through; a stage has a defined result for nulls, empty texts and empty tables, which its
operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.llm import decontaminate, language, mixing, near_dup, shards
from refledger.llm.common import by_ids, free_name, numbered_texts, quoted, table
from refledger.sources.workspace import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; learned from the labels of the documents themselves."""
    return language.drop_rejected(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows that share an id, or have none, are documents of their own if their texts differ; in a group, documents with
    an id of their own go before them.
    """
    number = free_name("__number", docs.columns)
    named = numbered_texts(docs, "doc_id", "text", number)
    found = near_dup.near_duplicates(named, number, shingle=5, num=80, den=100)
    dropped = cut(found.where(~F.col("kept")).select(number).distinct(), "dropped-ids")
    return by_ids(named, dropped, number, "left_anti").select(*quoted(docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, with its own or other parameters."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of 150 % of all words takes them; sources weigh 3, 1, 2, repeating."""
    return mixing.repeated(docs, mixing.mix(docs, mixing.cyclic((3, 1, 2)), share=1.5, cap=2))


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, shard and slot, in 24 shards of equal weight.

    Columns of the documents keep their names; if they have one of these three, the stage's own gets underscores before it.
    """
    row = free_name("__row", docs.columns)
    packed = docs.select("doc_id", "text", F.struct(*quoted(docs.columns)).alias(row))
    placed = shards.assign(packed, {s: 1.0 for s in range(24)}, carry=[row])
    added = [F.col(c).alias(free_name(c, docs.columns)) for c in ("size", "shard", "slot")]
    return placed.select(F.col(f"{row}.*"), *added)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_to_shards),
]

# Compression and MinHash are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
