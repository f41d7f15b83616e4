"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

# ASCII white space, the word separators of all contracts here.
SPACES = r"[^\x20\x09-\x0D]+"

# Ids of at most 16 bytes that may travel with every task.
FEW_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns of these names, which may hold dots."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores before it until no column of `taken` has it in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; zero for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({SPACES})"), F.lit(1))).cast("long"), F.lit(0).cast("long"))


def sized(few: DataFrame) -> DataFrame:
    """A side of a join, to be sent to the other side if it has no more than a million rows of a few bytes."""
    return F.broadcast(few) if few.count() <= FEW_IDS else few.hint("merge")


def by_ids(docs: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Semi or anti join of wide rows with distinct ids.

    Up to a million ids are sent to the rows, which then stay where they are; beyond that both sides are
    shuffled. The ids are counted first, so `ids` should be a written table or cheap.
    """
    return docs.join(sized(ids), on, how)


def numbered_texts(docs: DataFrame, key: str, text: str, number: str) -> DataFrame:
    """One row per id and text, with a `number` of its own, a name that no column has.

    A row whose id is its alone is numbered by that id. Rows that share an id or have none are numbered by 62 bits of
    a hash of id and text, above all smaller ids; of equal ones the row whose hash is smallest stays, whatever the types of
    its columns. Only these are shuffled with their texts.
    """
    repeated = cut(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated-ids")
    alone = by_ids(docs, repeated, key, "left_anti").where(F.col(key).isNotNull())
    shared = by_ids(docs, repeated, key, "left_semi").unionByName(docs.where(F.col(key).isNull()))
    by_hash = F.shiftrightunsigned(F.xxhash64(key, text), 2).bitwiseOR(F.lit(1 << 62))
    row = F.struct(*quoted(docs.columns))
    shared = shared.select(by_hash.alias("number"), row.alias("row"), F.sha2(F.to_json(row), 256).alias("order"))
    shared = cut(shared.groupBy("number").agg(F.min_by("row", "order").alias("row")), "shared-ids")
    return alone.withColumn(number, F.col(key).cast("long")).unionByName(shared.select("row.*", F.col("number").alias(number)))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, label) with the smallest node as label, for every node of an edge.

    Alternates large and small stars: each round links all neighbours of a node to the smallest of them, so
    the number of rounds grows with the logarithm of a component's size. Each round is a written table. A
    node that many others hang on is only ever an aggregate key and the small side of a join.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v > m").distinct()
    e = cut(e, "component-edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return e.select(F.col("v").alias("node"), F.col("m").alias("label")).unionByName(
                e.select(F.col("m").alias("node"), F.col("m").alias("label")).distinct()
            )
        seen = mark
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(low, "u").select(F.col("w").alias("v"), "m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("r"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", "r"), F.struct(F.col("m").alias("v"), "r"))).alias("s"))
        e = cut(small.select(F.col("s.v").alias("v"), F.col("s.r").alias("m")).where("v > m").distinct(), "component-edges")
