"""Every-term substring search of a table of queries in a table of items, without a cross join.

Item fields are joined into one haystack per item; haystacks and queries are first made distinct, so
copies on either side are searched once. A query that matches holds, among others, its own rarest
three-letter gram, so an equi-join on that gram finds every match, and the join condition verifies
all terms. Queries with no term of three letters use one- and two-letter grams in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.sources.workspace import cut

SPLIT = 1 << 16  # texts of a gram that one part holds
FEW_GRAMS = 1 << 20  # grams of three letters at most that may travel with every task

# Normalised fields and terms hold no line feed, so it keeps the fields of a haystack apart.
FIELD_SEP = "\n"


def haystack(fields: Sequence[Column]) -> Column:
    """Normalised fields as one text; NULL fields are left out."""
    return F.concat_ws(FIELD_SEP, *fields)


def holds_all(hay: Column, terms: Column) -> Column:
    """Is each term a substring of at least one field?"""
    return F.forall(terms, lambda t: F.contains(hay, t))


def _grams(chars: Column, size: int) -> Column:
    """Distinct grams of a text that is given as its characters: linear in the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - size, F.lit(0)))
    whole = F.transform(starts, lambda i: F.concat(*[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(size)]))
    return F.array_distinct(F.filter(whole, lambda g: F.length(g) == size))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def postings(texts: DataFrame) -> DataFrame:
    """(hay, gram) for each distinct gram of one to three letters of distinct texts."""
    chars = texts.select("hay", _chars(F.col("hay")).alias("chars"))
    grams = F.concat(*[_grams(F.col("chars"), size) for size in (1, 2, 3)])
    return chars.select("hay", F.explode(grams).alias("gram"))


def search(queries: DataFrame, query: str, items: DataFrame, hay: str, *, phrase: bool = False) -> DataFrame:
    """(query, item columns) for each item that holds every term of the query.

    `query` is a normalised text; its terms are its words or, with `phrase=True`, the whole text.
    `hay` is the items' haystack. Queries without any term match nothing.
    """

    def terms_of(text: Column) -> Column:
        return F.filter(F.array(text) if phrase else F.split(text, " "), lambda t: t != "")

    has_trigram = F.exists("terms", lambda t: F.length(t) >= 3)
    trigrams = F.flatten(F.transform("terms", lambda t: _grams(_chars(t), 3)))
    wanted = (
        queries.select(F.col(query).alias("query"))
        .distinct()
        .withColumn("terms", terms_of(F.col("query")))
        .select("query", F.explode(F.array_distinct(F.when(has_trigram, trigrams).otherwise(F.col("terms")))).alias("gram"))
    )
    wanted = cut(wanted, "wanted-grams")
    asked = cut(wanted.select("gram").distinct(), "asked-grams")
    asked = F.broadcast(asked) if asked.count() <= FEW_GRAMS else asked
    # Grams are counted and then joined: they are made once, of texts that are spread before they fan out, and only
    # those that a query asks for are written.
    texts = items.select(F.col(hay).alias("hay")).repartition("hay").distinct()
    posted = cut(postings(texts).join(asked, "gram", "left_semi"), "postings")
    frequency = posted.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram that no item holds rules its query out.
    rarest = (
        wanted.join(frequency, "gram", "left")
        .groupBy("query")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .where("rarest.n > 0")
        .select("query", "rarest.gram", "rarest.n", terms_of(F.col("query")).alias("terms"))
    )
    # A gram in many texts is split: its texts by a hash, and each of its queries goes to every part.
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    crowded = frequency.where(F.col("n") > SPLIT).select("gram", parts.alias("parts"))
    dealt = posted.join(crowded, "gram", "left").withColumn("part", F.pmod(F.xxhash64("hay"), F.coalesce("parts", F.lit(1))).cast("int"))
    sent = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    hits = dealt.join(sent, ["gram", "part"]).where(holds_all(F.col("hay"), F.col("terms"))).select("query", "hay")
    return hits.withColumnsRenamed({"query": query, "hay": hay}).join(items, hay)
