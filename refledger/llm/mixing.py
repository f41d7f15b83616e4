"""Mixing of sources to target weights, in blocks of fixed length.

Each source's texts, one after the other, are a stream of words that is packed into blocks of nearly equal length; a
small source gets smaller blocks. Targets fix each source's whole number of slots. Every output shard has the same
number of slots, give or take one; what sources hold in them is a multinomial draw under the condition that it adds up to those
numbers. The slots of a source, counted over all shards, walk through a pseudorandom permutation of its blocks,
and start over when the blocks are used up. Slots and blocks meet in a join on the block's index.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refledger.llm.common import free_name, n_words, quoted
from refledger.sources.workspace import cut

FEWEST = 16  # blocks of a source at least, as far as it has as many words
RUN = 1 << 16  # numbers that one row is unfolded into at most
RUNS = 64  # such rows a task


@dataclass(frozen=True)
class Share:
    """A source's name (None for null), size in words, target in words, and its number of blocks and of slots."""

    source: str | None
    size: int
    target: float
    blocks: int
    slots: int


def cyclic(weights: Sequence[float]) -> Callable[[int, str | None], float]:
    """Weights that repeat over the sources in their order."""
    return lambda i, source: weights[i % len(weights)]


def targets(sizes: Mapping[str | None, int], weight: Callable[[int, str | None], float], total: float, cap: float) -> dict[str | None, float]:
    """Shares of `total` by weight, none above `cap` times its source's size; the excess is shared again by weight.

    Sources stand in code point order, null last. Nothing is reshared once all are at their caps.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: weight(i, s) for i, s in enumerate(order)}
    given: dict[str | None, float] = {}
    free, rest = set(order), float(total)
    while free:
        per = rest / sum(weights[s] for s in order if s in free)
        full = [s for s in order if s in free and per * weights[s] > cap * sizes[s]]
        if not full:
            given |= {s: per * weights[s] for s in order if s in free}
            break
        for s in full:
            given[s] = float(cap * sizes[s])
            rest -= given[s]
        free -= set(full)
    return {s: given[s] for s in order}


@dataclass(frozen=True)
class Plan:
    shares: tuple[Share, ...]
    shards: int

    @property
    def fixed(self) -> list[int]:
        """Slots of each source that every shard has."""
        return [s.slots // self.shards for s in self.shares]

    def sources(self, spark: SparkSession) -> DataFrame:
        """The shares as a table, one row per source: `src` is its number; `fixed` slots from `begin` on in every shard,
        and `drawn` slots of all shards together, from `drawn_begin` on."""
        drawn = [s.slots - self.shards * f for s, f in zip(self.shares, self.fixed)]
        starts = zip(accumulate(self.fixed, initial=0), accumulate(drawn, initial=0))
        rows = [(i, s.source, s.size, s.target, s.blocks, s.slots, f, b, d, e) for i, (s, f, d, (b, e)) in enumerate(zip(self.shares, self.fixed, drawn, starts))]
        return spark.createDataFrame(
            rows, "src int, source string, source_size long, target double, blocks long, slots long, fixed long, begin long, drawn long, drawn_begin long"
        )


def share_of(source: str | None, size: int, target: float, block: int, cap: int) -> Share:
    """Blocks are of `block` words at most, and there are `FEWEST` at least, so a target is met within half a block."""
    blocks = max(-(-size // block), min(size, FEWEST))
    return Share(source, size, target, blocks, min(cap * blocks, round(target * blocks / size)) if size else 0)


def plan(docs: DataFrame, weight: Callable[[int, str | None], float], *, share: float, cap: int, block: int, slots: int) -> Plan:
    """Sizes, targets and the number of output shards; `docs` has `source` and `size`.

    Only one row per source reaches the driver: sources are what the weights are given for.
    """
    sums = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    given = targets(sums, weight, share * sum(sums.values()), cap)
    shares = tuple(share_of(s, sums[s], given[s], block, cap) for s in given)
    return Plan(shares, max(1, -(-sum(s.slots for s in shares) // slots)))


def _unfolded(sources: DataFrame, n: str, total: int, name: str) -> DataFrame:
    """A row for each number from 0 to `n` - 1 of each source, in tasks whose number grows with the `total`."""
    number, run = F.col(n), F.col("__run")
    runs = sources.where(number > 0).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((number - 1) / RUN))))
    runs = runs.repartition(max(1, -(-total // (RUN * RUNS))), "src", "__run")
    return runs.withColumn(name, F.explode(F.sequence(run * RUN, F.least(number, (run + 1) * RUN) - 1))).drop("__run")


def merged(side: DataFrame) -> DataFrame:
    """A side of a join whose rows, or those that it meets, are unfolded from few: both sides are shuffled, whatever they seem to hold.

    Spark takes unfolded rows for as many as they were before, and would send millions of slots or blocks through the driver.
    """
    return side.hint("merge")


def _shuffled(rows: DataFrame, group: str, order: list[str], seed: int) -> DataFrame:
    """Adds `place`, from 0 without gaps in each group, in the order of a hash.

    Rows are ranked within 4096 ranges of the hash, so no group is sorted in one task.
    """
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), *order)).withColumn("__range", F.shiftrightunsigned("__h", 52))
    counts = rows.groupBy(group, "__range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__i", F.row_number().over(Window.partitionBy(group, "__range").orderBy("__h", *order)))
    placed = ranked.join(merged(before), [group, "__range"]).withColumn("place", F.col("__before") + F.col("__i") - 1)
    return placed.drop("__h", "__range", "__before", "__i")


def draw(sources: DataFrame, p: Plan, seed: int = 0) -> DataFrame:
    """Slots of all shards: `shard`, `slot`, `src`, `turn` (its count in the source), `blocks` (the source's).

    Of each shard's slots, the whole part of a source's expected number is fixed. What remains of all sources is put in
    the order of a hash and dealt out to the shards in turn: draws from an urn that holds each source's remaining slots,
    so every source gets its number over all shards, and nothing is drawn that it has no block for.
    """
    all_ = _unfolded(sources, "slots", sum(s.slots for s in p.shares), "turn")
    sure = F.col("fixed") * p.shards
    fixed = all_.where(F.col("turn") < sure).select(
        F.floor(F.col("turn") / F.col("fixed")).alias("shard"), (F.col("begin") + F.pmod("turn", "fixed")).alias("slot"), "src", "turn", "blocks"
    )
    urn = all_.where(F.col("turn") >= sure).select("src", "turn", "blocks", F.lit(0).alias("urn"))
    drawn = _shuffled(urn, "urn", ["src", "turn"], seed).select(
        F.pmod("place", F.lit(p.shards)).alias("shard"), (F.floor(F.col("place") / p.shards) + sum(p.fixed)).alias("slot"), "src", "turn", "blocks"
    )
    return fixed.unionByName(drawn)


def permutation(sources: DataFrame, p: Plan, seed: int = 0) -> DataFrame:
    """Per source, its blocks in the order of a hash: `src`, `block`, `place` (from 0 without gaps)."""
    blocks = _unfolded(sources, "blocks", sum(s.blocks for s in p.shares), "block").select("src", "block")
    return _shuffled(blocks, "src", ["src", "block"], seed)


def slots_to_blocks(slots: DataFrame, sources: DataFrame, p: Plan, seed: int = 0) -> DataFrame:
    """Adds each slot's `block`: the next one of the permutation, from its start again after the last."""
    placed = slots.withColumn("place", F.pmod("turn", "blocks")).join(merged(permutation(sources, p, seed)), ["src", "place"])
    return placed.select("shard", "slot", "src", "turn", "block")


def pieces(docs: DataFrame) -> DataFrame:
    """The documents cut at block edges: `row`, `src`, `block`, `begin` and `words`, counted within the document.

    `docs` has `row`, `src`, `size`, `start`, the place of its first word in its source's stream, and the source's
    `source_size` and `blocks`. Blocks differ by one word at most, and the longer ones come first.
    """
    some = docs.where("size > 0").withColumn("__low", F.expr("source_size DIV blocks")).withColumn("__more", F.pmod("source_size", "blocks"))
    low, more = F.col("__low"), F.col("__more")

    def holding(word: Column) -> Column:
        inside = more * (low + 1)
        return F.when(word < inside, F.floor(word / (low + 1))).otherwise(more + F.floor((word - inside) / low))

    def first_word(block: Column) -> Column:
        return block * low + F.least(block, more)

    end = F.col("start") + F.col("size")
    cut_up = some.withColumn("block", F.explode(F.sequence(holding(F.col("start")), holding(end - 1))))
    lo, hi = F.greatest("start", first_word(F.col("block"))), F.least(end, first_word(F.col("block") + 1))
    return cut_up.select("row", "src", "block", (lo - F.col("start")).alias("begin"), (hi - lo).alias("words"))


@dataclass(frozen=True)
class Mixture:
    """`rows`: one per document row; `slots`: shard, slot, src, turn, block; `pieces`: row, src, block, begin, words."""

    plan: Plan
    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def placed(self) -> DataFrame:
        """What stands where in the output: shard, slot, and the pieces of documents that fill it."""
        return self.slots.join(merged(self.pieces), ["src", "block"]).select("shard", "slot", "row", "begin", "words")

    def taken(self) -> DataFrame:
        """`row` and the number of its words that the mix holds, repeats counted."""
        times = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        return self.pieces.join(merged(times), ["src", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def _place(key: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def mix(
    docs: DataFrame,
    weight: Callable[[int, str | None], float],
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    share: float = 1.5,
    cap: int = 2,
    block: int = 128,
    slots: int = 4096,
    seed: int = 0,
) -> Mixture:
    """A mixture of `share` times all words, in which no document appears more than `cap` times.

    Each source's words in it are within about half a block of its target, and a block has `block` words at most, or a
    sixteenth of the source if that is less.

    Sizes are words between ASCII white space; null texts and texts without words have size 0, take no slot
    and have nothing taken. A null source is a source of its own. Rows are told apart by `row`, a number given
    along key, source and text's hash, so repeated rows each take part. An empty table gives an empty mix. Only
    the named columns are read.
    """
    read = docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
        _place(key, text).alias("place"),
    )
    read = cut(read, "mix-sizes")
    p = plan(read, weight, share=share, cap=cap, block=block, slots=slots)
    sources = cut(p.sources(docs.sparkSession), "mix-sources")
    # Equal rows are counted before they are ordered, so that one key with much of the table is one row here. Streams run in
    # the order of a hash, in chunks of its prefix, so that a source of any size is never in one task.
    kinds = read.groupBy("key", "source", "size", "place").agg(F.count("*").alias("copies"))
    kinds = kinds.join(sources.select(F.col("source").alias("__source"), "src", "source_size", "target", "blocks"), F.col("source").eqNullSafe(F.col("__source")))
    kinds = kinds.drop("__source").withColumn("chunk", F.substring("place", 1, 3)).withColumn("words", F.col("size") * F.col("copies"))
    kinds = cut(kinds, "mix-kinds")
    sums = kinds.groupBy("src", "chunk").agg(F.sum("words").alias("s"), F.sum("copies").alias("c"))
    earlier = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("src", "chunk", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "sc"])
    within = Window.partitionBy("src", "chunk").orderBy("place", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    kinds = kinds.select("*", F.sum("words").over(within).alias("s1"), F.sum("copies").over(within).alias("c1")).join(before, ["src", "chunk"])
    kinds = kinds.withColumn("start", F.col("s0") + F.col("s1") - F.col("words")).withColumn("number", F.col("c0") + F.col("c1") - F.col("copies"))
    few, many = kinds.where(F.col("copies") <= RUN), kinds.where(F.col("copies") > RUN)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN)))
    spread = many.withColumn("run", run).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "place", "run")
    of_run = F.explode(F.sequence(F.col("run") * RUN, F.least("copies", (F.col("run") + 1) * RUN) - 1))
    rows = few.withColumn("copy", copy).unionByName(spread.withColumn("copy", of_run).drop("run")).select(
        "key", "source", "src", "size", "place", "source_size", "target", "blocks",
        F.concat_ws("-", "src", (F.col("number") + F.col("copy")).cast("string")).alias("row"),
        (F.col("start") + F.col("copy") * F.col("size")).alias("start"),
    )
    rows = cut(rows, "mix-rows")
    return Mixture(p, rows, slots_to_blocks(draw(sources, p, seed), sources, p, seed), pieces(rows))


def mixed_documents(m: Mixture, key: str = "doc_id") -> DataFrame:
    """Per document row: key, `size`, `source_size`, `target` of its source, and `taken`."""
    rows = m.rows.join(merged(m.taken()), "row", "left")
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeated(docs: DataFrame, m: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents themselves, as often as the mix takes them: `taken` over `size`, rounded.

    A document of which the mix takes any word stays at least once; one of which it takes none goes. Columns of any name
    and type come out as they went in.
    """
    place, times, copy = (free_name(n, docs.columns) for n in ("__place", "__times", "__copy"))
    rows = m.rows.join(merged(m.taken()), "row", "left").groupBy("place").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    often = rows.where("t > 0").select(F.col("place").alias(place), F.greatest(F.lit(1), F.round(F.col("t") / F.col("s"))).cast("int").alias(times))
    met = docs.withColumn(place, _place(key, text)).join(often, place)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*quoted(docs.columns))
