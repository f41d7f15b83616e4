"""Merkle manifest of a dataset: one digest tree per group, one over the groups, and a proof for every record.

Trees are built bottom up, several levels in one shuffle: consecutive nodes of one ancestor meet in a row of a few
hundred digests and become nodes there. Proofs are made by pointer jumping. At first every node below a root holds
the siblings towards its parent. Each round joins the nodes with themselves: a node whose segment reaches an ancestor
appends that ancestor's segment, so the distance doubles until every leaf holds the whole way to its root.

A digest is the hex text of a SHA-256; segments hold the same bytes at half the size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.operators.prefix import ranked
from refledger.sources.workspace import cut

# Nodes that meet in one row while a tree is built, and ancestors that may be sent to all tasks (about 100 bytes a
# sibling each, for the siblings on their way).
BUNCH, FEW_NODES = 256, 1 << 14

STEP = "array<struct<left:binary,right:binary>>"


def record_digest(fields: Sequence[Column | str]) -> Column:
    """SHA-256 of the fields: `-` for null, else the UTF-8 byte count, a colon and the value as text."""

    def told(field: Column | str) -> Column:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)), 256)


def _hex(binary: Column) -> Column:
    return F.coalesce(F.lower(F.hex(binary)), F.lit(""))


def proof_digest(proof: Column) -> Column:
    """SHA-256 over all siblings of a proof, level by level, left to right; of nothing for an empty proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest (hex) leads to along a proof."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(_hex(s["left"]), acc, _hex(s["right"])), 256))


def _height(n: Column, run: int) -> Column:
    """Levels above the leaves until one node remains."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.pow(F.lit(float(run)), i) < n))


def _parents(level: str, run: int) -> Column:
    """Digests of the runs of `run` consecutive nodes, from the hex text of those nodes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / run).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(F.col(level), i * run + 1, run), ""), 256))


def _steps(level: str, run: int, width: int) -> Column:
    """Per node of a row's level: its place, and its siblings to the left and to the right, null where there are none."""

    def joined(start: Column, length: Column) -> Column:
        return F.when(length > 0, F.unhex(F.array_join(F.slice(F.col(level), start, length), "")))

    def step(_: Column, i: Column) -> Column:
        first = i - i % run
        last = F.least(first + run, F.size(level))
        return F.struct(
            (F.col("__top") * width + i).alias("at"), joined(first + 1, i - first).alias("left"), joined(i + 2, last - i - 1).alias("right")
        )

    return F.transform(F.col(level), step)


def _climb(leaves: DataFrame, run: int) -> tuple[DataFrame, DataFrame, int]:
    """Links (tree, level, at, left, right) of all nodes below a root, the roots (tree, root), and the greatest height.

    `leaves`: tree, height, at (from 0 without gaps per tree), digest (hex). A pass handles as many levels as make
    rows of at most BUNCH nodes.
    """
    depth = 1
    while run ** (depth + 1) <= BUNCH:
        depth += 1
    width = run**depth
    links, roots, level = [], [], 0
    top = leaves.agg(F.max("height")).first()[0] or 0
    nodes = leaves
    while True:
        held = nodes.groupBy("tree", "height", F.floor(F.col("at") / width).alias("__top")).agg(
            F.sort_array(F.collect_list(F.struct("at", "digest")))["digest"].alias("l0")
        )
        for i in range(depth):
            held = held.withColumn(f"l{i + 1}", _parents(f"l{i}", run))
        held = cut(held, "merkle-levels")
        for i in range(depth + 1):
            here = held.where(F.col("height") == level + i)
            roots.append(here.select("tree", F.col(f"l{i}")[0].alias("root")))
            if i < depth and level + i < top:
                step = held.where(F.col("height") > level + i).select("tree", F.explode(_steps(f"l{i}", run, run ** (depth - i))).alias("s"))
                links.append(step.select("tree", F.lit(level + i).alias("level"), "s.at", "s.left", "s.right"))
        nodes = held.where(F.col("height") > level + depth).select("tree", "height", F.col("__top").alias("at"), F.col(f"l{depth}")[0].alias("digest"))
        level += depth
        if level >= top:
            break

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # A tree whose height is a multiple of the depth has its root at the end of one pass, and not in the next.
    return all_of(links) if links else None, all_of(roots), top


def _jump(links: DataFrame, run: int, top: int) -> DataFrame:
    """Proof (tree, at, proof) of every leaf that lies below a root.

    After the round with distance d a node of level l holds the siblings of levels l to l + 2d - 1. Only nodes whose
    level is a multiple of the distance are asked again, so a round keeps little more than the leaves. Ancestors
    are sent to the tasks while they are few, by count; where they are many, each has few descendants.
    """
    held = links.select("tree", "level", "at", F.array(F.struct("left", "right")).alias("proof"))
    distance = 1
    while distance < top:
        low = held.where(F.col("level") % (2 * distance) == 0)
        high = held.where(F.col("level") % (2 * distance) == distance)
        high = high.select("tree", (F.col("level") - distance).alias("level"), F.col("at").alias("__up"), F.col("proof").alias("__more"))
        high = F.broadcast(high) if high.count() <= FEW_NODES else high.hint("merge")
        low = low.withColumn("__up", F.floor(F.col("at") / run**distance))
        grown = F.concat("proof", F.coalesce("__more", F.array().cast(STEP))).alias("proof")
        held = cut(low.join(high, ["tree", "level", "__up"], "left").select("tree", "level", "at", grown), "merkle-proofs")
        distance *= 2
    return held.where("level = 0").select("tree", "at", "proof")


def _proved(leaves: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """Proofs (tree, at, proof) of all leaves, and roots (tree, root)."""
    links, roots, top = _climb(leaves, run)
    alone = leaves.where("height = 0").select("tree", "at", F.array().cast(STEP).alias("proof"))
    return (alone.unionByName(_jump(links, run, top)) if links is not None else alone), roots


def manifest(docs: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "lang", *, also: dict[str, Column] | None = None, run: int = 2) -> DataFrame:
    """Per row: key, group, `leaf`, `subroot`, `root` (hex), `proof` (siblings level by level), and the columns of `also`.

    A leaf is the digest of `fields`. Per group, leaves ascend by key, nulls first and rows of one key by their digests;
    every `run` consecutive nodes become a node until one remains, the group's subroot. Subroots in the order of the
    groups, null first, become the root in the same way. A lone leaf is its own subroot, a lone subroot the root.
    Repeated rows are leaves of their own; a null group is a group. An empty table gives no rows. Other columns are not
    read, whatever their names.

    Leaves are numbered by ranges, so a group with most of the rows is dealt to many tasks; groups may be many.
    """
    given = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{group}`").alias("__of"), record_digest([F.col(f"`{c}`") for c in fields]).alias("leaf"), *[c.alias(n) for n, c in (also or {}).items()])
    # Equal rows are told apart by where they stood, so that ranges can part them.
    rows = cut(given.withColumn("__row", F.monotonically_increasing_id()), "merkle-leaves")
    trees = rows.groupBy("__of").agg(F.count("*").alias("n")).withColumn("height", _height(F.col("n"), run))
    trees = cut(ranked(trees, [], [F.asc_nulls_first("__of")], "tree"), "merkle-trees")
    few = trees.count()
    of_tree = trees.select(F.col("__of").alias("__tree_of"), "tree", "height")
    of_tree = F.broadcast(of_tree) if few <= FEW_NODES else of_tree
    at = ranked(rows, ["__of"], [F.asc_nulls_first("__key"), F.col("leaf"), F.col("__row")], "__at")
    at = at.join(of_tree, F.col("__of").eqNullSafe(F.col("__tree_of"))).drop("__tree_of").withColumn("at", F.col("__at") - 1)
    at = cut(at, "merkle-ranked")
    proofs, subroots = _proved(at.select("tree", "height", "at", F.col("leaf").alias("digest")), run)

    subroots = cut(subroots, "merkle-subroots")
    upper = subroots.select(F.lit(0).alias("tree"), _height(F.lit(few), run).alias("height"), (F.col("tree") - 1).alias("at"), F.col("root").alias("digest"))
    ways, roots = _proved(upper, run)
    ways = ways.select((F.col("at") + 1).alias("tree"), F.col("proof").alias("__way")).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    root = roots.first()
    ways = cut(ways.withColumn("root", F.lit(root["root"] if root else None).cast("string")), "merkle-ways")
    ways = F.broadcast(ways) if few <= FEW_NODES else ways
    proved = at.join(proofs, ["tree", "at"]).join(ways, "tree")
    return proved.select(
        F.col("__key").alias(key), F.col("__of").alias(group), "leaf", "subroot", "root", F.concat("proof", "__way").alias("proof"), *(also or {})
    )
