"""Versions of a dataset that know what changed between them, without reading it all.

A row belongs to a leaf, the top bits of a hash of its key, and a folder holds the leaves that share their first bits.
A leaf's digest is the sum of its rows' hashes, so it does not depend on order, and the digest of any node above is
the sum of those below. Digests are stored with the version. Two versions are compared by their digests first; only
leaves that differ are read from either.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from refledger.operators.reconcile import snapshot_diff
from refledger.sources.publish import VERSION, _move, drift

FOLDER, LEAF = "__folder", "__leaf"
PARTS = ("p0", "p1", "p2", "p3")
LAYOUT = ("key", "folder_bits", "leaf_bits")
# Rows as text: whole microseconds and a fixed zone, so that equal rows have equal texts in any session.
AS_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


class Version(NamedTuple):
    """`rows` with their `__folder` and `__leaf`; `digests`: leaf, n_rows, p0 to p3; `root`: their sums, schema and layout."""

    rows: DataFrame
    digests: DataFrame
    root: Row

    def plain(self) -> DataFrame:
        return self.rows.drop(FOLDER, LEAF)


def _quoted(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def laid_out(rows: DataFrame, key: str, folder_bits: int, leaf_bits: int) -> DataFrame:
    """The rows with the leaf that their key's hash names, and its folder."""
    leaf = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 64 - leaf_bits).cast("int")
    return rows.withColumn(LEAF, leaf).withColumn(FOLDER, F.shiftright(LEAF, leaf_bits - folder_bits))


def leaf_digests(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """leaf, n_rows and four sums: 240 bits of each row's SHA-256, 60 in a sum. Sums are partly made before the shuffle."""
    text = F.to_json(F.struct(*_quoted(columns)), AS_TEXT)
    part = lambda i: F.conv(F.substring("__sha", 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")
    hashed = rows.select(F.col(LEAF).alias("leaf"), F.sha2(text, 256).alias("__sha"))
    return hashed.groupBy("leaf").agg(F.count("*").alias("n_rows"), *[F.sum(part(i)).alias(p) for i, p in enumerate(PARTS)])


def _rows(spark: SparkSession, place: str, schema: StructType) -> DataFrame:
    """What was written, by a known schema: a table without rows has no files to tell it."""
    own = [StructField(n, IntegerType()) for n in (LEAF, FOLDER)]
    return spark.read.schema(StructType([*schema.fields, *own])).parquet(f"{place}/rows")


def _read(spark: SparkSession, place: str) -> Version:
    root = spark.read.parquet(f"{place}/root").first()
    schema = StructType.fromJson(json.loads(root["columns"]))
    return Version(_rows(spark, place, schema), spark.read.parquet(f"{place}/digests"), root)


def read_keyed(spark: SparkSession, path: str, version: str) -> Version:
    """A version that `publish_keyed` wrote, by the schema that it was published with, also if it has no rows."""
    return _read(spark, f"{path}/{VERSION}={version}")


def _types(v: Version) -> list:
    return [(f.name, f.dataType) for f in v.plain().schema]


def comparable(old: Version, new: Version) -> bool:
    """Whether leaves of one version are leaves of the other: same columns, key and bits."""
    return _types(old) == _types(new) and all(old.root[c] == new.root[c] for c in LAYOUT)


def _same_root(old: Version, new: Version) -> bool:
    return all(old.root[c] == new.root[c] for c in ("n_rows", *PARTS))


def changed_leaves(old: Version, new: Version) -> DataFrame:
    """Leaves that hold other rows in one version than in the other, by their digests alone."""
    body = F.struct("n_rows", *PARTS)
    a = old.digests.select("leaf", body.alias("was"))
    b = new.digests.select("leaf", body.alias("now"))
    return a.join(b, "leaf", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("leaf")


class Changed(NamedTuple):
    """The rows of either version in leaves that differ, and those of the new one in leaves that do not."""

    old: DataFrame
    new: DataFrame
    untouched: DataFrame


def only_changed(old: Version, new: Version) -> Changed:
    """Both versions cut down to the leaves that differ: others' folders are not opened.

    Leaf numbers are at most two to the number of leaf bits, whatever the data; they are what reaches the driver. Versions
    that are not comparable are read whole.
    """
    if not comparable(old, new):
        return Changed(old.plain(), new.plain(), new.plain().limit(0))
    leaves = [] if _same_root(old, new) else [r["leaf"] for r in changed_leaves(old, new).collect()]
    shift = new.root["leaf_bits"] - new.root["folder_bits"]
    folders = sorted({leaf >> shift for leaf in leaves})
    inside = F.col(FOLDER).isin(folders) & F.col(LEAF).isin(sorted(leaves))
    return Changed(*[v.rows.where(inside).drop(FOLDER, LEAF) for v in (old, new)], new.rows.where(~inside).drop(FOLDER, LEAF))


def keyed_diff(old: Version, new: Version, key: str, *, same: bool = False) -> DataFrame:
    """Each key as added, removed or changed, from the leaves that differ.

    With `same`, keys that did not change as well: of leaves that are equal only the key's column is read. Keys are
    unique within a version and not null.
    """
    part = only_changed(old, new)
    found = snapshot_diff(part.old, part.new, key)
    if not same:
        return found.where("change <> 'same'")
    return found.unionByName(part.untouched.select(key, F.lit("same").alias("change")))


def keyed_drift(old: Version, new: Version) -> DataFrame:
    """The rows of `drift` between two versions, repeated rows counted, from the leaves that differ."""
    part = only_changed(old, new)
    return drift(part.old, part.new)


def publish_keyed(df: DataFrame, path: str, version: str, key: str, *, folder_bits: int = 6, leaf_bits: int = 12) -> str:
    """Publish a version once, with its digests: "written", or "unchanged" if the same rows are there.

    Other rows under the same version are refused. Rows and digests move into place in one step. Rows of a folder are
    sorted by leaf, so files and row groups outside a leaf are skipped; folders that are much larger than others, as
    those of a hot key are, are split over several files by adaptive execution. `folder_bits` and `leaf_bits` fix two to
    that power of folders and leaves: 12 and 20 suit some hundred terabytes.
    """
    if not 0 <= folder_bits <= leaf_bits <= 24 or leaf_bits < 1:
        raise ValueError("folder_bits must not exceed leaf_bits, which lie between 1 and 24")
    if {FOLDER, LEAF} & set(df.columns):
        raise ValueError(f"{FOLDER} and {LEAF} are names of the layout")
    spark, target = df.sparkSession, f"{path}/{VERSION}={version}"
    staged = f"{path}/_staged/{version}-{uuid.uuid4().hex}"
    rows = laid_out(df, key, folder_bits, leaf_bits).hint("rebalance", FOLDER).sortWithinPartitions(FOLDER, LEAF)
    rows.write.mode("errorifexists").partitionBy(FOLDER).parquet(f"{staged}/rows")
    leaf_digests(_rows(spark, staged, df.schema), df.columns).coalesce(1).write.parquet(f"{staged}/digests")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", *PARTS)]
    told = {"key": key, "folder_bits": folder_bits, "leaf_bits": leaf_bits, "columns": df.schema.json()}
    root = spark.read.parquet(f"{staged}/digests").agg(*sums).select("*", *[F.lit(v).alias(n) for n, v in told.items()])
    root.write.parquet(f"{staged}/root")
    if _move(spark, staged, target):
        return "written"
    there, own = read_keyed(spark, path, version), _read(spark, staged)
    if comparable(there, own):
        same = _same_root(there, own) and not changed_leaves(there, own).limit(1).collect()
    else:
        same = _types(there) == _types(own) and not drift(there.plain(), own.plain()).limit(1).collect()
    if not same:
        raise ValueError(f"version {version} is published with other content")
    return "unchanged"
