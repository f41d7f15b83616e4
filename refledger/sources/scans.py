"""Strict scans of delivered files, and checks of their manifest, bytes and version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from threading import Lock

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refledger.operators.contracts import violations
from refledger.sources import sha_state
from refledger.sources.workspace import cut

# --- Fixed values: the manifest's tag ------------------------------------------------------------
MANIFEST_SCHEMA = "storage-manifest/v1"
ENTRY_KEYS = ("declaredName", "sha256", "bytes", "recordCount")
# -------------------------------------------------------------------------------------------------

MANIFEST = (
    "schema STRING, datasetVersion STRING, effectiveFrom STRING, effectiveTo STRING, revoked BOOLEAN,"
    " files ARRAY<STRUCT<declaredName: STRING, sha256: STRING, bytes: BIGINT, recordCount: BIGINT>>"
)


# Tasks that list the folders of one read: each sends its files' names to the driver, with a record of itself.
LISTERS = 64
_LISTING = Lock()


@contextmanager
def _few_listers(spark: SparkSession) -> Iterator[None]:
    """By default Spark lists up to ten thousand folders with a task each. One thread lists at a time, so that each finds the setting as it was."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    with _LISTING:
        before = spark.conf.get(name)
        spark.conf.set(name, LISTERS)
        try:
            yield
        finally:
            spark.conf.set(name, before)


def scan_csv_strict(
    spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = False, blanks: bool = False, nested: bool = False
) -> DataFrame:
    """CSV with exactly these headers in this order; any malformed row stops the job.

    Files without line feeds inside quotes stay splittable; `multi_line=True` reads each file whole.
    Spark reads an empty field as NULL; with `blanks=True` it becomes an empty text again. With `nested=True` the files
    of all folders under `path` are read.
    """
    # With pruning, a query that reads few columns, or counts, never sees what is wrong in the others.
    with _few_listers(spark):
        rows = spark.read.schema(schema).option("columnPruning", False).csv(
            path,
            header=True,
            enforceSchema=False,
            mode="FAILFAST",
            multiLine=multi_line,
            escape='"',
            unescapedQuoteHandling="RAISE_ERROR",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            recursiveFileLookup=nested,
        )
    return rows.na.fill("") if blanks else rows


def scan_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType, *, nested: bool = False) -> DataFrame:
    """One JSON object per line with exactly the declared fields; any other line stops the job. `nested` as for CSV."""
    declared = F.array_sort(F.array(*[F.lit(f.name) for f in schema.fields]))
    with _few_listers(spark):
        lines = spark.read.text(path, recursiveFileLookup=nested)
    # from_json keeps null for a missing key, so the key set is tested on the raw line.
    exact = F.array_sort(F.json_object_keys("value")).eqNullSafe(declared)
    fault = F.raise_error(F.concat(F.lit("not exactly the declared fields: "), F.col("value")))
    # A filter on every row: a query that reads no column of it still meets the fault.
    rows = lines.where(F.when(exact, F.lit(True)).otherwise(fault.cast("boolean")))
    parsed = rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.where("row IS NOT NULL").select("row.*")


def ends_with_newline(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Violations: files whose last byte is no line feed."""
    files = spark.read.format("binaryFile").load(path)
    last = F.substring("content", -1, 1)
    return violations(files.where(last != F.lit(b"\n")), "final_newline", dataset, F.col("path"), F.lit("missing"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests, one per file, with `odd_keys`: names of file entries that do not have exactly the declared keys."""
    text = spark.read.text(path, wholetext=True).select("value")
    rows = text.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("row"), F.get_json_object("value", "$.files").alias("raw"))
    # Values of an entry as text: a map keeps keys that a schema would drop unseen.
    entries = F.from_json("raw", "array<map<string, string>>")
    exact = lambda e: F.array_sort(F.map_keys(e)) == F.array(*[F.lit(k) for k in sorted(ENTRY_KEYS)])
    odd = F.transform(F.filter(entries, lambda e: ~exact(e)), lambda e: F.coalesce(F.try_element_at(e, F.lit("declaredName")), F.lit("")))
    return rows.select("row.*", F.coalesce(odd, F.array().cast("array<string>")).alias("odd_keys"))


def check_manifest(
    manifest: DataFrame,
    expected: DataFrame,
    version: str,
    effective_from: str,
    effective_to: str | None = None,
) -> DataFrame:
    """Violations of one manifest against the files that are authorised.

    `expected`: declaredName, sha256, bytes, recordCount; one row per authorised file.
    """
    heads = {
        "schema": F.col("schema").eqNullSafe(MANIFEST_SCHEMA),
        "version": F.col("datasetVersion").eqNullSafe(version),
        "effective_from": F.col("effectiveFrom").eqNullSafe(effective_from),
        "revoked": F.col("revoked").eqNullSafe(False),
    }
    if effective_to is not None:
        heads["effective_to"] = F.col("effectiveTo").eqNullSafe(effective_to)
    broken = F.filter(F.array(*[F.when(~ok, name) for name, ok in heads.items()]), lambda n: n.isNotNull())
    head_rows = manifest.select(F.explode(broken).alias("rule"))
    declared = manifest.select(F.inline("files"))
    repeated = declared.groupBy("declaredName").agg(F.count("*").alias("n")).where("n > 1")
    a = declared.select("declaredName", F.struct("sha256", "bytes", "recordCount").alias("was"))
    b = expected.select("declaredName", F.struct("sha256", "bytes", "recordCount").alias("due"))
    odd = a.join(b, "declaredName", "full").where(~F.col("was").eqNullSafe(F.col("due")))
    detail = (
        F.when(F.col("was").isNull(), "missing").when(F.col("due").isNull(), "not authorised").otherwise("differs")
    )
    return (
        violations(head_rows, "manifest", version, F.lit(""), F.col("rule"))
        .unionByName(violations(manifest.select(F.explode("odd_keys").alias("name")), "manifest_keys", version, F.col("name"), F.lit("not the declared keys")))
        .unionByName(violations(repeated, "manifest_repeat", version, F.col("declaredName"), F.col("n")))
        .unionByName(violations(odd, "manifest_file", version, F.col("declaredName"), detail))
    )


def fingerprint(spark: SparkSession, path: str | Sequence[str], name: Column | None = None, *, whole: int = 128 << 20) -> DataFrame:
    """SHA-256 and size of each file, named by the end of its path or by `name`, an expression over `path`.

    Spark reads files of up to `whole` bytes as one value. Larger ones are hashed range by range, as by
    `streamed_fingerprint` but with other ranges; where pyarrow does not open the store, they are one value too, so
    files over 2 GB are out of reach there.
    """
    files = spark.read.format("binaryFile").load(path)
    own = F.element_at(F.split("path", "/"), -1) if name is None else name
    value = lambda rows: rows.select("path", "length", F.sha2("content", 256).alias("sha256"))
    # The length alone tells Spark which files not to read.
    large = files.where(F.col("length") > whole).select("path", "length")
    if large.isEmpty() or not large.mapInArrow(_openable, "path string, opens boolean").where("NOT opens").isEmpty():
        told = value(files)
    else:
        told = value(files.where(F.col("length") <= whole)).unionByName(_in_turns(large, RANGE // 4 * 3))
    return told.select(own.alias("name"), "sha256", F.col("length").alias("bytes"))


CHUNK, FANOUT, BLOCK = 64 << 20, 1024, 4 << 20
# What one task reads of a file whose hash other tasks carry on; a multiple of `sha_state.STEP`.
RANGE = 256 << 20


def _opened(path: str):
    if path.startswith("file:"):
        return LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    filesystem, place = FileSystem.from_uri(path)
    return filesystem.open_input_file(place)


def _openable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                _opened(path).close()
                opens = True
            except (OSError, ValueError, ImportError, NotImplementedError):
                opens = False
            yield pa.RecordBatch.from_pylist([{"path": path, "opens": opens}])


def _blocks(stream, size: int) -> Iterator[bytes]:
    """The next `size` bytes, a block at a time."""
    left = size
    while left > 0:
        block = stream.read(min(BLOCK, left))
        if not block:
            raise OSError("a file ended early")
        yield block
        left -= len(block)


def _hashed(stream, size: int) -> bytes:
    """SHA-256 of the next `size` bytes."""
    out = hashlib.sha256()
    for block in _blocks(stream, size):
        out.update(block)
    return out.digest()


def _ranges_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, number, since, size) to their digests; a range is read in blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            with _opened(row["path"]) as stream:
                stream.seek(row["since"])
                digest = _hashed(stream, row["size"])
            yield pa.RecordBatch.from_pylist([{"path": row["path"], "number": row["number"], "sha256": digest}], pa.schema([("path", pa.string()), ("number", pa.int64()), ("sha256", pa.binary())]))


_TURN = pa.schema([("path", pa.string()), ("length", pa.int64()), ("since", pa.int64()), ("state", pa.binary()), ("sha256", pa.string())])


def _turn(reach: int):
    """Files to their next `reach` bytes: the state after these, or the digest after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                end = min(row["since"] + reach, row["length"])
                with _opened(row["path"]) as stream:
                    if (library := sha_state.library()) is None:
                        # No states here: this task reads the whole file.
                        told = {"since": row["length"], "state": None, "sha256": _hashed(stream, row["length"]).hex()}
                    else:
                        out = sha_state.Sha256(library, row["state"], row["since"])
                        stream.seek(row["since"])
                        for block in _blocks(stream, end - row["since"]):
                            out.update(block)
                        ended = end == row["length"]
                        told = {"since": end, "state": None if ended else out.state(), "sha256": out.digest().hex() if ended else None}
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "length": row["length"], **told}], _TURN)

    return run


def _in_turns(files: DataFrame, reach: int) -> DataFrame:
    """SHA-256 of large files: path, length, sha256.

    SHA-256 runs from a file's first byte to its last, so a file's ranges come one after the other, but a task reads only
    one of them and hands the hash's state to the next. All files take their turns side by side.
    """
    zero = F.lit(0).cast("long").alias("since")
    left, ended = files.select("path", "length", zero, F.lit(None).cast("binary").alias("state")), []
    n = left.count()
    while n:
        dealt = left.repartitionByRange(min(n, 100_000), "path")
        told = cut(dealt.mapInArrow(_turn(reach), "path string, length long, since long, state binary, sha256 string"), "hash-states")
        left, before = told.where("sha256 IS NULL").drop("sha256"), n
        n = left.count()
        if n < before:
            ended.append(told.where("sha256 IS NOT NULL").select("path", "length", "sha256"))
    return reduce(DataFrame.unionByName, ended)


def _tree(ranges: DataFrame, fanout: int) -> DataFrame:
    """(path, tree): digests of a file's ranges, `fanout` of them at a time, until one is left; `top` is its last number."""
    done, nodes, most = None, ranges, ranges.agg(F.max("top")).first()[0] or 0
    while True:
        parent = F.floor(F.col("number") / fanout).alias("number")
        runs = F.transform(F.sort_array(F.collect_list(F.struct("number", "sha256"))), lambda n: F.lower(F.hex(n["sha256"])))
        held = nodes.groupBy("path", parent).agg(F.unhex(F.sha2(F.array_join(runs, ""), 256)).alias("sha256"), F.floor(F.max("top") / fanout).alias("top"))
        ended = held.where("top = 0").select("path", F.lower(F.hex("sha256")).alias("tree"))
        done = ended if done is None else done.unionByName(ended)
        nodes, most = held.where("top > 0"), most // fanout
        if not most:
            return done


def listed_files(spark: SparkSession, path: str | Sequence[str], *, nested: bool = False) -> DataFrame:
    """Path and length of files; their content is not read. Spark lists no empty files. `nested` as for CSV."""
    with _few_listers(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", nested).load(path).select("path", "length")


def file_trees(spark: SparkSession, path: str | Sequence[str], *, chunk: int = CHUNK, fanout: int = FANOUT) -> DataFrame:
    """Per file: path, `bytes`, `tree`: a digest over the SHA-256 of its byte ranges, for files of any size.

    Ranges of `chunk` bytes are tasks of their own, read in blocks, so one huge file keeps a whole cluster busy and no
    task holds more than a block. Digests of `fanout` ranges are hashed into one until one is left.
    The digest depends on `chunk` and `fanout`, so both belong to a pin.
    """
    files = cut(listed_files(spark, path), "file-list")
    last = F.greatest(F.ceil(F.col("length") / chunk) - 1, F.lit(0))
    ranges = files.select("path", "length", last.alias("top"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"))
    since = F.col("number") * chunk
    ranges = ranges.select("path", "top", "number", since.alias("since"), F.least(F.lit(chunk), F.col("length") - since).alias("size"))
    # A few ranges a task, whatever files they are of.
    parts = max(1, min(100_000, ranges.count()))
    digests = ranges.repartition(parts, "path", "number").mapInArrow(_ranges_hashed, "path string, number long, sha256 binary")
    digests = cut(digests, "range-digests").join(files.select("path", last.alias("top")), "path")
    return files.join(_tree(digests, fanout), "path").select("path", F.col("length").alias("bytes"), "tree")


def streamed_fingerprint(
    spark: SparkSession, path: str | Sequence[str], name: Column | None = None, *, nested: bool = False, reach: int = RANGE
) -> DataFrame:
    """The rows of `fingerprint` for files of any size, read in blocks, of which a task never holds more than one.

    Small files share tasks. Of a file over CHUNK a task reads `reach` bytes at most and goes on from the hash's state
    after the bytes before. The store must be one that pyarrow opens (file, hdfs, s3, gs); elsewhere use `fingerprint`.
    """
    files = cut(listed_files(spark, path, nested=nested), "file-list")
    large, small = files.where(F.col("length") > min(CHUNK, reach)), files.where(F.col("length") <= min(CHUNK, reach))
    whole = small.select("path", F.lit(0).cast("long").alias("number"), F.lit(0).cast("long").alias("since"), F.col("length").alias("size"))
    size = small.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    parts = max(1, min(size.n, 100_000, max(4 * spark.sparkContext.defaultParallelism, -(-size.bytes // CHUNK))))
    digests = whole.repartition(parts, "path").mapInArrow(_ranges_hashed, "path string, number long, sha256 binary")
    told = small.join(digests, "path").select("path", "length", F.lower(F.hex("sha256")).alias("sha256"))
    if not large.isEmpty():
        told = told.unionByName(_in_turns(large, reach))
    own = F.element_at(F.split("path", "/"), -1) if name is None else name
    return told.select(own.alias("name"), "sha256", F.col("length").alias("bytes"))


def compare_fingerprints(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """(name, finding) of each file whose digest or size is not as pinned, is not pinned, or is missing.

    `pinned` holds name, sha256, bytes: of a manifest, of a pin, or of both checked one after the other.
    """
    a = files.select("name", F.struct("sha256", "bytes").alias("own"))
    b = pinned.select("name", F.struct("sha256", "bytes").alias("due"))
    finding = (
        F.when(F.col("own").isNull(), "missing").when(F.col("due").isNull(), "not pinned")
        .when(~F.col("own.sha256").eqNullSafe(F.col("due.sha256")), "sha256").when(~F.col("own.bytes").eqNullSafe(F.col("due.bytes")), "bytes")
    )
    return a.join(b, "name", "full").select("name", finding.alias("finding")).where("finding IS NOT NULL")


def dataset_digest(files: DataFrame, group: Sequence[str], name: str = "name", sha: str = "sha256") -> DataFrame:
    """Hash of a dataset's file hashes joined in name order. A dataset lists its files in one manifest."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(sha).alias("h")))), lambda f: f["h"])
    return files.groupBy(*group).agg(
        F.sha2(F.array_join(hashes, ""), 256).alias("digest"), F.count("*").alias("n_files")
    )


def has_token(col: Column, tokens: Sequence[str], sep: str = ",") -> Column:
    """Does the separated list hold one of the tokens exactly?"""
    return F.arrays_overlap(F.split(col, sep), F.array(*[F.lit(t) for t in tokens]))


def filter_has_token(df: DataFrame, col: str, tokens: Sequence[str]) -> DataFrame:
    return df.where(has_token(F.col(col), tokens))


def filter_token_or_listed(df: DataFrame, col: str, tokens: Sequence[str], listed: DataFrame, key: str) -> DataFrame:
    """Rows with a wanted token, or whose key is on the list."""
    marks = listed.select(key).distinct().withColumn("__listed", F.lit(True))
    kept = df.join(marks, key, "left").where(has_token(F.col(col), tokens) | F.col("__listed"))
    return kept.drop("__listed")


