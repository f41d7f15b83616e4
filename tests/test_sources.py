from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from refledger.sources import scans, sha_state
from refledger.sources.publish import drift, publish, read_version

SCHEMA = StructType([StructField("a", StringType()), StructField("b", StringType())])


def scan(spark, tmp_path, body, **kw):
    path = tmp_path / "f.csv"
    path.write_text(body, encoding="utf8")
    return [tuple(r) for r in scans.scan_csv_strict(spark, str(path), SCHEMA, **kw).collect()]


def test_csv_quotes_newlines_blanks(spark, tmp_path):
    assert scan(spark, tmp_path, 'a,b\n"x ""q"" y",\n', blanks=True) == [('x "q" y', "")]
    assert scan(spark, tmp_path, 'a,b\n"x\ny",1\n', multi_line=True) == [("x\ny", "1")]


@pytest.mark.parametrize("body", ["b,a\n1,2\n", "a,b\n1,2,3\n", 'a,b\n"x"y,1\n', "a\n1\n"])
def test_csv_breach_stops(spark, tmp_path, body):
    with pytest.raises(Exception):
        scan(spark, tmp_path, body)


def test_jsonl_exact_fields(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('{"a":"1","b":null}\n{"b":"3","a":"2"}\n')
    assert [tuple(r) for r in scans.scan_jsonl_strict(spark, str(path), SCHEMA).collect()] == [("1", None), ("2", "3")]
    assert scans.ends_with_newline(spark, str(path), "d").count() == 0
    for bad in ('{"a":"1"}', '{"a":"1","b":"2","c":"3"}', "not json"):
        path.write_text(bad)
        with pytest.raises(Exception):
            scans.scan_jsonl_strict(spark, str(path), SCHEMA).collect()
    assert scans.ends_with_newline(spark, str(path), "d").count() == 1


def test_manifest(spark, tmp_path):
    entry = {"declaredName": "x.csv", "sha256": "s", "bytes": 3, "recordCount": 1}
    body = {"schema": "storage-manifest/v1", "datasetVersion": "v1", "effectiveFrom": "2026-09-01", "effectiveTo": "9999-12-31", "revoked": False, "files": [entry]}
    path = tmp_path / "m.json"

    def found(**edit):
        path.write_text(json.dumps(body | edit, indent=1))
        expected = spark.createDataFrame([("x.csv", "s", 3, 1)], "declaredName string, sha256 string, bytes long, recordCount long")
        rows = scans.check_manifest(scans.scan_manifest(spark, str(path)), expected, "v1", "2026-09-01", "9999-12-31").collect()
        return sorted((r.check_id, r.key, r.detail) for r in rows)

    assert found() == []
    assert found(revoked=True, schema="x") == [("manifest", "", "revoked"), ("manifest", "", "schema")]
    assert found(files=[]) == [("manifest_file", "x.csv", "missing")]
    assert found(files=[entry | {"bytes": 4}]) == [("manifest_file", "x.csv", "differs")]
    assert found(files=[entry, entry])[-1] == ("manifest_repeat", "x.csv", "2")
    assert found(files=[entry, entry | {"declaredName": "y"}]) == [("manifest_file", "y", "not authorised")]


def test_fingerprint_and_digest(spark, tmp_path):
    for name, body in (("b.txt", b"two"), ("a.txt", b"one")):
        (tmp_path / name).write_bytes(body)
    files = scans.fingerprint(spark, str(tmp_path))
    sha = {n: hashlib.sha256(b).hexdigest() for n, b in (("a.txt", b"one"), ("b.txt", b"two"))}
    assert {(r.name, r.sha256, r.bytes) for r in files.collect()} == {(n, h, 3) for n, h in sha.items()}
    digest = scans.dataset_digest(files.withColumn("d", F.lit(1)), ["d"]).first().digest
    assert digest == hashlib.sha256((sha["a.txt"] + sha["b.txt"]).encode()).hexdigest()


def test_publish_once(spark, tmp_path):
    df, other = spark.range(5).withColumn("x", F.lit("y")), spark.range(4).withColumn("x", F.lit("y"))
    path = str(tmp_path / "t")
    assert publish(df, path, "v1") == "written" and publish(df, path, "v1") == "unchanged"
    assert publish(other, path, "v2") == "written"
    with pytest.raises(ValueError):
        publish(other, path, "v1")
    assert publish(other, path, "v1", on_conflict="replace") == "replaced"
    assert read_version(other, path, "v1").count() == 4 and read_version(other, path, "v2").count() == 4
    assert read_version(other, path, "v3") is None


def test_drift_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in drift(a, b).collect()) == [(1, "published", 1), (2, "published", 1), (3, "derived", 1)]


def test_exact_token_is_no_substring(spark):
    df = spark.createDataFrame([("2.6.1,3",), ("2.6.10",), ("12.6.1",)], "s string")
    assert [r.s for r in scans.filter_has_token(df, "s", ["2.6.1"]).collect()] == ["2.6.1,3"]


# --- files of any size, and publishing that cannot be half done --------------------------------------


def tree_of(body, chunk, fanout):
    level = [hashlib.sha256(body[i : i + chunk]).hexdigest() for i in range(0, max(1, len(body)), chunk)]
    while True:
        level = [hashlib.sha256("".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
        if len(level) == 1:
            return level[0]


def test_trees_and_streams(spark, tmp_path):
    bodies = {"a b%20": b"x", "even": bytes(range(256)) * 4, "odd": bytes(range(251)) * 41}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    for chunk, fanout in ((256, 2), (100, 3), (1 << 20, 1024)):
        got = {r.path.rsplit("/", 1)[1]: r for r in scans.file_trees(spark, str(tmp_path), chunk=chunk, fanout=fanout).collect()}
        assert {n: (r.bytes, r.tree) for n, r in got.items()} == {n: (len(b), tree_of(b, chunk, fanout)) for n, b in bodies.items()}
    streamed = sorted(tuple(r) for r in scans.streamed_fingerprint(spark, str(tmp_path)).collect())
    assert streamed == sorted(tuple(r) for r in scans.fingerprint(spark, str(tmp_path)).collect())


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file, so it takes no room: three gigabytes of zeros with a few bytes at places that matter."""
    path, size = tmp_path / "big", 3 << 30
    with open(path, "wb") as f:
        f.truncate(size)
        for at in (0, (1 << 31) - 1, 1 << 31, size - 3):
            f.seek(at)
            f.write(b"abc")
    due, level = hashlib.sha256(), []
    with open(path, "rb") as f:
        while block := f.read(256 << 20):
            due.update(block)
            level.append(hashlib.sha256(block).hexdigest())
    (whole,) = scans.streamed_fingerprint(spark, str(path)).collect()
    assert (whole.bytes, whole.sha256) == (size, due.hexdigest())
    (tree,) = scans.file_trees(spark, str(path), chunk=256 << 20).collect()
    assert (tree.bytes, tree.tree) == (size, hashlib.sha256("".join(level).encode()).hexdigest())


def test_a_task_reads_one_range_of_a_file(spark, tmp_path, monkeypatch):
    bodies = {f"f{n}": bytes(i * 7 % 251 for i in range(n)) for n in (1, 64, 127, 128, 129, 256, 1000)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    due = sorted((n, hashlib.sha256(b).hexdigest(), len(b)) for n, b in bodies.items())
    for reach in (128, 384, 1 << 20):
        assert sorted(map(tuple, scans.streamed_fingerprint(spark, str(tmp_path), reach=reach).collect())) == due
    monkeypatch.setattr(scans, "RANGE", 256)
    for whole in (128, 1 << 20):
        assert sorted(map(tuple, scans.fingerprint(spark, str(tmp_path), whole=whole).collect())) == due
    # One turn reads its range only, wherever it begins; without states it reads the file.
    read = []
    monkeypatch.setattr(scans, "_blocks", lambda stream, size: read.append((stream.tell(), size)) or [stream.read(size)])
    row = {"path": f"file:{tmp_path}/f1000", "length": 1000, "since": 0, "state": None}
    while row.get("sha256") is None:
        batch = pa.RecordBatch.from_pylist([{k: row[k] for k in ("path", "length", "since", "state")}], pa.schema([f for f in scans._TURN if f.name != "sha256"]))
        (told,) = scans._turn(384)(iter([batch]))
        (row,) = told.to_pylist()
    assert read == [(0, 384), (384, 384), (768, 232)] and row["sha256"] == hashlib.sha256(bodies["f1000"]).hexdigest()
    monkeypatch.setattr(sha_state, "library", lambda: None)
    (told,) = scans._turn(384)(iter([batch]))
    assert read[3:] == [(0, 1000)] and told.to_pylist()[0]["sha256"] == row["sha256"]
    monkeypatch.undo()
    with pytest.raises(ValueError):
        list(scans._turn(100)(iter([batch.set_column(2, "since", pa.array([0])).set_column(3, "state", pa.array([None], pa.binary()))])))


def test_the_second_way_reads_files_over_two_gigabytes(spark, tmp_path):
    """Sparse, as above. A value of Spark's can't hold it."""
    path, size, due = tmp_path / "big", (1 << 31) + 77, hashlib.sha256()
    with open(path, "wb") as f:
        f.truncate(size)
        for at in (0, (192 << 20) - 1, size - 3):
            f.seek(at)
            f.write(b"abc")
    with open(path, "rb") as f:
        while block := f.read(64 << 20):
            due.update(block)
    second = scans.fingerprint(spark, str(path))
    assert [tuple(r) for r in second.collect()] == [("big", due.hexdigest(), size)]
    assert scans.compare_fingerprints(scans.streamed_fingerprint(spark, str(path)), second).isEmpty()


def test_two_writers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(n):
        try:
            return publish(spark.range(n, n + 1000), str(tmp_path), "v1")
        except ValueError as refused:
            return str(refused)

    with ThreadPoolExecutor(4) as pool:
        said = list(pool.map(write, range(4)))
    assert sorted(said)[-1] == "written" and sum(s == "written" for s in said) == 1
    first = said.index("written")
    assert {r.id for r in read_version(spark.range(1), str(tmp_path), "v1").collect()} == set(range(first, first + 1000))
    assert spark.read.parquet(str(tmp_path)).count() == 1000


def test_a_writer_that_fails_half_way(spark, tmp_path):
    failing = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        publish(failing, str(tmp_path), "v1")
    assert read_version(failing, str(tmp_path), "v1") is None
    assert publish(spark.range(5), str(tmp_path), "v1") == "written"
    with pytest.raises(Exception, match="lost"):
        publish(failing, str(tmp_path), "v1", on_conflict="replace")
    assert read_version(failing, str(tmp_path), "v1").count() == 5


def test_a_version_made_from_the_one_it_replaces(spark, tmp_path):
    assert publish(spark.range(5), str(tmp_path), "v1") == "written"
    more = read_version(spark.range(1), str(tmp_path), "v1").unionByName(spark.range(5, 9))
    assert publish(more, str(tmp_path), "v1", on_conflict="replace") == "replaced"
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path)).select("id").collect()) == list(range(9))
    assert len(list((tmp_path / "_replaced").iterdir())) == 1
