"""Files: A01-A06, A08, A13, K09. Files are written from the test tables into the shared folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from refledger.functions.dates import era_packed_date
from refledger.functions.text import is_code
from refledger.operators import contracts, history
from refledger.plans.registry import Tables, query
from refledger.sources import scans
from refledger.sources.publish import publish, read_version, write_jsonl
from refledger.sources.workspace import cut, fresh_path


def schema_of(df: DataFrame) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields])


def written_csv(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(
    "a01_strict_csv_scan",
    "SELECT code, name_en, COALESCE(ingredient, '') AS ingredient, manufacturer, row_no FROM {source3}",
)
def a01(t: Tables):
    """A source written as CSV, empty fields included, and scanned by its exact header."""
    path = written_csv(t["source3"], "source3")
    return scans.scan_csv_strict(t.spark, path, schema_of(t["source3"]), blanks=True)


@query("a01_strict_csv_quoted_newlines", "SELECT doc_id, md5(text) AS digest FROM {documents}")
def a01_multi_line(t: Tables):
    """Whole documents as CSV fields, with line feeds and doubled quotes inside."""
    rows = t["documents"].select("doc_id", F.concat(F.lit('"'), "text").alias("text"))
    read = scans.scan_csv_strict(t.spark, written_csv(rows, "documents"), schema_of(rows), multi_line=True)
    return read.select("doc_id", F.md5(F.substring("text", F.lit(2), F.length("text"))).alias("digest"))


@query("a02_strict_jsonl_scan", "SELECT code, name_en, COALESCE(ingredient, '') AS ingredient, COALESCE(coverage_rule, '') AS coverage_rule, ord FROM {announcement}")
def a02(t: Tables):
    rows = t["announcement"].select("code", "name_en", "ingredient", "coverage_rule", "ord")
    path = fresh_path(t.spark, "announcement")
    write_jsonl(rows, path)
    return scans.scan_jsonl_strict(t.spark, path, schema_of(rows)).na.fill("")


@query(
    "a08_jsonl_sink",
    """SELECT k AS key, COUNT(*) AS n FROM {announcement}, (SELECT unnest(['code', 'name_en', 'ingredient', 'price_after']) AS k) GROUP BY k""",
)
def a08(t: Tables):
    """One object per line, absent values written as null, so every line has every key."""
    path = fresh_path(t.spark, "announcement")
    write_jsonl(t["announcement"].select("code", "name_en", "ingredient", "price_after"), path)
    keys = t.spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


def _declared(t: Tables) -> DataFrame:
    return t["part"].groupBy(F.concat("p_brand", F.lit(".csv")).alias("declaredName")).agg(
        F.sha2(F.max("p_name"), 256).alias("sha256"),
        F.sum(F.length("p_name")).cast("bigint").alias("bytes"),
        F.count("*").alias("recordCount"),
    )


@query(
    "a03_manifest_check",
    """SELECT 'manifest' AS check_id, '' AS key, 'effective_from' AS detail FROM (SELECT COUNT(*) AS n FROM {part}) WHERE n > 0
       UNION ALL SELECT 'manifest_file', p_brand || '.csv', CASE p_brand WHEN 'Brand#7' THEN 'not authorised' ELSE 'differs' END
       FROM {part} WHERE p_brand IN ('Brand#7', 'Brand#9') GROUP BY p_brand
       UNION ALL SELECT 'manifest_file', 'Brand#99.csv', 'missing' FROM (SELECT COUNT(*) AS n FROM {part}) WHERE n > 0""",
)
def a03(t: Tables):
    """One manifest entry per brand, against a list with one entry dropped, one altered and one added."""
    files = _declared(t).agg(F.array_sort(F.collect_list(F.struct("declaredName", "sha256", "bytes", "recordCount"))).alias("files"))
    manifest = files.select(
        F.lit(scans.MANIFEST_SCHEMA).alias("schema"), F.lit("v1").alias("datasetVersion"), F.lit("2026-09-01").alias("effectiveFrom"),
        F.lit("9999-12-31").alias("effectiveTo"), F.lit(False).alias("revoked"), "files",
    )
    path = fresh_path(t.spark, "manifest")
    write_jsonl(manifest, path)
    known = _declared(t).where("declaredName <> 'Brand#7.csv'")
    edited = F.when(F.col("declaredName") == "Brand#9.csv", F.col("recordCount") + 1).otherwise(F.col("recordCount"))
    extra = known.agg(F.max("sha256").alias("sha256"), F.max("bytes").alias("bytes"), F.max("recordCount").alias("recordCount"))
    expected = known.withColumn("recordCount", edited).unionByName(extra.withColumn("declaredName", F.lit("Brand#99.csv")))
    found = scans.check_manifest(scans.scan_manifest(t.spark, path), expected, "v1", "2026-08-01")
    return found.select("check_id", "key", "detail")


LINE_SQL = "CAST(c_custkey AS STRING) || '|' || c_name || '|' || c_mktsegment"


@query(
    "a04_file_fingerprint",
    f"""WITH f AS (SELECT c_custkey // 100 AS grp, string_agg({LINE_SQL} || chr(10), '' ORDER BY c_custkey) AS body FROM {{customer}} GROUP BY c_custkey // 100)
        SELECT CAST(grp AS STRING) AS name, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS bytes,
               CASE grp % 7 WHEN 3 THEN 'sha256' WHEN 5 THEN 'bytes' WHEN 6 THEN 'not pinned' ELSE '' END AS finding FROM f
        UNION ALL SELECT 'lost', '', -1, 'missing'""",
)
def a04(t: Tables):
    """A file of every hundred customers, read in blocks, and compared with pins of which some are wrong."""
    path = fresh_path(t.spark, "customers")
    line = F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    rows = t["customer"].select(F.floor(F.col("c_custkey") / 100).alias("grp"), "c_custkey", line.alias("value"))
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "c_custkey")
    dealt.select("grp", "value").write.partitionBy("grp").text(path)
    files = cut(scans.streamed_fingerprint(t.spark, f"{path}/*/*.txt", name=F.regexp_extract("path", "grp=([0-9]+)/", 1)), "fingerprints")
    # Pins come from the rows, not from the files.
    held = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "value"))), lambda r: F.concat(r["value"], F.lit("\n")))
    bodies = rows.groupBy("grp").agg(F.array_join(held, "").alias("body"))
    pins = bodies.where("grp % 7 <> 6").select(
        F.col("grp").cast("string").alias("name"), F.when(F.col("grp") % 7 == 3, "x").otherwise(F.sha2("body", 256)).alias("sha256"),
        (F.octet_length("body") + F.when(F.col("grp") % 7 == 5, 1).otherwise(0)).cast("bigint").alias("bytes"),
    )
    pins = pins.unionByName(t.spark.range(1).select(F.lit("lost").alias("name"), F.lit("x").alias("sha256"), F.lit(1).cast("bigint").alias("bytes")))
    told = files.join(scans.compare_fingerprints(files, pins), "name", "full")
    return told.select(
        "name", F.coalesce("sha256", F.lit("")).alias("sha256"), F.coalesce("bytes", F.lit(-1).cast("bigint")).alias("bytes"),
        F.coalesce("finding", F.lit("")).alias("finding"),
    )


@query("a04_scale_factor_files")
def a04_files(t: Tables):
    """Every file of the scale factor: SHA-256 and size, a tree of its byte ranges, and whether a second way agrees."""
    path = f"{t.sf_dir}/*.parquet"
    name = F.regexp_extract("path", "([^/]+[.]parquet(/[^/]+)?)$", 1)
    files = cut(scans.streamed_fingerprint(t.spark, path, name=name), "fingerprints")
    trees = scans.file_trees(t.spark, path, chunk=1 << 20).select(name.alias("name"), "tree")
    odd = scans.compare_fingerprints(files, scans.fingerprint(t.spark, path, name=name))
    return files.join(trees, "name").join(odd, "name", "left").select("name", "sha256", "bytes", "tree", F.coalesce("finding", F.lit("")).alias("finding"))


@query(
    "a05_dataset_digest",
    """SELECT conv_id, sha256(string_agg(sha256(text), '' ORDER BY lpad(CAST(turn AS STRING), 6, '0'))) AS digest, COUNT(*) AS n_files
       FROM {conversations} GROUP BY conv_id""",
)
def a05(t: Tables):
    """Each conversation as a dataset, its turns as the files."""
    files = t["conversations"].select(
        "conv_id", F.lpad(F.col("turn").cast("string"), 6, "0").alias("name"), F.sha2("text", 256).alias("sha256")
    )
    return scans.dataset_digest(files, ["conv_id"])


@query(
    "a06_write_once_publish",
    """SELECT code, COUNT(*) AS n, 'written unchanged refused replaced' AS outcomes FROM {periods} WHERE price_raw <> '0.00' GROUP BY code""",
)
def a06(t: Tables):
    """Publish a version; again; with other content, which is refused; and replace it."""
    path, rows = fresh_path(t.spark, "published"), t["periods"]
    other = rows.where("price_raw <> '0.00'")
    outcomes = [publish(rows, path, "v1"), publish(rows, path, "v1")]
    try:
        publish(other, path, "v1")
    except ValueError:
        outcomes.append("refused")
    outcomes.append(publish(other, path, "v1", on_conflict="replace"))
    published = read_version(other, path, "v1")
    return published.groupBy("code").agg(F.count("*").alias("n")).withColumn("outcomes", F.lit(" ".join(outcomes)))


@query(
    "a13_column_drop",
    "SELECT code, COUNT(*) AS n, 'code,price_raw,ord' AS columns FROM {periods} GROUP BY code",
)
def a13(t: Tables):
    """A link column is checked, then left out of what is published."""
    rows = t["periods"].select("code", "price_raw", "ord", F.concat(F.lit("https://example.invalid/"), "code").alias("link"))
    checks = contracts.expect_nonempty(rows, ["link"], "periods", ["code"])
    path = fresh_path(t.spark, "published")
    publish(rows, path, "v1", checks=checks, drop=["link"])
    published = t.spark.read.parquet(f"{path}/dataset_version=v1")
    return published.groupBy("code").agg(F.count("*").alias("n")).withColumn("columns", F.lit(",".join(published.columns)))


FLAT = StructType([StructField(c, StringType()) for c in ("code", "name_en", "price", "start", "end")] + [StructField("row_no", LongType())])


def flat_rows(t: Tables) -> DataFrame:
    """Periods as a delivered file holds them, with packed dates."""

    def packed(col: str):
        day = F.col(col)
        era = F.concat(F.lpad((F.year(day) - 1911).cast("string"), 3, " "), F.date_format(day, "MMdd"))
        return F.when(day == F.lit("9999-12-31").cast("date"), "9991231").otherwise(era)

    return t["periods"].join(t["items"].select("code", "name_en"), "code").select(
        "code", "name_en", F.col("price_raw").alias("price"), packed("start_date").alias("start"),
        packed("end_date").alias("end"), F.col("ord").alias("row_no"),
    )


@query(
    "k09_build_master",
    """SELECT p.code, i.name_en, row_number() OVER (PARTITION BY p.code ORDER BY start_date, end_date, p.ord) AS seq,
              strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, price_raw
       FROM {periods} p JOIN {items} i USING (code)""",
)
def k09(t: Tables):
    """The whole build: strict scan, packed dates, contracts, history, publish."""
    scanned = scans.scan_csv_strict(t.spark, written_csv(flat_rows(t), "flat"), FLAT, blanks=True)
    rows = cut(
        scanned.select(
            "code", "name_en", F.col("price").alias("price_raw"), era_packed_date(F.col("start")).alias("start_date"),
            era_packed_date(F.col("end")).alias("end_date"), F.col("row_no").alias("ord"),
        ),
        "master-rows",
    )
    valid = {
        "code": is_code(F.col("code")),
        "name": F.col("name_en") != "",
        "price": F.col("price_raw") != "",
        "dates": F.col("start_date") <= F.col("end_date"),
    }
    checks = contracts.all_of_checks(
        [
            contracts.expect_valid(rows, valid, "master", ["ord"]),
            contracts.expect_invariant(rows.withColumnRenamed("ord", "row_no"), "code", ["name_en"], "master"),
            contracts.expect_disjoint(rows, "code", "master"),
        ]
    )
    path = fresh_path(t.spark, "master")
    publish(history.to_history(rows, "code", ["name_en"]), path, "v1", checks=checks)
    master = t.spark.read.parquet(path).where("dataset_version = 'v1'")
    iso = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start_date", "end_date")]
    return master.select("code", "name_en", "seq", *iso, "price_raw")
