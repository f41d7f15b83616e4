"""Builds step by step: K09-K11 over clean and over broken deliveries, one row per step with its number of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.functions.dates import era_packed_date
from refledger.functions.text import is_code
from refledger.operators import contracts, history
from refledger.plans.q_lines import CRITERIA_SQL, rules_of
from refledger.plans.q_sources import flat_rows, schema_of
from refledger.plans.registry import Tables, query
from refledger.sources import scans
from refledger.sources.publish import publish, write_jsonl
from refledger.sources.workspace import cut, fresh_path

DELIVERY = ("manifest", "fingerprint", "digest", "count")


def delivered(t: Tables, rows: DataFrame, kind: str, broken: bool, part: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows written as a file for each `part`, with a manifest of all files, scanned again, and the findings per file.

    The broken manifest states another hash and one record more of every file, and its entries have a key too many.
    """
    path = fresh_path(t.spark, kind)
    dealt = rows.withColumn("part", part).repartition("part").sortWithinPartitions("part").write.partitionBy("part")
    if kind == "csv":
        dealt.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        scanned = scans.scan_csv_strict(t.spark, path, schema_of(rows), blanks=True, nested=True)
    else:
        text = rows.select(part.alias("part"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
        text.repartition("part").sortWithinPartitions("part").write.partitionBy("part").text(path)
        scanned = scans.scan_jsonl_strict(t.spark, path, schema_of(rows), nested=True)
    number = "part=([0-9]+)/"
    scanned = cut(scanned.withColumn("__file", F.regexp_extract(F.input_file_name(), number, 1)), "scanned")
    files = cut(scans.streamed_fingerprint(t.spark, path, name=F.regexp_extract("path", number, 1), nested=True), "files")
    counted = cut(scanned.groupBy(F.col("__file").alias("name")).agg(F.count("*").alias("recordCount")), "counts")
    authorised = files.join(counted, "name").select(F.col("name").alias("declaredName"), "sha256", "bytes", "recordCount")
    authorised = cut(authorised, "authorised")
    stated = authorised.withColumn("sha256", F.lit("x")).withColumn("recordCount", F.col("recordCount") + 1) if broken else authorised
    extra = [F.lit("a note").alias("note")] if broken else []
    # A manifest is one value: one small entry a file.
    listed = stated.agg(F.sort_array(F.collect_list(F.struct("declaredName", "sha256", "bytes", "recordCount", *extra))).alias("files"))
    manifest = listed.select(
        F.lit(scans.MANIFEST_SCHEMA).alias("schema"), F.lit("v1").alias("datasetVersion"), F.lit("2026-09-01").alias("effectiveFrom"),
        F.lit("9999-12-31").alias("effectiveTo"), F.lit(False).alias("revoked"), "files",
    )
    manifest_path = fresh_path(t.spark, "manifest")
    write_jsonl(manifest, manifest_path)
    read = cut(scans.scan_manifest(t.spark, manifest_path), "manifests")
    entries = read.select(F.inline("files")).withColumnRenamed("declaredName", "name")
    digests = [scans.dataset_digest(x.withColumn("set", F.lit(1)), ["set"]).select("digest") for x in (files, entries)]
    odd_counts = counted.join(entries.select("name", F.col("recordCount").alias("due")), "name").where("recordCount <> due")
    return scanned.drop("__file"), {
        "manifest": scans.check_manifest(read, authorised, "v1", "2026-09-01"),
        "fingerprint": scans.compare_fingerprints(files, entries),
        "digest": digests[0].join(digests[1], "digest", "left_anti"),
        "count": contracts.violations(odd_counts, "count", "data", F.col("name"), F.col("due")),
    }


def published(rows: DataFrame, checks: DataFrame, drop: list[str]) -> dict[str, DataFrame]:
    """Findings of the publish step: a refusal, and columns that should have gone."""
    path, spark = fresh_path(rows.sparkSession, "built"), rows.sparkSession
    try:
        publish(rows, path, "v1", checks=checks, drop=drop)
    except ValueError:
        return {"publish": spark.range(1), "columns": spark.range(0)}
    left = [c for c in spark.read.parquet(f"{path}/dataset_version=v1").columns if c in drop]
    return {"publish": spark.range(0), "columns": spark.range(len(left))}


def both(build, t: Tables) -> DataFrame:
    runs = [contracts.findings(build(t, broken)).select(F.lit(word).alias("input"), "step", "n_findings") for word, broken in (("clean", False), ("broken", True))]
    return runs[0].unionByName(runs[1])


def _clean(*steps: str) -> str:
    return "SELECT 'clean' AS input, unnest([" + ", ".join(f"'{s}'" for s in (*DELIVERY, *steps)) + "]) AS step, CAST(0 AS BIGINT) AS n_findings"


def _broken(files: str) -> str:
    """Findings of a broken delivery; `files` is SQL for its number of files."""
    steps = "('manifest', 2, 0), ('fingerprint', 1, 0), ('digest', 0, 1), ('count', 1, 0), ('publish', 0, 1), ('columns', 0, 0)"
    return f"SELECT 'broken', step, per_file * ({files}) + once FROM (VALUES {steps}) v(step, per_file, once)"


ODD = "CAST(substr(code, 3) AS BIGINT) % 25 = 0"


@query(
    "k09_build_steps",
    f"""{_clean("valid", "invariant", "cardinality", "disjoint", "publish", "columns")}
        UNION ALL {_broken("SELECT COUNT(DISTINCT CAST(substr(code, 3) AS BIGINT) // 100) FROM {periods}")}
        UNION ALL SELECT 'broken', 'valid', COUNT(*) FROM {{periods}} WHERE {ODD}
        UNION ALL SELECT 'broken', 'invariant', COUNT(*) FROM (SELECT code FROM {{periods}} WHERE {ODD} GROUP BY code HAVING COUNT(*) > 1)
        UNION ALL SELECT 'broken', 'cardinality', CAST(COUNT(DISTINCT {ODD}) > 1 AS BIGINT) FROM {{periods}}
        UNION ALL SELECT 'broken', 'disjoint', 0""",
)
def k09_steps(t: Tables):
    """Delivery, strict scan, packed dates, contracts, history, publish without the link column."""

    def build(t: Tables, broken: bool) -> dict[str, DataFrame]:
        odd = F.lit(broken) & (F.substring("code", 3, 20).cast("bigint") % 25 == 0)
        first = F.min("row_no").over(Window.partitionBy("code")) == F.col("row_no")
        flat = flat_rows(t).withColumn("first", first)
        flat = flat.select(
            "code", F.when(odd & F.col("first"), F.concat("name_en", F.lit("?"))).otherwise(F.col("name_en")).alias("name_en"),
            F.when(odd, F.lit("")).otherwise(F.col("price")).alias("price"), "start", "end", "row_no",
        )
        scanned, steps = delivered(t, flat, "csv", broken, F.floor(F.substring("code", 3, 20).cast("bigint") / 100))
        kind = F.when(F.lit(broken) & (F.substring("code", 3, 20).cast("bigint") % 25 == 0), "B").otherwise("A")
        rows = scanned.select(
            "code", "name_en", F.col("price").alias("price_raw"), era_packed_date(F.col("start")).alias("start_date"),
            era_packed_date(F.col("end")).alias("end_date"), F.col("row_no").alias("ord"), kind.alias("kind"),
            F.concat(F.lit("https://example.invalid/"), "code").alias("link"),
        )
        rows = cut(rows, "master-rows")
        valid = {
            "code": is_code(F.col("code")), "name": F.col("name_en") != "", "price": F.col("price_raw") != "",
            "dates": F.col("start_date") <= F.col("end_date"), "link": F.col("link") != "",
        }
        steps |= {
            "valid": contracts.expect_valid(rows, valid, "master", ["ord"]),
            "invariant": contracts.expect_invariant(rows.withColumnRenamed("ord", "row_no"), "code", ["name_en"], "master"),
            "cardinality": contracts.expect_cardinality(rows, ["kind"], 1, "master"),
            "disjoint": contracts.expect_disjoint(rows, "code", "master"),
        }
        checks = contracts.all_of_checks([steps[s] for s in ("valid", "invariant", "cardinality", "disjoint")])
        attrs = ["name_en", "kind", "link"]
        return steps | published(history.to_history(rows, "code", attrs), checks, ["link", "kind"])

    return both(build, t)


@query(
    "k10_build_steps",
    f"""{_clean("unique", "nameless", "publish", "columns")}
        UNION ALL {_broken("SELECT COUNT(DISTINCT ord // 100) FROM {announcement}")}
        UNION ALL SELECT 'broken', 'unique', COUNT(*) FROM {{announcement}} WHERE {ODD}
        UNION ALL SELECT 'broken', 'nameless', 2 * COUNT(*) FROM {{announcement}} WHERE {ODD}""",
)
def k10_steps(t: Tables):
    """The merged announcement as a delivered file; in the broken one some records come twice and have no name."""

    def build(t: Tables, broken: bool) -> dict[str, DataFrame]:
        records = t["announcement"].select("code", "name_en", F.coalesce("ingredient", F.lit("")).alias("ingredient"), "ord")
        odd = F.substring("code", 3, 20).cast("bigint") % 25 == 0
        if broken:
            records = records.withColumn("name_en", F.when(odd, F.lit("")).otherwise(F.col("name_en")))
            records = records.unionByName(records.where(odd))
        scanned, steps = delivered(t, records, "csv", broken, F.floor(F.col("ord") / 100))
        steps |= {
            "unique": contracts.expect_unique(scanned, ["code"], "announcement"),
            "nameless": contracts.expect_nonempty(scanned, ["name_en"], "announcement", ["code"]),
        }
        checks = contracts.all_of_checks([steps["unique"], steps["nameless"]])
        return steps | published(scanned, checks, ["ingredient"])

    return both(build, t)


@query(
    "k11_build_steps",
    CRITERIA_SQL.rstrip()
    + f""" {_clean("unique", "nonempty", "null_together", "publish", "columns")}
        UNION ALL {_broken("SELECT COUNT(DISTINCT doc // 100) FROM n")}
        UNION ALL SELECT 'broken', 'unique', 0
        UNION ALL SELECT 'broken', 'nonempty', COUNT(*) FROM n WHERE doc % 7 = 0
        UNION ALL SELECT 'broken', 'null_together', COUNT(*) FROM n WHERE doc % 7 = 0 AND sub <> 0""",
)
def k11_steps(t: Tables):
    """Criteria as JSON lines; in the broken file some documents' criteria have no text and no prerequisite."""
    found = cut(rules_of(t).criteria.select("doc", "tier_id", "group_id", "prerequisite", "criterion_id", "text"), "criteria")

    def build(t: Tables, broken: bool) -> dict[str, DataFrame]:
        odd = F.lit(broken) & (F.col("doc") % 7 == 0)
        told = found.withColumn("text", F.when(odd, F.lit("")).otherwise(F.col("text"))).withColumn("prerequisite", F.when(~odd, F.col("prerequisite")))
        scanned, steps = delivered(t, told, "jsonl", broken, F.floor(F.col("doc") / 100))
        rows = scanned.withColumn("key", F.concat_ws("/", "doc", "criterion_id"))
        steps |= {
            "unique": contracts.expect_unique(rows, ["key"], "criteria"),
            "nonempty": contracts.expect_nonempty(rows, ["text"], "criteria", ["key"]),
            "null_together": contracts.expect_null_together(rows, "group_id", "prerequisite", "criteria", ["key"]),
        }
        checks = contracts.all_of_checks([steps[s] for s in ("unique", "nonempty", "null_together")])
        return steps | published(rows, checks, ["key"])

    return both(build, t)
