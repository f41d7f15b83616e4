"""The registered queries of this subpackage: thin calls of the operators with their contract's parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.llm import ann, decontaminate, language, line_dedup, merkle, mixing, near_dup, oracles, repeats, shards, spelling
from refledger.llm import token_count, token_files, url_graph
from refledger.llm.common import table
from refledger.sources.workspace import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


@query("op1_templates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


URL_RULES = [
    url_graph.Rule("block", "net", "/"),
    url_graph.Rule("allow", "example.net", "/en/"),
    url_graph.Rule("block", "example.com", "/de/"),
    url_graph.Rule("allow", "org", "/fr/"),
]


@query("op2_link_trust", oracles.link_trust(URL_RULES))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_graph.judge(table(spark, sf_dir, "pages"), url_graph.rules_of(spark, URL_RULES))
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.evidence", "found.rejected")


@query("op4_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


N_SHARDS = 24


@query("op5_rendezvous", oracles.rendezvous(N_SHARDS))
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = {s: 1.0 for s in range(N_SHARDS)}
    return shards.assign(table(spark, sf_dir, "documents"), even, grown=even | {N_SHARDS: 1.0})


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(mixing.mix(table(spark, sf_dir, "documents"), mixing.cyclic((3, 1, 2)), share=1.5, cap=2))


@query("op6_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), least=400)


@query("op7_multi_index")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    usable = rows.where(ann.usable(F.col("embedding")))
    return ann.search(rows, rows.where("vec_id % 100 = 0"), ann.fit(usable, "vec_id", "embedding"))


@query("op8_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


@query("op10_lines")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), edits=2, per=10)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@query("op11_merkle", oracles.manifest())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = merkle.record_digest([F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed)
    proved = merkle.manifest(docs, FIELDS, also={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    told = proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_spelling", oracles.spelling())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query("op13_token_orc")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fresh_path(spark, "token-ids")
    token_files.write_ids(table(spark, sf_dir, "documents"), files)
    return token_files.read_ids(spark, files).select("doc_id", "start", "n_tokens", token_files.ids_crc32(F.col("ids")).alias("ids_crc32"))
