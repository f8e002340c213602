"""The operators' registered queries, each over its whole table, and the SQL equal to them where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import embeddings, exact, langid, licenses, mixing, packing, quality, repair, search, secretscan, sharding, simhash, toxicity
from gridcast.llm.common import read

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query()
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


@query()
def op2_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


@query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(read(spark, sf_dir, "documents"))


@query()
def op7_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@query(secretscan.oracle())
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secretscan.BASE))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secretscan.span_list(base).cast("binary"), 256).alias("base_sha256"), secretscan.span_list(F.col("secrets")).alias("spans"),
    )


@query(licenses.oracle())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read(spark, sf_dir, "documents"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


@query()
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


@query()
def op8_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(search.oracle())
def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(sharding.oracle())
def op12_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read(spark, sf_dir, "documents"))


@query(repair.oracle())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damage(conversations), conversations)
