"""Registered queries of this folder: each applies its operator to the whole tables of ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonotable.llm import collocations, decontam, exact_dedup, merkle, ngram_join, packing, pii, rans, secrets, sharding, substring, suffix_dedup, toxicity
from sonotable.llm.common import documents, select_plain
from sonotable.session import scratch_path


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    # production sets the key; the test tables hold no real values
    return pii.pseudonymise(documents(spark, sf_dir), spark.conf.get("spark.sonotable.pseudonym.key", "test-tables"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    rans.write_tokens(documents(spark, sf_dir), path)
    return rans.read_tokens(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(select_plain(documents(spark, sf_dir), "doc_id", "text"), 24)
    return out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                      F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.audited(documents(spark, sf_dir))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("siblings")).alias("proof_sha256"), "folded_root", "verified")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_rans_token_files": op8_rans_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_histogram_sharding": op11_histogram_sharding,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_phrase_collocations": op13_phrase_collocations,
}
