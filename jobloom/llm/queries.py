"""The corpus queries: one per operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import (
    centroids,
    decontaminate,
    hard_negatives,
    licenses,
    line_dedup,
    minhash,
    mixing,
    quality_crf,
    secrets,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)
from jobloom.session import remove, settle, shared_dir, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "unit", "line", "license", F.round("dice", 6).alias("dice"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_live", "n_example", "n_repos", "n_owners",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.judge(docs, field).withColumnRenamed("doc", "doc_id")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        (F.col("doc") == F.col("component")).alias("kept"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "similarity",
        F.col("start").alias("start_word"), F.col("size").alias("n_words"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        F.col("doc").alias("doc_id"),
        toxicity.held_out(F.col("doc")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    records = settle(warc.read_archives(spark, path))
    remove(spark, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("level", F.col("doc").alias("doc_id"), "start", "end", "n_units", "n_words", "kept_in")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.lit(4096)
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"))
    told = token_counts.answers(counted, budget=limit, at=limit)
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return told.select(F.col("doc").alias("doc_id"), "n_bytes", "n_tokens", over, "cut_chars", "tokens_at")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("id") % 50 == 0)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_secret_scan,
        op3_quality_rules,
        op4_source_mix,
        op5_minhash_dedup,
        op6_line_dedup,
        op7_benchmark_decontamination,
        op8_toxicity,
        op9_warc_roundtrip,
        op10_substring_dedup,
        op11_token_counts,
        op12_hard_negatives,
        op13_centroid_clusters,
    )
}
